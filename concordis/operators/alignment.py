"""Multi-way alignment of competing transcriptions, disagreement and fusion.

The alignment of a unit is kept sparse.  Every member is compared with the unit's
centre text; only the columns where some member departs from the centre become rows.
All other columns are unanimous, so they add nothing to the entropy and keep the
centre's symbol in the fused text.  Row counts therefore follow the number of
disagreements, not the number of characters.

Identical texts of one unit are collapsed first and carry the list of members they
stand for, so copies are compared once and never paired with each other.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordis.functions.edits import CENTRE_LANE, aligned_text, centre_of, edit_distance, fused_text, unit_centre, unit_edit_script, vote_kinds
from concordis.functions.identity import seal
from concordis.functions.text import char_count, char_tokens, normalize_text, text_sha256
from concordis.session import spread
from concordis.sources.stores import stored

KEYS = ("run_manifest_id", "evaluation_unit_id")
QUORUM = 2
TEXT_POLICY_ID = "text_policy_v1"
ALIGNMENT_POLICY_ID = "alignment_v1"
FUSION_POLICY_ID = "fusion_v1"


class Alignment(NamedTuple):
    """``centres``: one row per unit.  ``scripts``: one row per distinct other text of a unit.  ``units``: the same scripts in their unit's row."""

    members: DataFrame
    centres: DataFrame
    scripts: DataFrame
    keys: tuple[str, ...]
    units: DataFrame


def _spaced(hypotheses: DataFrame, keys) -> DataFrame:
    """Texts under the text policy, those of a unit in one task."""
    kept = [c for c in hypotheses.columns if c != "text"]
    return spread(hypotheses.select(*kept, normalize_text(F.col("text")).alias("text")), *keys)


def ranked_members(hypotheses: DataFrame, keys=KEYS) -> DataFrame:
    """Hypotheses under the text policy with their rank in the unit and the unit's size."""
    spaced = _spaced(hypotheses, keys)
    unit = Window.partitionBy(*keys)
    return spaced.withColumns(
        {
            "hyp_index": F.row_number().over(unit.orderBy("position")) - 1,
            "hypothesis_count": F.count(F.lit(1)).over(unit).cast("int"),
        }
    )


def distinct_texts(members: DataFrame, keys=KEYS) -> DataFrame:
    """One row per distinct text of a unit, with the ranks of the members sharing it."""
    return (
        members.select(*keys, "hyp_index", "hypothesis_count", "text", text_sha256(F.col("text")).alias("text_sha256"))
        .groupBy(*keys, "text_sha256")
        .agg(
            F.sort_array(F.collect_list("hyp_index")).alias("member_ranks"),
            F.any_value("text").alias("text"),
            F.any_value("hypothesis_count").alias("hypothesis_count"),
        )
        .withColumn("hyp_index", F.col("member_ranks")[0])
        .drop("text_sha256")
    )


def pair_distances(texts: DataFrame, keys=KEYS) -> DataFrame:
    """Edit distance of every two distinct texts of a unit (left rank below right rank)."""
    left = texts.select(*keys, *[F.col(c).alias(f"left_{c}") for c in ("hyp_index", "text", "member_ranks")])
    right = texts.select(*keys, *[F.col(c).alias(f"right_{c}") for c in ("hyp_index", "text", "member_ranks")])
    return (
        left.join(right, list(keys))
        .where(F.col("left_hyp_index") < F.col("right_hyp_index"))
        .select(
            *keys, "left_hyp_index", "right_hyp_index",
            F.size("left_member_ranks").alias("left_copies"),
            F.size("right_member_ranks").alias("right_copies"),
            edit_distance("left_text", "right_text").alias("distance"),
        )
    )


def summed_distances(distances: DataFrame, keys=KEYS) -> DataFrame:
    """Distance of each distinct text to all other members of its unit."""
    sides = F.array(
        F.struct(
            F.col("left_hyp_index").alias("hyp_index"),
            (F.col("distance").cast("bigint") * F.col("right_copies")).alias("part"),
        ),
        F.struct(
            F.col("right_hyp_index").alias("hyp_index"),
            (F.col("distance").cast("bigint") * F.col("left_copies")).alias("part"),
        ),
    )
    return (
        distances.select(*keys, F.inline(sides))
        .groupBy(*keys, "hyp_index")
        .agg(F.sum("part").alias("summed_distance"))
    )


def centre_ranks(distances: DataFrame, keys=KEYS) -> DataFrame:
    """Least summed distance wins, the lower rank on a tie."""
    return (
        summed_distances(distances, keys)
        .groupBy(*keys)
        .agg(F.min(F.struct("summed_distance", "hyp_index"))["hyp_index"].alias("centre_index"))
    )


def unit_centres(texts: DataFrame, keys=KEYS) -> DataFrame:
    """The same centre as ``centre_ranks`` finds, without solving every pair; also counts the pairs solved.

    One unit's different texts (a configured roster) meet in one row.  A pair is solved only
    while the bounds of its distance leave open who wins.
    """
    copies = F.size("member_ranks").alias("copies")
    roster = F.sort_array(F.collect_list(F.struct("hyp_index", copies, "text")))
    return (
        texts.groupBy(*keys)
        .agg(roster.alias("roster"))
        .withColumn("centre", centre_of("roster.text", "roster.copies"))
        .select(*keys, F.col("roster.hyp_index")[F.col("centre.place")].alias("centre_index"), F.col("centre.solved_pairs").alias("solved_pairs"))
    )


def align(hypotheses: DataFrame, keys=KEYS) -> Alignment:
    """Pick each unit's centre and find where every other distinct text departs from it.

    A unit's texts (a configured roster) meet in one row, where its centre and the scripts are solved at
    once: the texts move one time, nothing is stored and no join has to bring the centre's text to the others.
    """
    members = ranked_members(hypotheses, keys)
    texts = (
        _spaced(hypotheses, keys).select(*keys, "position", "text")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("roster"))
        .select(*keys, F.size("roster").alias("hypothesis_count"), F.col("roster.text").alias("texts"))
    )
    columns = lambda found: [
        *keys, F.col(f"{found}.centre_index").alias("centre_index"), "hypothesis_count",
        F.get("texts", F.col(f"{found}.centre_index")).alias("centre_text"), F.col(f"{found}.centre_ranks").alias("centre_ranks"),
    ]
    centres = texts.withColumn("centre", unit_centre("texts")).select(*columns("centre"))
    units = texts.withColumn("solved", unit_edit_script("texts")).select(*columns("solved"), F.col("solved.readings").alias("readings"))
    return Alignment(members, centres, _scripts(units, keys), tuple(keys), units)


def _scripts(units: DataFrame, keys) -> DataFrame:
    # An outer generator, since a plain one also filters on the scripts and so solves them twice.
    each = units.select(*keys, "hypothesis_count", F.explode_outer("readings").alias("reading")).where(F.col("reading.hyp_index").isNotNull())
    return each.select(
        *keys, F.col("reading.hyp_index").alias("hyp_index"), "hypothesis_count", F.col("reading.member_ranks").alias("member_ranks"),
        F.col("reading.script").alias("script"),
    )


def materialized(alignment: Alignment) -> Alignment:
    """The alignment with its units, and so its centres and scripts, as a stored table.

    Use it when several results are taken from one alignment, so each edit script is
    solved once.
    """
    units = stored(alignment.units)
    return alignment._replace(units=units, centres=units.select(*alignment.centres.columns), scripts=_scripts(units, alignment.keys))


def departures(alignment: Alignment) -> DataFrame:
    """One row per member text and alignment column where it departs from the centre."""
    # The arrays move, not the exploded rows; later groupings start with the same keys.
    placed = spread(alignment.scripts, *alignment.keys)
    # An outer generator, since a plain one also filters on the script and so solves it twice.
    return placed.select(
        *alignment.keys, "hyp_index", "hypothesis_count", "member_ranks", F.inline_outer("script")
    ).where(F.col("slot").isNotNull())


def insertion_runs(alignment: Alignment) -> DataFrame:
    """Inserted symbols by slot: the number of centre tokens already consumed."""
    return (
        departures(alignment)
        .where(F.col("lane") != CENTRE_LANE)
        .select(*alignment.keys, F.explode("member_ranks").alias("hyp_index"), "slot", "lane", "symbol")
    )


def slot_widths(alignment: Alignment) -> DataFrame:
    """Width of every insertion slot in use: its longest run."""
    return (
        departures(alignment)
        .where(F.col("lane") != CENTRE_LANE)
        .groupBy(*alignment.keys, "slot")
        .agg((F.max("lane") + 1).alias("width"))
    )


def _splice(tokens: Column, points: Column) -> Column:
    """Centre tokens with ``points`` (sorted slot, lane, symbol) put in their places."""
    after = lambda point: point["slot"] + F.when(point["lane"] == CENTRE_LANE, 1).otherwise(0)

    def piece(point, index):
        start = F.when(index == 0, F.lit(0)).otherwise(after(F.get(points, index - 1)))
        return F.concat(F.slice(tokens, start + 1, point["slot"] - start), F.array(point["symbol"]))

    last = F.coalesce(after(F.try_element_at(points, F.lit(-1))), F.lit(0))
    tail = F.slice(tokens, last + 1, F.greatest(F.size(tokens) - last, F.lit(0)))
    return F.concat(F.flatten(F.transform(points, piece)), tail)


def _point(slot: Column, lane: Column, symbol: Column) -> Column:
    return F.named_struct(F.lit("slot"), slot, F.lit("lane"), lane, F.lit("symbol"), symbol)


def _points(script: Column) -> Column:
    return F.transform(script, lambda e: _point(e["slot"], e["lane"], e["symbol"]))


def pair_alignments(alignment: Alignment) -> DataFrame:
    """Centre row and other row of each pairwise alignment; NULL is a gap.

    Members with the centre's own text are aligned with it symbol by symbol.
    """
    keys = list(alignment.keys)
    # An outer generator for the same reason as in ``_scripts``.
    placed = alignment.units.select(*keys, "centre_index", "centre_text", F.explode_outer("readings").alias("reading")).where(
        F.col("reading.hyp_index").isNotNull()
    ).select(*keys, "centre_index", "centre_text", "reading.member_ranks", "reading.script")
    tokens = char_tokens(F.col("centre_text"))
    inserted = F.transform(
        F.filter("script", lambda e: e["lane"] != CENTRE_LANE),
        lambda e: _point(e["slot"], e["lane"], F.lit(None).cast("string")),
    )
    others = placed.withColumn("tokens", tokens).select(
        *keys, "centre_index", F.explode("member_ranks").alias("hyp_index"),
        _splice(F.col("tokens"), inserted).alias("centre_symbols"),
        _splice(F.col("tokens"), _points(F.col("script"))).alias("other_symbols"),
    )
    copies = alignment.centres.select(
        *keys, "centre_index", F.explode(F.filter("centre_ranks", lambda r: r != F.col("centre_index"))).alias("hyp_index"),
        tokens.alias("centre_symbols"), tokens.alias("other_symbols"),
    )
    return others.unionByName(copies)


def aligned_rows(alignment: Alignment) -> DataFrame:
    """The alignment matrix, one row of symbols per member; NULL is a gap."""
    keys = list(alignment.keys)
    column_key = lambda e: F.shiftleft(e["slot"].cast("bigint"), 32) + e["lane"]
    inserted = lambda r: F.transform(F.filter(r["script"], lambda e: e["lane"] != CENTRE_LANE), column_key)
    gap_at = lambda key: _point(
        F.shiftright(key, 32).cast("int"),
        key.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"),
        F.lit(None).cast("string"),
    )
    script = alignment.scripts.schema["script"].dataType
    own = F.array(F.struct(F.col("centre_index").alias("hyp_index"), F.col("centre_ranks").alias("member_ranks"), F.array().cast(script).alias("script")))
    others = F.col("readings")
    missing = F.array_except("lanes", F.transform("reading.script", column_key))
    points = F.array_sort(F.concat(_points(F.col("reading.script")), F.transform(missing, gap_at)))
    return (
        alignment.units
        .withColumn("lanes", F.array_distinct(F.flatten(F.transform(others, inserted))))
        .select(*keys, "centre_index", "hypothesis_count", "centre_text", "lanes", F.explode(F.concat(own, others)).alias("reading"))
        .select(
            *keys, "centre_index", "hypothesis_count", F.col("reading.member_ranks").alias("member_ranks"),
            char_tokens(F.col("centre_text")).alias("tokens"), points.alias("points"),
        )
        .select(
            *keys, "centre_index", "hypothesis_count", F.explode("member_ranks").alias("hyp_index"),
            _splice(F.col("tokens"), F.col("points")).alias("symbols"),
        )
    )


def aligned_texts(alignment: Alignment, gap: str = "") -> DataFrame:
    """The rows of the alignment matrix as texts with ``gap`` at each gap, and the number of columns.

    The same rows as of ``aligned_rows``, without an array entry for each symbol.
    """
    keys = list(alignment.keys)
    ranks = F.concat(F.array("centre_ranks"), F.col("readings.member_ranks"))
    return (
        alignment.units
        .withColumn("aligned", aligned_text("centre_text", "readings.script", F.lit(gap)))
        .select(*keys, "centre_index", "hypothesis_count", ranks.alias("ranks"), F.col("aligned.columns").alias("columns"), F.posexplode("aligned.texts").alias("row_no", "row_text"))
        .select(*keys, "centre_index", "hypothesis_count", "columns", F.explode(F.get("ranks", F.col("row_no"))).alias("hyp_index"), "row_text")
    )


def alignment_columns(alignment: Alignment) -> DataFrame:
    """Long form of the matrix: one row per column and member."""
    return aligned_rows(alignment).select(
        *alignment.keys, "hyp_index", F.posexplode("symbols").alias("col_idx", "symbol")
    )


def consensus_entropy(alignment: Alignment, quorum: int = QUORUM) -> DataFrame:
    """Mean normalised entropy of a unit's columns; NULL below quorum or without columns."""
    return _with_entropy(alignment.units, alignment.keys, quorum)


def fused_with_entropy(alignment: Alignment, quorum: int = QUORUM) -> DataFrame:
    """``consensus_entropy`` and ``fused_texts`` in one row, so that the scripts are read once and need not be stored."""
    fused = alignment.units.withColumn("fused", fused_text("centre_text", F.col("hypothesis_count").cast("int"), "readings"))
    return _with_entropy(fused, alignment.keys, quorum, F.col("fused.tied_columns").alias("tied_columns"), F.col("fused.text").alias("fused_text"))


def _with_entropy(units: DataFrame, keys, quorum: int, *kept: Column) -> DataFrame:
    keys = list(keys)
    names = units.select(*kept).columns if kept else []
    # With n votes per symbol out of k, the entropy is ln k - sum(n ln n) / k.  The terms are added as
    # decimals and columns with equal votes are counted, their entropy taken times that count in a fixed
    # order: sums of doubles would depend on the order in which rows arrive.  Columns are counted by their
    # votes inside the unit's row, so that they need not become rows.
    added = lambda total, n: (total + (n * F.log(n)).cast("decimal(28,18)")).cast("decimal(37,18)")
    total_of = lambda kinds, name: F.aggregate(kinds, F.lit(0).cast("bigint"), lambda total, k: total + k[name])
    measured = F.transform(
        "kinds",
        lambda k: F.struct(
            F.aggregate(k["votes"], F.lit(0).cast("bigint"), lambda total, n: total + n).alias("departing"),
            F.aggregate(k["votes"], F.lit(0).cast("decimal(37,18)"), added).alias("weighted"),
            k["columns"].alias("columns"),
        ),
    )
    distinct = F.sort_array(F.array_distinct(F.transform("measured", lambda k: F.struct(k["departing"].alias("departing"), k["weighted"].alias("weighted")))))

    def entropy(kind):
        columns = total_of(F.filter("measured", lambda k: (k["departing"] == kind["departing"]) & (k["weighted"] == kind["weighted"])), "columns")
        staying = F.col("members") - kind["departing"]
        weighted = kind["weighted"].cast("double") + staying * F.log(staying)
        return columns * ((F.log("members") - weighted / F.col("members")) / F.log("members"))

    return (
        units.select(
            *keys, "hypothesis_count", "centre_index", F.col("hypothesis_count").alias("members"), char_count(F.col("centre_text")).alias("centre_length"),
            vote_kinds("readings").alias("kinds"), *kept,
        )
        .withColumn("measured", measured)
        .withColumn("column_count", (F.col("centre_length") + total_of("kinds", "inserted")).cast("bigint"))
        .withColumn("entropy_sum", F.aggregate(distinct, F.lit(0.0), lambda total, k: total + entropy(k)))
        .select(
            *keys, "hypothesis_count", "centre_index", "column_count", total_of("kinds", "columns").alias("disputed_columns"),
            F.when((F.col("hypothesis_count") >= quorum) & (F.col("column_count") > 0), F.col("entropy_sum") / F.col("column_count")).alias("consensus_entropy"),
            *names,
        )
    )


def fusion_columns(alignment: Alignment) -> DataFrame:
    """Votes of every disputed column: candidates in first-seen order, winner, tie, emitted.

    Columns that are not listed are unanimous for the centre's symbol.
    """
    keys = list(alignment.keys)
    votes = (
        departures(alignment)
        .groupBy(*keys, "slot", "lane", "symbol")
        .agg(
            F.min(F.col("member_ranks")[0]).alias("first_index"),
            F.sort_array(F.flatten(F.collect_list("member_ranks"))).alias("supporters"),
            F.max("centre_symbol").alias("centre_symbol"),
            F.max("hypothesis_count").alias("hypothesis_count"),
        )
    )
    candidate = F.struct(
        F.col("first_index"), F.col("symbol"), F.size("supporters").alias("votes"), F.col("supporters")
    )
    grouped = votes.groupBy(*keys, "slot", "lane").agg(
        F.collect_list(candidate).alias("departing"),
        F.max("centre_symbol").alias("centre_symbol"),
        F.max("hypothesis_count").alias("hypothesis_count"),
    )
    everyone = F.sequence(F.lit(0), F.col("hypothesis_count") - 1)
    staying = F.array_except(everyone, F.flatten(F.transform("departing", lambda c: c["supporters"])))
    stayers = F.struct(
        F.col("staying")[0].alias("first_index"), F.col("centre_symbol").alias("symbol"),
        F.size("staying").alias("votes"), F.col("staying").alias("supporters"),
    )
    candidates = F.array_sort(F.concat("departing", F.array(stayers)))
    top = F.array_max(F.transform("candidates", lambda c: c["votes"]))
    leaders = F.filter("candidates", lambda c: c["votes"] == top)
    return (
        grouped.withColumn("staying", staying)
        .withColumn("candidates", candidates)
        .withColumn("leaders", leaders)
        .select(
            *keys, "slot", "lane", "candidates",
            F.col("leaders")[0]["symbol"].alias("winning_symbol"),
            (F.size("leaders") > 1).alias("tie"),
            F.col("leaders")[0]["symbol"].isNotNull().alias("emitted"),
        )
    )


def all_fusion_columns(alignment: Alignment) -> DataFrame:
    """As ``fusion_columns`` with the unanimous columns too: one row per column of the matrix."""
    keys = list(alignment.keys)
    disputed = fusion_columns(alignment)
    settled = disputed.where(F.col("lane") == CENTRE_LANE).select(*keys, "slot")
    everyone = F.sequence(F.lit(0), F.col("hypothesis_count") - 1)
    candidate = F.struct(
        F.lit(0).alias("first_index"), F.col("symbol"), F.col("hypothesis_count").cast("int").alias("votes"), everyone.alias("supporters")
    )
    unanimous = (
        alignment.centres.select(*keys, "hypothesis_count", F.posexplode(char_tokens(F.col("centre_text"))).alias("slot", "symbol"))
        .join(settled, [*keys, "slot"], "left_anti")
        .select(
            *keys, "slot", F.lit(CENTRE_LANE).alias("lane"), F.array(candidate).alias("candidates"),
            F.col("symbol").alias("winning_symbol"), F.lit(False).alias("tie"), F.lit(True).alias("emitted"),
        )
    )
    return disputed.unionByName(unanimous)


def indexed_columns(columns: DataFrame, keys=KEYS) -> DataFrame:
    """Add each listed column's index in the full alignment matrix."""
    so_far = Window.partitionBy(*keys).orderBy("slot", "lane").rowsBetween(Window.unboundedPreceding, -1)
    inserted = F.coalesce(F.sum((F.col("lane") != CENTRE_LANE).cast("int")).over(so_far), F.lit(0))
    return columns.withColumn("col_idx", (F.col("slot") + inserted).cast("int"))


def fused_texts(alignment: Alignment) -> DataFrame:
    """Equal-vote fusion: the modal symbol of each column, the earliest member on a tie.

    The same votes as in ``fusion_columns``, counted inside a unit's row, since only their winners are needed.
    """
    keys = list(alignment.keys)
    return (
        alignment.units
        .withColumn("fused", fused_text("centre_text", F.col("hypothesis_count").cast("int"), "readings"))
        .select(
            *keys, "hypothesis_count", "centre_index", F.col("fused.tied_columns").alias("tied_columns"),
            F.col("fused.text").alias("fused_text"),
        )
    )


def consensus_records(alignment: Alignment, artifacts: DataFrame, artifact_root: str, created_at: str, quorum: int = QUORUM):
    """Sealed consensus results and fused hypotheses; both name the same artifact.

    Units without an artifact (``artifacts`` are header rows) are refused ones and get neither.
    """
    keys = list(alignment.keys)
    eligible = alignment.members.groupBy(*keys).agg(
        F.sort_array(F.collect_list("page_model_result_id")).alias("eligible_page_model_result_ids")
    )
    digest = F.col("alignment_artifact_sha256")
    # Both records take from one pass over the scripts.
    solved = stored(fused_with_entropy(alignment, quorum))
    consensus = seal(
        solved.drop("fused_text", "tied_columns")
        .join(artifacts.select(*keys, "alignment_artifact_sha256"), keys)
        .join(eligible, keys)
        .select(
            *keys, "eligible_page_model_result_ids", F.lit(quorum).alias("quorum_size"),
            F.col("hypothesis_count").alias("eligible_hypothesis_count"), "consensus_entropy",
            "alignment_artifact_sha256",
            F.concat(F.lit(artifact_root.rstrip("/") + "#"), digest).alias("alignment_artifact_uri"),
            F.lit(TEXT_POLICY_ID).alias("text_policy_id"),
            F.lit(ALIGNMENT_POLICY_ID).alias("alignment_policy_id"),
            F.lit(created_at).alias("created_at"),
        ),
        "consensus_result",
    )
    fused = seal(
        solved.select(*keys, F.col("fused_text").alias("text"))
        .join(
            consensus.select(*keys, "consensus_result_id", "alignment_artifact_sha256", "alignment_artifact_uri"), keys
        )
        .withColumns({"fusion_policy_id": F.lit(FUSION_POLICY_ID), "created_at": F.lit(created_at)}),
        "fused_hypothesis",
    )
    return consensus, fused
