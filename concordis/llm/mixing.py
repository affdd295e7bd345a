"""Mixing sources to target weights, with DataFrame functions only.

The words of each source form one stream, documents in id order, cut into blocks of
``block_words``.  A source's target is its weight's share of ``ratio`` times all words, at most
``limit`` times its own size; what is cut off goes to the others by weight until none is above.
The target in words gives the source's number of slots: whole passes over its blocks, then a part
of one more pass whose last slot is shortened to meet the target.

Each slot draws its output shard, all shards being equally likely.  The counts drawn per shard and source are
multinomial, given that each source's total meets its target exactly.  A shard's slots of a source are then
numbered consecutively, and slot numbers are mapped to blocks by one pseudorandom permutation of
the block indexes per source and pass (the rank of a keyed hash), joined by index.

No row holds more than a block, ranks and running sums are taken by ranges
(``common.numbered``), and a source holding a third of all words is spread like any other.

Cases: null and blank texts have size 0 and are never taken; a null source is a source of its own,
last in order; repeated rows are mixed as rows of their own; a source without words has target 0; an empty table gives no rows.
Other columns are ignored, except by ``mixed_documents``, which returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordis.llm.common import DOCUMENT_COLUMNS, WORD, numbered, saved, table, whole

WEIGHTS = (5, 2, 1)
RATIO = 1.5
LIMIT = 2
BLOCK_WORDS = 256
BLANK = "[\\x20\\x09-\\x0D]*"
SHARD_SLOTS = 4096
TASK_ROWS, MOST_TASKS = 200_000, 20_000
SEED = 20250101

#: A source as two columns that are never null; the null source comes last.
SOURCE = ("no_source", "source_name")


def _source_columns(docs: DataFrame) -> DataFrame:
    return docs.withColumns(
        {"no_source": F.col("source").isNull(), "source_name": whole(F.col("source"))}
    )


def sized(docs: DataFrame) -> DataFrame:
    """Every row's size in words and its place in its source's stream of words; stored."""
    narrow = saved(
        _source_columns(docs).select(
            F.col("doc_id").cast("long").alias("doc_id"), *SOURCE, F.xxhash64("text").alias("text_hash"),
            F.regexp_count(whole(F.col("text")), F.lit(WORD)).cast("long").alias("size"),
        ),
        "sizes",
    )
    return saved(
        numbered(narrow, ("doc_id", "text_hash"), SOURCE, ("size",)).withColumnRenamed("size_before", "first_word"),
        "streams",
    )


def targets(rows: DataFrame, weights=WEIGHTS, ratio: float = RATIO, limit: float = LIMIT) -> DataFrame:
    """One row per source: its size and its target.

    In order of (limit * size / weight) the sources that stop at their limit come first: one
    stops when its share of what the ones before it leave is at least its limit.
    """
    sources = rows.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(*SOURCE)) - 1
    everything = Window.partitionBy()
    before = Window.orderBy("fill", *SOURCE).rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        sources.withColumn("weight", F.get(cycle, F.pmod(rank, F.lit(len(weights)))))
        .withColumn("most", F.col("source_size") * float(limit))
        .withColumn("fill", F.col("most") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(everything) * ratio)
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("words_left", F.col("wanted") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("stops", F.col("fill") * F.col("weight_left") <= F.col("words_left"))
    )
    free_weight = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything)
    free_words = F.col("wanted") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("most"))).over(everything), F.lit(0.0))
    return filled.select(
        *SOURCE, "source_size",
        F.when(F.col("stops"), F.col("most")).otherwise(free_words * F.col("weight") / free_weight).alias("target"),
    )


def _place(pass_no, block, seed: int):
    """The keyed hash whose order is that of a source's blocks in one pass."""
    return F.xxhash64(F.lit(seed), F.lit("order"), *SOURCE, pass_no, block)


def plan_slots(sources: DataFrame, block_words: int, seed: int = SEED) -> DataFrame:
    """Blocks, whole passes and slots of each source with words.

    The partial pass ends where the real lengths of its blocks, in their order, reach the rest; only
    the source's last block is shorter than others, so its rank in that pass decides.
    """
    wanted = F.round("target").cast("long")
    plans = (
        sources.where(F.col("source_size") > 0)
        .withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
        .withColumn("passes", F.floor(wanted / F.col("source_size")).cast("long"))
        .withColumn("rest", wanted - F.col("passes") * F.col("source_size"))
    )
    own, short = _place(F.col("passes"), F.col("block"), seed), _place(F.col("passes"), F.col("blocks") - 1, seed)
    earlier = (own < short) | ((own == short) & (F.col("block") < F.col("blocks") - 1))
    total = plans.agg(F.sum("blocks")).first()[0]
    ranks = _counted(plans, "blocks", "block", total).groupBy(*SOURCE).agg(F.count_if(earlier).alias("short_rank"))
    lacking = F.col("blocks") * block_words - F.col("source_size")
    full = F.ceil(F.col("rest") / block_words).cast("long")
    most = F.ceil((F.col("rest") + lacking) / block_words).cast("long")
    return (
        plans.join(ranks, list(SOURCE))
        .withColumn("part", F.when(F.col("short_rank") < full, most).otherwise(full))
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.col("part"))
        .withColumn("missing", F.when(F.col("short_rank") < F.col("part") - 1, lacking).otherwise(F.lit(0)))
        .withColumn("last_words", F.col("rest") - (F.col("part") - 1) * block_words + F.col("missing"))
        .drop("short_rank", "part", "missing")
    )


def _counted(sources: DataFrame, count: str, name: str, total: int | None) -> DataFrame:
    """Rows 0 to count-1 of each source, dealt out in runs so that no row lists more than 10,000.

    The runs are few and short, so the number of tasks is stated: one for every ``TASK_ROWS`` of all ``total`` rows.
    """
    run, tasks = 10_000, max(1, min(-(-(total or 0) // TASK_ROWS), MOST_TASKS))
    runs = sources.where(F.col(count) > 0).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / run))).alias("run_no")
    )
    ends = F.least((F.col("run_no") + 1) * run, F.col(count)) - 1
    return runs.repartition(tasks, *SOURCE, "run_no").select("*", F.explode(F.sequence(F.col("run_no") * run, ends)).alias(name)).drop("run_no")


def draw_counts(plans: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """Multinomial counts: slots of each source in each shard, with the first slot's number."""
    shards = F.greatest(F.lit(1), F.ceil(F.sum("slots").over(Window.partitionBy()) / shard_slots)).cast("long")
    total = plans.agg(F.sum("slots")).first()[0]
    drawn = _counted(plans.select(*SOURCE, "slots", shards.alias("shards")), "slots", "draw", total)
    shard = F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), *SOURCE, "draw"), F.col("shards"))
    counts = drawn.groupBy(*SOURCE, shard.alias("shard")).agg(F.count(F.lit(1)).alias("slot_count"))
    # The shards of one source are few: one for every ``shard_slots`` slots of the output.
    before = Window.partitionBy(*SOURCE).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first_slot", F.coalesce(F.sum("slot_count").over(before), F.lit(0)))


def assign_blocks(plans: DataFrame, counts: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Every slot's shard, pass, block and number of words taken from the block's front."""
    passes = plans.withColumn("all_passes", F.ceil(F.col("slots") / F.col("blocks")).cast("long"))
    sizes = plans.agg(F.sum("blocks"), F.sum("slots")).first()
    blocks = _counted(passes, "blocks", "block", sizes[0]).select(
        *SOURCE, "blocks", "slots", "last_words", "block",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("all_passes") - 1)).alias("pass_no"),
    )
    keyed = blocks.withColumn("place", _place(F.col("pass_no"), F.col("block"), seed))
    ranked = numbered(keyed, ("place", "block"), (*SOURCE, "pass_no")).select(
        *SOURCE, "block", "pass_no", (F.col("pass_no") * F.col("blocks") + F.col("row_no")).alias("slot"),
        F.when(F.col("pass_no") * F.col("blocks") + F.col("row_no") == F.col("slots") - 1, F.col("last_words"))
        .otherwise(F.lit(block_words)).alias("block_limit"),
    )
    slots = _counted(counts, "slot_count", "at", sizes[1]).select(*SOURCE, "shard", (F.col("first_slot") + F.col("at")).alias("slot"))
    # Both sides are as long as the output, whatever a planner makes of the few rows they spring from.
    return ranked.join(slots.hint("merge"), [*SOURCE, "slot"])


def mix(docs: DataFrame, weights=WEIGHTS, ratio=RATIO, limit=LIMIT, block_words=BLOCK_WORDS, shard_slots=SHARD_SLOTS, seed=SEED):
    """(rows, sources, pieces): sized rows, targets, and what each slot takes of which row.

    A piece is words ``from_word`` to ``from_word + words - 1`` of a row (``row_no`` of its source).
    """
    rows = sized(docs)
    sources = saved(targets(rows, weights, ratio, limit), "targets")
    plans = saved(plan_slots(sources, block_words, seed), "plans")
    taken = assign_blocks(plans, draw_counts(plans, shard_slots, seed), block_words, seed)
    last = F.floor((F.col("first_word") + F.col("size") - 1) / block_words)
    parts = rows.where(F.col("size") > 0).select(
        *SOURCE, "doc_id", "text_hash", "row_no", "size", "first_word",
        F.explode(F.sequence(F.floor(F.col("first_word") / block_words), last)).alias("block"),
    )
    start = F.greatest(F.col("first_word"), F.col("block") * block_words)
    end = F.least(F.col("first_word") + F.col("size"), F.col("block") * block_words + F.col("block_limit"))
    pieces = (
        parts.join(taken.hint("merge"), [*SOURCE, "block"])
        .select(
            *SOURCE, "doc_id", "text_hash", "row_no", "size", "shard", "slot", "pass_no", "block",
            (start - F.col("first_word")).alias("from_word"), (end - start).alias("words"),
        )
        .where(F.col("words") > 0)
    )
    return rows, sources, pieces


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents: one row for each pass in which words of a row were taken.

    A row taken whole keeps its text; of others the taken words are kept, in order, each with the white space after
    it, but for the last one's.  Neighbouring words stay as they stood.
    """
    _, _, pieces = mix(docs, **options)
    key = ("doc_id", "text_hash", *SOURCE)
    takes = (
        pieces.groupBy(*key, "row_no", "pass_no")
        .agg(
            F.sort_array(F.collect_list(F.struct("from_word", "words"))).alias("ranges"),
            (F.sum("words") == F.max("size")).alias("complete"),
        )
        .groupBy(*key)
        .agg(F.collect_list(F.struct("ranges", "complete")).alias("takes"))
    )
    columns = [F.col(c) for c in DOCUMENT_COLUMNS]
    keyed = _source_columns(docs.select(*columns)).withColumn("text_hash", F.xxhash64("text"))
    # Repeated rows are listed together in ``takes``.
    once = keyed.withColumn("copy_no", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))).where("copy_no = 1")
    same = F.lit(True)
    renamed = takes.select(*[F.col(c).alias(f"taken_{c}") for c in key], "takes")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"taken_{c}"))
    exploded = once.join(renamed, same).select(*columns, F.explode("takes").alias("take"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD}{BLANK})"), F.lit(1))
    parts = F.flatten(F.transform("take.ranges", lambda r: F.slice(words, (r["from_word"] + 1).cast("int"), r["words"].cast("int"))))
    cut = F.rtrim(F.array_join(parts, ""), F.lit(" \t\n\x0b\f\r"))
    out = exploded.withColumn("text", F.when(F.col("take.complete"), F.col("text")).otherwise(cut))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sources, pieces = mix(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy(*SOURCE, "row_no").agg(F.sum("words").alias("taken"))
    return (
        rows.join(taken, [*SOURCE, "row_no"], "left")
        .join(sources, list(SOURCE))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    )
