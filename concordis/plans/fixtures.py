"""Inputs derived from the given tables.

Every fixture covers its whole source tables and whole texts.  Hypotheses are the texts
with systematic misreadings.  Runs are the text's language or role, so one run holds
well over a third of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordis.functions.identity import attempt_id, seal
from concordis.operators import ground_truth, manifest
from concordis.schemas import ATTEMPT_EVENTS
from concordis.sources import corpus
from concordis.sources.stores import stored

CREATED_AT = "2026-01-01T00:00:00Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def replaced(column, old: str, new: str) -> Column:
    return F.replace(_text(column), F.lit(old), F.lit(new))


# -- texts and hypotheses ------------------------------------------------------------


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("run-"), "lang").alias("run_manifest_id"),
        F.concat(F.lit("unit-"), "doc_id").alias("evaluation_unit_id"),
        "doc_id", "text", "lang", "source", "n_chars",
    )


def turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("run-"), "role").alias("run_manifest_id"),
        F.concat(F.lit("unit-"), "conv_id", F.lit("-"), "turn").alias("evaluation_unit_id"),
        "conv_id", "turn", "role", "text",
    )


def _hypotheses(units: DataFrame, *texts: Column, kept: tuple[str, ...] = ()) -> DataFrame:
    """One row per unit and reading; ``kept`` names columns of the units that go along."""
    return units.select(
        "run_manifest_id", "evaluation_unit_id", *kept, F.posexplode(F.array(*texts)).alias("position", "text")
    ).select(
        "run_manifest_id", "evaluation_unit_id",
        F.concat(F.lit("result-"), "evaluation_unit_id", F.lit("-"), "position").alias("page_model_result_id"),
        "position", "text", *kept,
    )


def misread(units: DataFrame) -> DataFrame:
    """Members that insert, drop and substitute characters."""
    return _hypotheses(
        units, replaced("text", "th", "tli"), replaced("text", "on", "o"), F.translate("text", "ou", "#~")
    )


def substituted(units: DataFrame) -> DataFrame:
    """Members that only substitute, so alignment columns are character positions."""
    return _hypotheses(
        units, F.translate("text", "a", "@"), F.translate("text", "ai", "@!"), F.translate("text", "n", "#")
    )


#: Symbols that no given text holds: two that are inserted, two that are substituted.
INSERTED, REPLACING = ("\ue000", "\ue001"), ("\ue002", "\ue003")


def varied(units: DataFrame, kind: Column) -> DataFrame:
    """Two to five members by kind of unit: insertions, deletions, copies, two-way and three-way ties.

    Inserted and substituted symbols occur nowhere else and deleted ones are deleted throughout, so
    every pair with the centre has a single best alignment.
    """
    text = F.col("text")
    first, both = (replaced("text", "o", "o" + "".join(INSERTED[:n])) for n in (1, 2))
    gone = replaced("text", "a", "")
    members = (
        F.when(kind == 0, F.array(text, first, both, gone))
        .when(kind == 1, F.array(text, F.translate("text", "e", REPLACING[0]), F.translate("text", "e", REPLACING[1])))
        .when(kind == 2, F.array(text, gone))
        .otherwise(F.array(text, first, first, first, gone))
    )
    return units.select("run_manifest_id", "evaluation_unit_id", F.posexplode(members).alias("position", "text")).select(
        "run_manifest_id", "evaluation_unit_id",
        F.concat(F.lit("result-"), "evaluation_unit_id", F.lit("-"), "position").alias("page_model_result_id"),
        "position", "text",
    )


def varied_documents(spark, sf_dir) -> DataFrame:
    return varied(documents(spark, sf_dir), F.pmod("doc_id", F.lit(4)))


def varied_turns(spark, sf_dir) -> DataFrame:
    return varied(turns(spark, sf_dir), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)))


_RUN_SETTINGS = (
    "schema_version", "dataset_id", "dataset_version", "dataset_split_id", "config_snapshot_sha256", "taxonomy_registry_id",
    "assessment_policy_id", "alignment_policy_id", "eligibility_policy_id", "fusion_policy_id", "metric_policy_id", "anomaly_policy_id",
    "analysis_policy_id", "contamination_register_id", "pricing_registry_snapshot_id", "model_registry_snapshot_id",
)


def evaluation_inputs(spark, sf_dir) -> dict[str, DataFrame]:
    """Sealed inputs and journals of one run over all documents with five members.

    The members read what ``varied`` gives; those that a unit lacks were never dispatched.  The
    approved ground truth is the document's own text.  Units name their document in ``doc_id`` of ``named``.
    """
    text = lambda value: F.lit(value).cast("string")
    settings = {"dataset_id": "documents", "dataset_version": "1", "language": "en"}
    docs = documents(spark, sf_dir).select("doc_id", "text")
    item = F.concat(F.lit("D-COMP/"), F.col("doc_id").cast("string"), F.lit(".png"))
    header = F.unhex(F.lit("89504E470D0A1A0A0000000D4948445200000010000000200802000000"))
    content = F.concat(header, F.encode("text", "UTF-8"))
    files = docs.select(
        F.concat(F.lit("file:/c/"), item).alias("path"), item.alias("dataset_item_id"), content.alias("content"),
        F.length(content).cast("long").alias("length"),
    )
    pages = stored(corpus.source_pages(files, settings))
    units = stored(corpus.evaluation_units(pages, settings))
    variants = stored(corpus.input_variants(pages, units, corpus.decode_provenances(pages, "source", "1")))
    roster = manifest.roster_members(
        spark.range(5).select(
            F.lit("run").alias("run_key"), F.col("id").cast("int").alias("position"), F.lit("e").alias("registry_entry_id"),
            F.lit("member-model").alias("exact_model_id"), F.lit("local").alias("provider"), text(None).alias("router"),
            F.lit("account").alias("billing_account_id"), F.lit("adapter").alias("adapter_id"), F.lit("1").alias("adapter_version"),
            F.concat(F.lit("prompt-"), "id").alias("prompt_template_id"), F.lit("1" * 64).alias("prompt_sha256"),
            F.create_map().cast("map<string,string>").alias("hyperparameters"),
        )
    )
    in_key = lambda df: df.withColumn("run_key", F.lit("run"))
    run_settings = spark.range(1).select(F.lit("run").alias("run_key")).withColumns(
        {
            **{c: text(c) for c in _RUN_SETTINGS}, "created_at": text(CREATED_AT), "corpus_evidence_kind": text("natural"),
            "split_role": text("diagnostic"), "calibration_selection_id": text(None), "budget_policy": F.create_map(F.lit("run_ceiling_usd"), F.lit("1.00")),
            "model_corpus_match": F.lit(False), "model_corpus_match_policy_id": text(None), "human_override_ids": F.array().cast("array<string>"),
        }
    )
    run_units = in_key(variants).select("run_key", "evaluation_unit_id", "page_input_variant_id")
    manifests = stored(manifest.run_manifests(run_settings, run_units, roster))
    run_id = F.lit(manifests.head().run_manifest_id)
    in_run = lambda df: df.withColumn("run_manifest_id", run_id)
    intents = stored(manifest.dispatch_intents(in_run(variants), in_run(roster)))
    named = stored(
        units.join(pages.select("source_page_id", "dataset_item_id"), "source_page_id").select(
            "evaluation_unit_id", F.regexp_extract("dataset_item_id", "([0-9]+)", 1).cast("long").alias("doc_id")
        )
    )
    read = varied(
        docs.join(named, "doc_id").withColumn("run_manifest_id", run_id), F.pmod("doc_id", F.lit(4))
    ).select("evaluation_unit_id", F.col("position").alias("ordinal"), "text")
    tried = intents.join(read, ["evaluation_unit_id", "ordinal"])
    number, aid = F.xxhash64("dispatch_intent_id"), attempt_id(F.col("dispatch_intent_id"), F.lit(1))
    started = tried.select(
        "run_manifest_id", F.lit("attempt_started").alias("event_type"), "dispatch_intent_id", F.lit(1).alias("attempt_number"),
        aid.alias("attempt_id"), number.alias("journal_seq"),
    )
    parsed = F.struct(
        F.lit("transcription").alias("kind"), F.col("text"), F.lit("p").alias("parser_version"), F.lit(True).alias("complete")
    )
    finished = tried.select(
        "run_manifest_id", F.lit("attempt_finished").alias("event_type"), aid.alias("attempt_id"), (number + 1).alias("journal_seq"),
        F.lit("response_received").alias("outcome"), parsed.alias("parsed_output"), F.lit(5.0).alias("measured_duration_ms"),
        F.struct(F.lit("reported").alias("availability"), F.lit("0.005").cast("decimal(18,6)").alias("value")).alias("actual_cost_usd"),
    )
    events = spark.createDataFrame([], ATTEMPT_EVENTS).withColumn("run_manifest_id", text(None))
    events = events.unionByName(started, allowMissingColumns=True).unionByName(finished, allowMissingColumns=True)
    claims = stored(
        seal(
            named.join(docs, "doc_id").select(
                "evaluation_unit_id", F.lit("gold_full").alias("role"), F.lit("transcribable").alias("target_state"), "text",
                F.lit("g").alias("guideline_id"), F.lit("s").alias("source"), F.lit("one").alias("author_actor_id"), F.lit(CREATED_AT).alias("created_at"),
                text(None).alias("source_artifact_sha256"),
            ),
            "ground_truth_assertion",
        )
    )
    actions = claims.select("assertion_id", F.posexplode(F.array(F.lit("submit"), F.lit("approve"))).alias("sequence", "action")).select(
        "assertion_id", "sequence", "action", F.when(F.col("action") == "submit", "one").otherwise("two").alias("actor_id"),
        F.lit("human_workflow").alias("event_source"), text(None).alias("approval_authorization_id"), text(None).alias("reason"),
        text(None).alias("superseded_by_assertion_id"), F.lit(CREATED_AT).alias("created_at"),
    )
    return {
        "manifests": manifests, "pages": pages, "units": units, "variants": in_run(variants), "roster": in_run(roster), "intents": intents,
        "attempt_events": events, "assertions": in_run(claims), "gt_events": ground_truth.append_chains(actions), "named": named,
    }


def scored_texts(units: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Members whose edit counts have a closed form at character and word level."""
    return _hypotheses(
        units, F.translate("text", "ou", "#~"), F.translate("text", "e", "3"), replaced("text", "th", "tli"), kept=kept
    )


# -- attempt journal -----------------------------------------------------------------


def journal_events(spark, sf_dir) -> DataFrame:
    """Starts and finishes from ``events``, plus refusals for the idle system turns."""
    kind, number = F.col("event_type"), F.col("event_id")
    base = table(spark, sf_dir, "events").select(
        "event_id", "ts", kind, F.col("value"),
        F.concat(F.lit("intent-"), "user_id", F.lit("-"), F.to_date("ts").cast("string")).alias("dispatch_intent_id"),
        (F.floor(F.hour("ts") / 6) + 1).cast("int").alias("attempt_number"),
    ).withColumn("attempt_id", attempt_id(F.col("dispatch_intent_id"), F.col("attempt_number")))
    starts = base.select(
        (number * 2).alias("journal_seq"), F.lit("attempt_started").alias("event_type"),
        "dispatch_intent_id", "attempt_id", "attempt_number", F.col("ts").alias("event_ts"),
    )
    outcome = (
        F.when(kind == "purchase", "response_received")
        .when(kind == "click", "rate_limited")
        .when(kind == "view", F.when(F.pmod(number, F.lit(2)) == 0, "timeout").otherwise("transport_error"))
        .when(F.pmod(number, F.lit(4)) == 0, "content_filtered")
        .when(F.pmod(number, F.lit(4)) == 1, "cancelled")
        .when(F.pmod(number, F.lit(4)) == 2, "provider_rejected")
        .otherwise("response_received")
    )
    read = kind == "purchase"
    parsed_kind = F.when(read, "transcription").otherwise(
        F.when(F.pmod(number, F.lit(8)) == 3, "whole_unit_abstention").otherwise("parse_failure")
    )
    parsed = F.when(
        outcome == "response_received",
        F.struct(
            parsed_kind.alias("kind"),
            F.when(read, F.concat(F.lit("text "), number.cast("string"))).alias("text"),
            F.lit("parser_v1").alias("parser_version"),
            (~read | (F.pmod(number, F.lit(5)) != 0)).alias("complete"),
        ),
    )
    reported = kind != "view"
    cost = F.struct(
        F.when(reported, "reported").otherwise("unknown").alias("availability"),
        F.when(reported, F.round(F.col("value") * 100).cast("decimal(18,6)") / 10000).cast("decimal(18,6)").alias("value"),
    )
    finishes = base.where(kind != "signup").select(
        (number * 2 + 1).alias("journal_seq"), F.lit("attempt_finished").alias("event_type"), "attempt_id",
        outcome.alias("outcome"), parsed.alias("parsed_output"), cost.alias("actual_cost_usd"),
        F.round(F.col("value") * 10).alias("measured_duration_ms"),
        (F.col("ts") + F.expr("interval 90 seconds")).alias("event_ts"),
    )
    refusals = idle_turns(spark, sf_dir).where(F.col("role") == "system").select(
        F.lit("dispatch_refused").alias("event_type"), F.lit(-1).cast("bigint").alias("journal_seq"),
        "dispatch_intent_id", F.lit("no headroom").alias("reason"),
    )
    return starts.unionByName(finishes, allowMissingColumns=True).unionByName(refusals, allowMissingColumns=True)


def idle_turns(spark, sf_dir) -> DataFrame:
    return turns(spark, sf_dir).select(
        "role", F.concat(F.lit("intent-"), "evaluation_unit_id").alias("dispatch_intent_id")
    )


def journal_intents(spark, sf_dir) -> DataFrame:
    """One intent per user and day, plus intents that the journal never contacts."""
    busy = table(spark, sf_dir, "events").select(
        F.concat(F.lit("intent-"), "user_id", F.lit("-"), F.to_date("ts").cast("string")).alias("dispatch_intent_id")
    ).distinct()
    every = busy.unionByName(idle_turns(spark, sf_dir).select("dispatch_intent_id"))
    tail = F.substring("dispatch_intent_id", 8, 2147483647)
    return every.select(
        "dispatch_intent_id", F.lit("run-journal").alias("run_manifest_id"),
        F.concat(F.lit("variant-"), tail).alias("page_input_variant_id"),
        F.concat(F.lit("unit-"), tail).alias("evaluation_unit_id"),
        F.lit("member-0").alias("roster_member_config_id"),
        F.concat(F.lit("pair-"), tail).alias("dispatch_pair_id"),
        F.lit(0).alias("ordinal"), F.lit(4).alias("planned_max_attempts"),
    )


# -- ledgers -------------------------------------------------------------------------


def _orders(spark, sf_dir) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,6)").alias("amount_usd")
    ).join(customer, "o_custkey")


def ledger_names() -> Column:
    return F.array(F.concat(F.lit("nation-"), "c_nationkey"), F.lit("run"))


def ledger_events(spark, sf_dir) -> DataFrame:
    """Reserve per order; close 50 orders later: release, charge, or charge too much."""
    key = F.col("o_orderkey")
    opened = _orders(spark, sf_dir).select("*", F.explode(ledger_names()).alias("ledger"))
    reservation = F.concat(F.lit("reservation-"), key)
    reserve = opened.select(
        (key * 2).alias("seq"), "ledger", reservation.alias("reservation_id"), F.lit("reserve").alias("kind"), "amount_usd"
    )
    over = F.pmod(key, F.lit(97)) == 0
    charged = (F.col("amount_usd") * F.when(over, F.lit("1.2")).otherwise("0.9").cast("decimal(2,1)")).cast("decimal(18,6)")
    released = F.col("o_orderstatus") == "F"
    close = opened.select(
        ((key + 50) * 2 + 1).alias("seq"), "ledger", reservation.alias("reservation_id"),
        F.when(released, "release").otherwise("reconcile").alias("kind"),
        F.when(released, F.lit(0).cast("decimal(18,6)")).otherwise(charged).alias("amount_usd"),
    )
    # Pending orders are closed once more, and some closes name no reservation at all.
    again = opened.where(F.col("o_orderstatus") == "P").select(
        ((key + 90) * 2 + 1_000_000_001).alias("seq"), "ledger",
        F.when(over, F.concat(F.lit("lost-"), key)).otherwise(reservation).alias("reservation_id"),
        F.lit("release").alias("kind"), F.lit(0).cast("decimal(18,6)").alias("amount_usd"),
    )
    return reserve.unionByName(close).unionByName(again)


def ledgers(spark, sf_dir) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("nation-"), "n_nationkey").alias("ledger"),
        ((F.col("n_nationkey") + 1) * 1_000_000).cast("decimal(18,6)").alias("ceiling_usd"),
    )
    run = table(spark, sf_dir, "region").groupBy().agg(
        F.lit("run").alias("ledger"), F.lit(None).cast("decimal(18,6)").alias("ceiling_usd")
    )
    return nations.unionByName(run)


def reserve_requests(spark, sf_dir) -> DataFrame:
    """One batch per customer with all of its orders; one ledger it names is unknown."""
    return _orders(spark, sf_dir).select(
        F.concat(F.lit("batch-"), "o_custkey").alias("batch_id"), F.col("o_orderkey").cast("string").alias("label"),
        "amount_usd", F.array_append(ledger_names(), F.lit("unlisted")).alias("ledger_names"),
    )


# -- ground truth --------------------------------------------------------------------


def assertions(spark, sf_dir) -> DataFrame:
    """One assertion per document; Spanish and French documents have a second one.

    The Spanish second assertion has the same guideline, so both approved is a conflict.
    """
    labels = table(spark, sf_dir, "labels")
    docs = documents(spark, sf_dir).join(labels, "doc_id", "left")
    second = F.col("lang").isin("es", "fr")
    versions = docs.select(
        "*", F.explode(F.when(second, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("version")
    )
    illegible = (F.col("toxic") == 1) & (F.col("version") == "a")
    return versions.select(
        F.concat("version", F.lit("-"), "doc_id").alias("assertion_id"), "run_manifest_id", "evaluation_unit_id",
        F.lit("gold_full").alias("role"),
        F.when(illegible, "fully_illegible").otherwise("transcribable").alias("target_state"), "text",
        F.when((F.col("version") == "b") & (F.col("lang") == "fr"), "g2").otherwise("g1").alias("guideline_id"),
        F.lit("human").alias("source"), F.lit("annotator-1").alias("author_actor_id"),
        F.lit(CREATED_AT).alias("created_at"), F.lit(None).cast("string").alias("source_artifact_sha256"),
        "version", "quality", F.col("source").alias("doc_source"),
    )


def gt_actions(spark, sf_dir) -> DataFrame:
    """Submit, approve and, where the quality label is 0, reject."""
    rejected = (F.col("quality") == 0) & (F.col("version") == "a")
    steps = F.when(rejected, F.array(F.lit("submit"), F.lit("approve"), F.lit("reject"))).otherwise(
        F.array(F.lit("submit"), F.lit("approve"))
    )
    approve = F.col("action") == "approve"
    imported = F.col("doc_source").isin("src2", "src3")
    return (
        assertions(spark, sf_dir)
        .select("assertion_id", "doc_source", F.posexplode(steps).alias("sequence", "action"))
        .select(
            "assertion_id", F.col("sequence").cast("bigint").alias("sequence"), "action",
            F.when(approve & (F.col("doc_source") != "src1"), "annotator-2").otherwise("annotator-1").alias("actor_id"),
            F.when(imported, "dataset_import").otherwise("human_workflow").alias("event_source"),
            # src3 imports forget the authorization; src4 has one where none is allowed.
            F.when((approve & (F.col("doc_source") == "src2")) | (F.col("doc_source") == "src4"), "authorization-1")
            .alias("approval_authorization_id"),
            F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("superseded_by_assertion_id"),
            F.concat(F.lit("2026-01-0"), F.col("sequence") + 1).alias("created_at"),
        )
    )


def gt_events(spark, sf_dir) -> DataFrame:
    return gt_actions(spark, sf_dir).withColumn("event_id", F.concat("assertion_id", F.lit("/"), "sequence"))


def turn_actions(spark, sf_dir) -> DataFrame:
    """Chains from conversations: one per conversation, one event per turn."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("assertion-"), "conv_id").alias("assertion_id"), F.col("turn").alias("sequence"),
        F.when(F.col("role") == "user", "submit").when(F.col("role") == "assistant", "approve").otherwise("reject").alias("action"),
        F.col("role").alias("actor_id"), F.lit("human_workflow").alias("event_source"),
        F.lit(None).cast("string").alias("approval_authorization_id"), F.col("text").alias("reason"),
        F.lit(None).cast("string").alias("superseded_by_assertion_id"), F.lit(CREATED_AT).alias("created_at"),
    )


# -- stored runs with faults ---------------------------------------------------------


def _at(turn: int, position: int | None = None) -> Column:
    """Where a fault sits: in the user run, at one turn (and member) of every conversation."""
    place = (F.col("role") == "user") & (F.col("turn") == turn)
    return place if position is None else place & (F.col("position") == position)


def _both(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows once, and once more where the condition holds."""
    return rows.select("*", F.explode(F.when(condition, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def _members(spark, sf_dir) -> DataFrame:
    units = turns(spark, sf_dir)
    return substituted(units).join(units.drop("text", "run_manifest_id"), "evaluation_unit_id").withColumns(
        {
            "stored_run": F.col("run_manifest_id"),
            "tag": F.concat("evaluation_unit_id", F.lit("-"), "position"),
        }
    )


def stored_manifests(spark, sf_dir) -> DataFrame:
    return turns(spark, sf_dir).where(F.col("role") != "system").select("run_manifest_id").distinct()


def stored_intents(spark, sf_dir) -> DataFrame:
    return _both(_members(spark, sf_dir), _at(2, 0)).select(
        "stored_run", "run_manifest_id", "evaluation_unit_id", F.col("position").alias("ordinal"),
        F.concat(F.lit("intent-"), "tag").alias("dispatch_intent_id"), F.concat(F.lit("pair-"), "tag").alias("dispatch_pair_id"),
    )


def stored_results(spark, sf_dir) -> DataFrame:
    open_result, truncated = _at(0, 2), _at(4, 1)
    rows = _members(spark, sf_dir).where(~_at(2, 1))
    twice = _both(rows, _at(2, 2) | _at(4, 0))
    orphan = _at(4, 0) & (F.col("copy") == 1)
    other_run = F.when(_at(6, 2), F.lit("run-elsewhere")).otherwise(F.col("run_manifest_id"))
    return twice.select(
        "stored_run", other_run.alias("run_manifest_id"), "evaluation_unit_id",
        F.concat(F.when(orphan, "stray-").otherwise("result-"), "tag").alias("page_model_result_id"),
        F.concat(F.when(orphan, "stray-").otherwise("pair-"), "tag").alias("dispatch_pair_id"),
        F.concat(F.lit("intent-"), "tag").alias("dispatch_intent_id"),
        F.when(open_result, "indeterminate").when(truncated, "truncated").otherwise("success").alias("terminal_outcome"),
        F.when(~open_result, F.col("text")).alias("parsed_text"),
        F.when(~(_at(6, 0) | open_result), F.concat(F.lit("attempt-"), "tag")).alias("selected_attempt_id"),
    )


def stored_attempts(spark, sf_dir) -> DataFrame:
    number = F.when(_at(4, 2), 2).otherwise(1)
    true_id = attempt_id(F.col("dispatch_intent_id"), F.col("attempt_number"))
    return (
        _both(_members(spark, sf_dir), _at(6, 1))
        .withColumns({"dispatch_intent_id": F.concat(F.lit("intent-"), "tag"), "attempt_number": number})
        .select(
            "stored_run", F.lit("attempt_started").alias("event_type"), "dispatch_intent_id", "attempt_number",
            F.when(_at(4, 0), F.concat(F.lit("attempt-"), "tag")).otherwise(true_id).alias("attempt_id"),
            (((F.col("conv_id") * 1000 + F.col("turn")) * 10 + F.col("position")) * 2 + F.col("copy")).alias("journal_seq"),
        )
    )


def closed_form_entropy(text: Column) -> Column:
    """Entropy of the substitution-only members: a, i and n columns split two to one."""
    disputed = F.length(text) - F.length(F.translate(text, "ain", ""))
    share = (F.log(F.lit(3.0)) - F.lit(2.0) * F.log(F.lit(2.0)) / 3) / F.log(F.lit(3.0))
    return F.when(F.length(text) > 0, disputed * share / F.length(text))


def stored_consensus(spark, sf_dir) -> DataFrame:
    entropy = closed_form_entropy(F.col("text")) + F.when(
        (F.col("role") == "user") & (F.col("turn") == 6), 1e-6
    ).otherwise(0.0)
    ids = F.array(*[F.concat(F.lit("result-"), "evaluation_unit_id", F.lit(f"-{p}")) for p in range(3)])
    return turns(spark, sf_dir).select(
        F.col("run_manifest_id").alias("stored_run"), "run_manifest_id", "evaluation_unit_id",
        F.concat(F.lit("consensus-"), "evaluation_unit_id").alias("consensus_result_id"),
        ids.alias("eligible_page_model_result_ids"), entropy.alias("consensus_entropy"),
    )


def stored_observations(spark, sf_dir) -> DataFrame:
    blank = _at(2, 2)
    length = F.length("text")
    wrong = length - F.length(F.translate("text", "@!#", ""))
    members = _members(spark, sf_dir).select(
        "stored_run", "run_manifest_id", "evaluation_unit_id",
        F.concat(F.lit("observation-"), "tag").alias("benchmark_observation_id"),
        F.lit("page_model_result").alias("subject_kind"),
        F.concat(F.when(_at(4, 2), "nowhere-").otherwise("result-"), "tag").alias("subject_id"),
        F.when(blank, 0).otherwise(length).cast("bigint").alias("reference_length_chars"),
        F.when(blank, 1.0).otherwise(wrong / length).alias("cer"),
        F.when(~blank, F.lit(0)).cast("bigint").alias("char_insertions"),
        (wrong / length / 2).alias("wer"), F.lit(None).cast("double").alias("consensus_entropy"),
    )
    fused = stored_consensus(spark, sf_dir).select(
        "stored_run", "run_manifest_id", "evaluation_unit_id",
        F.concat(F.lit("observation-"), "evaluation_unit_id").alias("benchmark_observation_id"),
        F.lit("fused_hypothesis").alias("subject_kind"), F.concat(F.lit("fused-"), "evaluation_unit_id").alias("subject_id"),
        F.lit(None).cast("bigint").alias("reference_length_chars"), F.lit(None).cast("double").alias("cer"),
        F.lit(None).cast("bigint").alias("char_insertions"), F.lit(None).cast("double").alias("wer"), "consensus_entropy",
    )
    return members.unionByName(fused)


# -- corpus files --------------------------------------------------------------------


def corpus_files(spark, sf_dir) -> DataFrame:
    """Files as the scanner lists them: a PNG header followed by each page's source."""
    family = F.when(F.contains("url", F.lit("blog.")), "D-NEWS-AD").when(
        F.contains("url", F.lit("//m.")), "D-GEO"
    ).otherwise("misc")
    item = F.concat(family, F.lit("/"), F.regexp_replace("url", "^https?://", ""), F.lit(".png"))
    big = lambda n: F.lpad(F.hex(n), 8, "0")
    header = F.concat(
        F.lit("89504E470D0A1A0A0000000D49484452"), big(F.col("page_id") + 100), big(F.length("html")), F.lit("0802000000")
    )
    content = F.concat(F.unhex(header), F.encode("html", "UTF-8"))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("file:/corpus/"), item).alias("path"), item.alias("dataset_item_id"),
        content.alias("content"), F.length(content).cast("bigint").alias("length"),
    )


def photo_files(spark, sf_dir) -> DataFrame:
    """JPEG and TIFF files of either byte order: each page's url before the size, its source after it."""
    big = lambda n, size=4: F.lpad(F.hex(n), 2 * size, "0")
    little = lambda n, size=4: F.concat(*[F.substring(big(n, size), 2 * k + 1, 2) for k in range(size)][::-1])
    width, height = F.col("page_id") % 60000 + 100, F.length("html") % 60000 + 1
    url = F.hex(F.encode("url", "UTF-8"))
    before = F.octet_length("url")
    jpeg = F.concat(
        F.lit("FFD8FFE000104A46494600010100000100010000FFFFE1"), big(before + 2, 2), url,
        F.lit("FFC0001108"), big(height, 2), big(width, 2), F.lit("03012200021101031101"),
    )

    def tiff(mark, number):
        short = lambda tag, value: F.concat(number(F.lit(tag), 2), number(F.lit(3), 2), number(F.lit(1), 4), number(value, 2), F.lit("0000"))
        long = lambda tag, value: F.concat(number(F.lit(tag), 2), number(F.lit(4), 2), number(F.lit(1), 4), number(value, 4))
        return F.concat(
            F.lit(mark), number(before + 8, 4), url, number(F.lit(5), 2), long(256, width), long(257, height),
            short(258, F.lit(8)), short(262, F.lit(1)), short(277, F.lit(1)),
        )

    kind = F.col("page_id") % 3
    header = F.when(kind == 0, jpeg).when(kind == 1, tiff("49492A00", little)).otherwise(tiff("4D4D002A", big))
    item = F.concat(F.lit("D-GEO/"), F.col("page_id").cast("string"), F.when(kind == 0, ".JPG").otherwise(".tiff"))
    content = F.concat(F.unhex(header), F.encode("html", "UTF-8"))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("file:/corpus/"), item).alias("path"), item.alias("dataset_item_id"),
        content.alias("content"), F.length(content).cast("bigint").alias("length"),
    )


# -- a scored run over all documents -------------------------------------------------


def doc_manifests(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("run_manifest_id").distinct().withColumns(
        {
            "dataset_id": F.lit("documents"), "dataset_version": F.lit("v1"),
            "corpus_evidence_kind": F.lit("natural"), "split_role": F.lit("diagnostic"),
        }
    )


def doc_units(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select(
        "evaluation_unit_id", F.concat(F.lit("page-"), "doc_id").alias("source_page_id"),
        F.lit("in_scope_scored").alias("evaluation_scope_status"), F.lit("linear").alias("layout_complexity"),
        F.col("lang").alias("language"), F.lit(False).alias("mixed_language"),
    )


def doc_pages(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.concat(F.lit("page-"), "doc_id").alias("source_page_id"), F.sha2("text", 256).alias("source_sha256")
    )


def doc_variants(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select(
        "run_manifest_id", "evaluation_unit_id", F.concat(F.lit("variant-"), "doc_id").alias("page_input_variant_id"),
        F.sha2("source", 256).alias("artifact_sha256"),
    )


def roster(spark, sf_dir) -> DataFrame:
    """Three members per language run; the middle one has settings."""
    return documents(spark, sf_dir).select("run_manifest_id").distinct().select(
        "run_manifest_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("position")
    ).select(
        "run_manifest_id", "position", F.concat(F.lit("registry-"), "position").alias("registry_entry_id"),
        F.concat(F.lit("reader-"), "position").alias("exact_model_id"), F.lit("stub").alias("provider"),
        F.lit(None).cast("string").alias("router"), F.lit("account-1").alias("billing_account_id"),
        F.lit("adapter").alias("adapter_id"), F.lit("1.0.0").alias("adapter_version"),
        F.lit("prompt-1").alias("prompt_template_id"), F.repeat(F.lit("1"), F.lit(64)).alias("prompt_sha256"),
        F.when(F.col("position") == 1, F.create_map(F.lit("top_p"), F.lit("0.9"), F.lit("mode"), F.lit("exact")))
        .otherwise(F.create_map().cast("map<string,string>")).alias("hyperparameters"),
    )


def doc_members(spark, sf_dir) -> DataFrame:
    """Roster members under plain ids, for joining with the results below."""
    return roster(spark, sf_dir).withColumn(
        "roster_member_config_id", F.concat("run_manifest_id", F.lit("-member-"), "position")
    )


def doc_results(spark, sf_dir) -> DataFrame:
    """Results of the scored members; the French second member never finished."""
    units = documents(spark, sf_dir)
    unread = (F.col("lang") == "fr") & (F.col("position") == 1)
    step = F.col("position") + 1
    # What a unit says goes along with its readings: a join would move every text once more.
    return scored_texts(units, ("doc_id", "lang", "n_chars")).select(
        "run_manifest_id", "evaluation_unit_id", F.concat(F.lit("variant-"), "doc_id").alias("page_input_variant_id"),
        F.concat("run_manifest_id", F.lit("-member-"), "position").alias("roster_member_config_id"),
        "page_model_result_id", "position",
        F.when(unread, "indeterminate").otherwise("success").alias("terminal_outcome"),
        F.when(~unread, F.col("text")).alias("parsed_text"),
        ((F.col("n_chars") * step).cast("decimal(18,6)") / 1000000).cast("decimal(18,6)").alias("total_cost_usd"),
        (F.col("n_chars") * step / F.lit(10.0)).alias("total_measured_duration_ms"),
    )
