"""Integrity checks over stored runs and the pass/fail gate.

Every check yields rows of ``(run_manifest_id, code, severity, subject)``.  All runs are
checked at once; ``stored_run`` says which run a row was stored under, whatever run the
row itself names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordis.functions.identity import attempt_id
from concordis.operators import alignment as al
from concordis.operators.journal import STARTED

CE_TOLERANCE = 1e-12


def _finding(rows: DataFrame, code: str, subject: Column, run: str = "stored_run") -> DataFrame:
    return rows.select(
        F.col(run).alias("run_manifest_id"), F.lit(code).alias("code"), F.lit("fail").alias("severity"),
        subject.cast("string").alias("subject"),
    )


def missing_manifests(runs: DataFrame, manifests: DataFrame) -> DataFrame:
    known = manifests.select(F.col("run_manifest_id").alias("stored_run"))
    return _finding(runs.select("stored_run").distinct().join(known, "stored_run", "left_anti"), "missing_run_manifest", F.col("stored_run"))


def mismatched_runs(intents: DataFrame, results: DataFrame, observations: DataFrame) -> DataFrame:
    stores = {"dispatch_intents": intents, "page_model_results": results, "benchmark_observations": observations}
    found = None
    for name, rows in stores.items():
        bad = rows.where(~F.col("run_manifest_id").eqNullSafe(F.col("stored_run"))).drop("run_manifest_id")
        part = _finding(bad, "run_manifest_id_mismatch", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


_PAIR = ["stored_run", "dispatch_pair_id"]


def _pair_counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(*_PAIR).agg(F.count(F.lit(1)).alias(name))


def duplicate_intents(intents: DataFrame) -> DataFrame:
    return _finding(_pair_counts(intents, "n").where("n <> 1"), "duplicate_dispatch_intent", F.col("dispatch_pair_id"))


def result_cardinality(intents: DataFrame, results: DataFrame) -> DataFrame:
    """Missing, duplicate and orphan results from one full join of the two pair counts."""
    counts = _pair_counts(intents, "expected").join(_pair_counts(results, "observed"), _PAIR, "full")
    code = (
        F.when(F.col("expected").isNull(), "orphan_page_model_result")
        .when(F.col("observed").isNull(), "missing_page_model_result")
        .when(F.col("observed") > 1, "duplicate_page_model_result")
    )
    return counts.withColumn("code", code).where(F.col("code").isNotNull()).select(
        F.col("stored_run").alias("run_manifest_id"), "code", F.lit("fail").alias("severity"),
        F.col("dispatch_pair_id").alias("subject"),
    )


def duplicate_attempts(events: DataFrame) -> DataFrame:
    """One finding per start beyond the first of its attempt id."""
    starts = events.where(F.col("event_type") == STARTED).select("stored_run", "attempt_id", "journal_seq")
    repeated = (
        starts.groupBy("stored_run", "attempt_id")
        .agg(F.min("journal_seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    extra = starts.join(repeated, ["stored_run", "attempt_id"]).where(F.col("journal_seq") > F.col("first_seq"))
    return _finding(extra, "duplicate_attempt_id", F.col("attempt_id"))


def mismatched_attempts(events: DataFrame) -> DataFrame:
    expected = attempt_id(F.col("dispatch_intent_id"), F.col("attempt_number"))
    bad = events.where((F.col("event_type") == STARTED) & (F.col("attempt_id") != expected))
    return _finding(bad, "attempt_id_mismatch", F.col("attempt_id"))


def impossible_sequences(events: DataFrame) -> DataFrame:
    """Intents whose attempt numbers are not exactly 1..N, repeats included."""
    numbers = (
        events.where(F.col("event_type") == STARTED)
        .groupBy("stored_run", "dispatch_intent_id", "attempt_number")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("stored_run", "dispatch_intent_id")
        .agg(
            F.min("attempt_number").alias("low"), F.max("attempt_number").alias("high"),
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_numbers"),
        )
    )
    fine = (F.col("low") == 1) & (F.col("high") == F.col("total")) & (F.col("distinct_numbers") == F.col("total"))
    return _finding(numbers.where(~fine), "impossible_attempt_sequence", F.col("dispatch_intent_id"))


def required_fields(results: DataFrame) -> DataFrame:
    """A success needs its selected attempt; any other outcome must have no text."""
    success = F.col("terminal_outcome") == "success"
    code = F.when(success & F.col("selected_attempt_id").isNull(), "success_missing_selected_attempt").when(
        ~success & F.col("parsed_text").isNotNull(), "non_success_has_parsed_text"
    )
    return results.withColumn("code", code).where(F.col("code").isNotNull()).select(
        F.col("stored_run").alias("run_manifest_id"), "code", F.lit("fail").alias("severity"),
        F.col("page_model_result_id").alias("subject"),
    )


def unknown_results(observations: DataFrame, results: DataFrame) -> DataFrame:
    known = results.select("stored_run", F.col("page_model_result_id").alias("subject_id"))
    bad = observations.where(F.col("subject_kind") == "page_model_result").join(known, ["stored_run", "subject_id"], "left_anti")
    return _finding(bad, "observation_references_unknown_result", F.col("benchmark_observation_id"))


def _referenced(consensus: DataFrame, results: DataFrame, *columns) -> DataFrame:
    """Contributors of each consensus result with ``columns`` of their result, NULL where there is none."""
    named = consensus.select(
        "stored_run", "consensus_result_id", F.explode("eligible_page_model_result_ids").alias("page_model_result_id")
    )
    found = results.select("stored_run", "page_model_result_id", *columns).dropDuplicates(["stored_run", "page_model_result_id"])
    return named.join(found, ["stored_run", "page_model_result_id"], "left")


def missing_contributors(consensus: DataFrame, results: DataFrame) -> DataFrame:
    short = (
        _referenced(consensus, results, F.col("parsed_text").isNotNull().alias("has_text"))
        .groupBy("stored_run", "consensus_result_id")
        .agg(F.bool_or(~F.coalesce("has_text", F.lit(False))).alias("short"))
        .where("short")
    )
    return _finding(short, "consensus_references_missing_result", F.col("consensus_result_id"))


def unreproducible_entropy(consensus: DataFrame, results: DataFrame, intents: DataFrame) -> DataFrame:
    """Align again in roster order and compare with the stored entropy.

    Consensus results with a missing contributor are reported elsewhere and skipped.
    """
    keys = ("stored_run", "consensus_result_id")
    positions = intents.select("stored_run", "dispatch_intent_id", F.col("ordinal").alias("position")).dropDuplicates(
        ["stored_run", "dispatch_intent_id"]
    )
    broken = missing_contributors(consensus, results).select(
        F.col("run_manifest_id").alias("stored_run"), F.col("subject").alias("consensus_result_id")
    )
    hypotheses = (
        _referenced(consensus, results, "dispatch_intent_id", "parsed_text")
        .join(broken, list(keys), "left_anti")
        .join(positions, ["stored_run", "dispatch_intent_id"], "left")
        .select(*keys, "page_model_result_id", "position", F.col("parsed_text").alias("text"))
    )
    again = al.consensus_entropy(al.align(hypotheses, keys)).select(*keys, F.col("consensus_entropy").alias("again"))
    stored = F.col("consensus_entropy")
    differs = F.when(F.col("again").isNull(), stored.isNotNull()).otherwise(
        stored.isNull() | (F.abs(F.col("again") - stored) > CE_TOLERANCE)
    )
    bad = consensus.select(*keys, "consensus_entropy").join(again, list(keys)).where(differs)
    return _finding(bad, "ce_reproducibility_mismatch", F.col("consensus_result_id"))


def blank_reference_violations(observations: DataFrame) -> DataFrame:
    bad = observations.where(
        (F.col("reference_length_chars") == 0) & (F.col("cer") != 0) & F.col("char_insertions").isNull()
    )
    return _finding(bad, "blank_reference_convention_violated", F.col("benchmark_observation_id"))


def all_findings(runs, manifests, intents, events, results, consensus, observations) -> DataFrame:
    """Union of all checks.  A run without a manifest gets that one finding only."""
    no_manifest = missing_manifests(runs, manifests)
    parts = [
        mismatched_runs(intents, results, observations),
        duplicate_intents(intents),
        result_cardinality(intents, results),
        duplicate_attempts(events),
        mismatched_attempts(events),
        impossible_sequences(events),
        required_fields(results),
        unknown_results(observations, results),
        missing_contributors(consensus, results),
        unreproducible_entropy(consensus, results, intents),
        blank_reference_violations(observations),
    ]
    checked = parts[0]
    for part in parts[1:]:
        checked = checked.unionByName(part)
    return no_manifest.unionByName(checked.join(no_manifest.select("run_manifest_id"), "run_manifest_id", "left_anti"))


def finding_counts(findings: DataFrame) -> DataFrame:
    """Findings per run and code.  The codes are a fixed set, so this is small."""
    return findings.groupBy("run_manifest_id", "code", "severity").agg(F.count(F.lit(1)).alias("n"))


def gates(runs: DataFrame, manifests: DataFrame, intents: DataFrame, results: DataFrame, counts: DataFrame) -> DataFrame:
    """Gate and completion of every run, with expected and observed counts.

    Takes the counts of ``finding_counts``; they go along as one list per run.
    """
    run = "stored_run"
    found = counts.groupBy(F.col("run_manifest_id").alias(run)).agg(
        F.sum("n").alias("finding_count"),
        F.bool_or(F.col("severity") == "fail").alias("failed"),
        F.array_sort(F.collect_list(F.struct("code", "severity", "n"))).alias("finding_counts"),
    )
    known = manifests.select(F.col("run_manifest_id").alias(run), F.lit(True).alias("has_manifest")).distinct()
    expected = intents.select(run, "dispatch_pair_id").distinct().groupBy(run).agg(F.count(F.lit(1)).alias("expected"))
    observed = results.groupBy(run).agg(
        F.count(F.lit(1)).alias("observed"), F.bool_or(F.col("terminal_outcome") == "indeterminate").alias("open")
    )
    has = F.col("has_manifest").isNotNull()
    count_of = lambda c: F.when(has, F.coalesce(c, F.lit(0))).otherwise(0)
    none = F.array().cast("array<struct<code:string,severity:string,n:bigint>>")
    return (
        runs.select(run).distinct()
        .join(known, run, "left").join(found, run, "left").join(expected, run, "left").join(observed, run, "left")
        .select(
            F.col(run).alias("run_manifest_id"),
            F.when(F.col("failed"), "fail").otherwise("pass").alias("gate_status"),
            F.when(~has | F.coalesce("open", F.lit(False)), "incomplete").otherwise("complete").alias("run_completion_status"),
            count_of("expected").alias("expected_pair_count"),
            count_of("observed").alias("observed_result_count"),
            F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
            F.coalesce("finding_counts", none).alias("finding_counts"),
        )
    )


def reports(gate_rows: DataFrame) -> DataFrame:
    """One report row per run.  It counts findings by code; the findings stay rows, since a
    run may have any number of them."""
    return gate_rows.withColumn("anomaly_detectors_run", F.lit(False))
