"""Reduction of the append-only attempt journal to attempts, results and a worklist.

The journal may repeat a start or a finish; the later row in journal order counts.
Repeats are folded by key before any join, so a hot id shrinks on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordis.functions.identity import seal

# Fixed values of the stored journal and results.
STARTED, FINISHED, REFUSED = "attempt_started", "attempt_finished", "dispatch_refused"
RETRIABLE = ("rate_limited", "transport_error", "timeout")
INELIGIBLE = (
    "indeterminate", "budget_refused", "content_filtered", "cancelled", "unsupported_input", "retry_exhausted",
    "permanent_failure",
)
MAX_ATTEMPTS = 4


def _latest_starts(events: DataFrame) -> DataFrame:
    return (
        events.where(F.col("event_type") == STARTED)
        .groupBy("dispatch_intent_id", "attempt_number")
        .agg(F.max_by("attempt_id", "journal_seq").alias("attempt_id"))
    )


FINISH_FIELDS = ("outcome", "parsed_output", "actual_cost_usd", "measured_duration_ms")


def attempts(events: DataFrame) -> DataFrame:
    """One row per intent and attempt number; a start without a finish has no outcome."""
    finishes = (
        events.where(F.col("event_type") == FINISHED)
        .groupBy("attempt_id")
        .agg(F.max_by(F.struct(*FINISH_FIELDS), "journal_seq").alias("finish"))
    )
    return attempt_rows(_latest_starts(events), finishes)


def attempt_rows(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """Attempts from one start per intent and number and one ``finish`` per attempt id."""
    cost = F.col("finish.actual_cost_usd")
    return (
        starts.join(finishes, "attempt_id", "left")
        .select(
            "dispatch_intent_id", "attempt_number", "attempt_id",
            F.col("finish").isNotNull().alias("finished"),
            F.col("finish.outcome").alias("finish_outcome"),
            F.col("finish.parsed_output").alias("parsed_output"),
            F.coalesce(F.when(cost["availability"] == "reported", cost["value"]), F.lit(0))
            .cast("decimal(28,6)").alias("cost_usd"),
            F.coalesce("finish.measured_duration_ms", F.lit(0.0)).alias("duration_ms"),
        )
    )


def _responded() -> Column:
    return F.coalesce(F.col("finish_outcome") == "response_received", F.lit(False))


def _parsed(kind: str, complete: bool | None = None) -> Column:
    match = _responded() & (F.col("parsed_output.kind") == kind)
    if complete is not None:
        match = match & (F.col("parsed_output.complete") == F.lit(complete))
    return F.coalesce(match, F.lit(False))


def first_successes(attempt_rows: DataFrame) -> DataFrame:
    """The complete transcription with the lowest attempt number of each intent."""
    return (
        attempt_rows.where(_parsed("transcription", True))
        .groupBy("dispatch_intent_id")
        .agg(F.min_by(F.struct("attempt_number", "attempt_id", "parsed_output.text"), "attempt_number").alias("s"))
        .select("dispatch_intent_id", "s.*")
    )


def outcomes(events: DataFrame) -> DataFrame:
    """Terminal outcome, selected attempt, text and totals of every intent in the journal."""
    return outcomes_of(attempts(events), events.where(F.col("event_type") == REFUSED).select("dispatch_intent_id"))


def outcomes_of(attempt_rows: DataFrame, refused: DataFrame) -> DataFrame:
    """Outcomes of the intents in ``attempt_rows`` and of those in ``refused`` (repeats allowed)."""
    refusals = refused.select("dispatch_intent_id", F.lit(True).alias("refused"))
    rows = attempt_rows.unionByName(refusals, allowMissingColumns=True)
    is_attempt = F.col("attempt_id").isNotNull()
    chosen = F.struct("attempt_number", "attempt_id", F.col("parsed_output.text").alias("text"))
    partial = F.struct(
        "attempt_number", "attempt_id", F.col("parsed_output.text").alias("text"),
        F.when(_parsed("transcription", False), "truncated").otherwise("whole_unit_abstention").alias("outcome"),
    )
    seen = lambda outcome: F.bool_or(F.coalesce(F.col("finish_outcome") == outcome, F.lit(False)))
    folded = rows.groupBy("dispatch_intent_id").agg(
        F.min(F.when(_parsed("transcription", True), chosen)).alias("success"),
        F.min(F.when(_parsed("transcription", False) | _parsed("whole_unit_abstention"), partial)).alias("partial"),
        F.bool_or(is_attempt & ~F.coalesce("finished", F.lit(False))).alias("open"),
        F.bool_or(F.coalesce("refused", F.lit(False))).alias("refused"),
        F.count("attempt_id").alias("attempt_count"),
        seen("content_filtered").alias("content_filtered"),
        seen("cancelled").alias("cancelled"),
        seen("provider_rejected").alias("provider_rejected"),
        F.bool_and(~is_attempt | F.coalesce(F.col("finish_outcome").isin(*RETRIABLE), F.lit(False))).alias("only_retriable"),
        F.sum("cost_usd").alias("cost_usd"),
        # Summed exactly, so the total does not depend on arrival order.
        F.sum(F.col("duration_ms").cast("decimal(28,6)")).alias("duration_ms"),
        F.collect_list(F.when(is_attempt, F.struct("attempt_number", "attempt_id"))).alias("tried"),
    )
    outcome = (
        F.when(F.col("success").isNotNull(), "success")
        .when(F.col("open"), "indeterminate")
        .when(F.col("refused") | (F.col("attempt_count") == 0), "budget_refused")
        .when(F.col("content_filtered"), "content_filtered")
        .when(F.col("cancelled"), "cancelled")
        .when(F.col("provider_rejected"), "unsupported_input")
        .when(F.col("partial").isNotNull(), F.col("partial.outcome"))
        .when(F.col("only_retriable"), "retry_exhausted")
        .otherwise("permanent_failure")
    )
    kept = F.when(F.col("success").isNotNull(), F.struct("success.attempt_id", "success.text")).when(
        outcome == "truncated", F.struct("partial.attempt_id", "partial.text")
    )
    return folded.select(
        "dispatch_intent_id", outcome.alias("terminal_outcome"),
        kept["attempt_id"].alias("selected_attempt_id"), kept["text"].alias("parsed_text"),
        F.transform(F.array_sort("tried"), lambda t: t["attempt_id"]).alias("attempt_ids"),
        F.coalesce("cost_usd", F.lit(0)).cast("decimal(28,6)").alias("total_cost_usd"),
        F.coalesce(F.col("duration_ms").cast("double"), F.lit(0.0)).alias("total_measured_duration_ms"),
    )


def eligibility(outcome: Column) -> tuple[Column, Column]:
    barred = outcome.isin(*INELIGIBLE)
    reasons = F.when(barred, F.array(outcome)).otherwise(F.array().cast("array<string>"))
    return F.when(barred, "ineligible").otherwise("eligible"), reasons


def page_model_results(intents: DataFrame, events: DataFrame, created_at: str) -> DataFrame:
    """Exactly one sealed result per intent, also for intents the journal never mentions."""
    return sealed_results(intents, outcomes(events), created_at)


def sealed_results(intents: DataFrame, outcome_rows: DataFrame, created_at: str) -> DataFrame:
    joined = intents.join(outcome_rows, "dispatch_intent_id", "left").withColumns(
        {
            "terminal_outcome": F.coalesce("terminal_outcome", F.lit("budget_refused")),
            "attempt_ids": F.coalesce("attempt_ids", F.array().cast("array<string>")),
            "total_cost_usd": F.coalesce("total_cost_usd", F.lit(0)).cast("decimal(28,6)"),
            "total_measured_duration_ms": F.coalesce("total_measured_duration_ms", F.lit(0.0)),
            "created_at": F.lit(created_at),
        }
    )
    state, reasons = eligibility(F.col("terminal_outcome"))
    return seal(joined.withColumns({"eligibility": state, "ineligibility_reasons": reasons}), "page_model_result")


def resume_worklist(intents: DataFrame, events: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """What a resumed run may do with each intent.

    ``held``: an attempt started and never finished.  ``done``: the last response or
    rate-limit finish was a response.  ``exhausted``: no attempt is left.  Otherwise
    ``ready`` with the next attempt number.
    """
    finishes = (
        events.where(F.col("event_type") == FINISHED)
        .groupBy("attempt_id")
        .agg(F.max(telling_finish()).alias("telling"), F.lit(True).alias("finished"))
    )
    return worklist(intents, resume_states(_latest_starts(events), finishes), max_attempts)


def telling_finish() -> Column:
    """Journal place and outcome of a finish that tells whether to go on; NULL for the others."""
    return F.when(F.col("outcome").isin("response_received", "rate_limited"), F.struct("journal_seq", "outcome"))


def resume_states(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """Highest attempt, open attempts and the last telling finish of each intent."""
    return (
        starts.join(finishes, "attempt_id", "left")
        .groupBy("dispatch_intent_id")
        .agg(
            F.max("attempt_number").alias("highest"),
            F.bool_or(F.col("finished").isNull()).alias("open"),
            F.max("telling").alias("telling"),
        )
    )


def worklist(intents: DataFrame, state: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    highest = F.coalesce("highest", F.lit(0))
    status = (
        F.when(F.col("open"), "held")
        .when(F.col("telling.outcome") == "response_received", "done")
        .when(highest >= max_attempts, "exhausted")
        .otherwise("ready")
    )
    return intents.select("dispatch_intent_id").join(state, "dispatch_intent_id", "left").select(
        "dispatch_intent_id", status.alias("status"), highest.alias("highest_attempt_number"),
        F.when(status == "ready", highest + 1).alias("next_attempt_number"),
    )
