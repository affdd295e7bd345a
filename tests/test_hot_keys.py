"""One unit, attempt or ledger may hold most rows; results stay whole."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from concordis.functions.identity import money_text

from concordis.operators import alignment as al
from concordis.operators import budget, journal


def test_copies_in_one_unit_form_no_pairs(spark):
    members = spark.range(3000).select(
        F.lit("r").alias("run_manifest_id"), F.lit("hot").alias("evaluation_unit_id"),
        F.concat(F.lit("res-"), "id").alias("page_model_result_id"), F.col("id").cast("int").alias("position"),
        F.when(F.col("id") == 7, "the cot").when(F.col("id") == 9, "the cats").otherwise("the cat").alias("text"),
    )
    texts = al.distinct_texts(al.ranked_members(members))
    assert al.pair_distances(texts).count() == 3
    a = al.align(members)
    assert al.fused_texts(a).head().fused_text == "the cat"
    entropy = al.consensus_entropy(a).head()
    assert (entropy.hypothesis_count, entropy.column_count, entropy.disputed_columns) == (3000, 8, 2)
    assert al.aligned_rows(a).count() == 3000
    column = al.fusion_columns(a).where("emitted").head()
    assert [(c.symbol, c.votes) for c in column.candidates] == [("a", 2999), ("o", 1)]


def test_repeated_starts_and_finishes_of_one_attempt(spark):
    events = spark.range(20000).select(
        F.when(F.col("id") % 2 == 0, "attempt_started").otherwise("attempt_finished").alias("event_type"),
        F.when(F.col("id") % 2 == 0, "hot").alias("dispatch_intent_id"), F.lit("hot/1").alias("attempt_id"),
        F.when(F.col("id") % 2 == 0, 1).alias("attempt_number"), F.col("id").alias("journal_seq"),
        F.when(F.col("id") == 19999, "timeout").when(F.col("id") % 2 == 1, "rate_limited").alias("outcome"),
        F.lit(None).cast("struct<kind:string,text:string,parser_version:string,complete:boolean>").alias("parsed_output"),
        F.lit(None).cast("struct<availability:string,value:decimal(18,6)>").alias("actual_cost_usd"),
        F.lit(1.0).alias("measured_duration_ms"),
    )
    rows = journal.attempts(events).collect()
    assert len(rows) == 1 and rows[0].finish_outcome == "timeout" and rows[0].duration_ms == 1.0


@pytest.mark.parametrize("step", [1, 1_700_000_001])
def test_one_ledger_with_every_event(spark, step):
    """Dense and sparse sequence numbers (such as timestamps) are dealt alike; amounts go beyond 10^12."""
    events = spark.range(5000).select(
        (F.col("id") * step).alias("seq"), F.lit("run").alias("ledger"), F.concat(F.lit("x"), "id").alias("reservation_id"),
        F.lit("reserve").alias("kind"), F.lit(Decimal("1000000000.01")).cast("decimal(18,6)").alias("amount_usd"),
    )
    ledgers = spark.createDataFrame([("run", Decimal("100"))], "ledger string, ceiling_usd decimal(28,6)")
    balances = budget.running_balances(events, ledgers)
    rows = {r.seq // step: r.reserved_usd for r in balances.collect()}
    assert all(rows[i] == Decimal("1000000000.01") * (i + 1) for i in range(5000))
    shown = balances.select(money_text(F.col("reserved_usd")).alias("m")).agg(F.count("m")).head()[0]
    assert shown == 5000
