"""Budget ledgers: batch admission, balances over time and integrity of charges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordis.sources.stores import stored

MONEY = "decimal(28,6)"


def admit_batches(requests: DataFrame, headrooms: DataFrame) -> DataFrame:
    """A batch is admitted only if every ledger it names can carry its whole sum there.

    ``headrooms`` has ``ledger`` and ``headroom_usd``; NULL is unlimited and a ledger
    that is not listed does not limit.
    """
    asked = (
        requests.select("batch_id", "amount_usd", F.explode_outer("ledger_names").alias("ledger"))
        .groupBy("batch_id", "ledger")
        .agg(F.sum("amount_usd").cast(MONEY).alias("asked_usd"))
    )
    fits = F.coalesce(F.col("asked_usd") <= F.col("headroom_usd"), F.lit(True))
    return (
        asked.join(headrooms.select("ledger", "headroom_usd"), "ledger", "left")
        .groupBy("batch_id")
        .agg(F.bool_and(fits).alias("admitted"), F.count_if(~fits).alias("short_ledgers"))
    )


def _components(pairs: DataFrame) -> DataFrame:
    """ledger, component: ledgers that some batch names together share their least name.

    ``pairs`` holds (batch_id, ledger).  Names spread through batches and then through the names
    themselves, so a round doubles their reach; each is stored in the shared folder.
    """
    linked = stored(pairs.select("batch_id", "ledger").distinct())
    names = stored(linked.select("ledger").distinct().withColumn("component", F.col("ledger")))
    while True:
        least = linked.join(names, "ledger").groupBy("batch_id").agg(F.min("component").alias("component"))
        spread_out = linked.join(least, "batch_id").groupBy("ledger").agg(F.min("component").alias("near"))
        hop = names.select(F.col("ledger").alias("near"), F.col("component").alias("far"))
        reached = stored(
            names.join(spread_out, "ledger").join(hop, "near").select("ledger", "component", F.least("component", "near", "far").alias("next"))
        )
        if reached.where(F.col("next") < F.col("component")).isEmpty():
            return names
        names = reached.select("ledger", F.col("next").alias("component"))


def _admit_in_order(batches):
    """Rows by component and batch; a batch is admitted whole, against what earlier ones left."""
    component, left, batch, asked = None, {}, None, []

    def judged():
        short = sum(amount > left[ledger] for ledger, amount in asked)
        if not short:
            for ledger, amount in asked:
                left[ledger] -= amount
        return batch, not short, short

    for rows in batches:
        done = []
        names = ("component", "batch_id", "ledger", "asked_usd", "headroom_usd")
        for at, name, ledger, amount, headroom in zip(*(rows[c].to_pylist() for c in names)):
            if batch is not None and (at, name) != (component, batch):
                done.append(judged())
                asked = []
            if at != component:
                left = {}
            component, batch = at, name
            left.setdefault(ledger, headroom)
            asked.append((ledger, amount))
        yield _verdicts(done)
    if batch is not None:
        yield _verdicts([judged()])


def _verdicts(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), ()]
    types = (("batch_id", pa.string()), ("admitted", pa.bool_()), ("short_ledgers", pa.int64()))
    return pa.RecordBatch.from_pydict({n: pa.array(c, t) for (n, t), c in zip(types, columns)})


def admit_in_sequence(requests: DataFrame, headrooms: DataFrame) -> DataFrame:
    """As ``admit_batches``, batch after batch by ``batch_seq``: what one reserves the next ones lack.

    A ledger that can carry all that is asked of it never refuses and is left out, like unlimited
    and unknown ones.  Batches that share a remaining ledger depend on one another and are
    judged in order, streaming through one task that keeps one amount per ledger; those of separate
    ledgers are judged apart.  ``short_ledgers`` counts at the batch's turn.
    """
    asked = (
        requests.select("batch_id", "batch_seq", "amount_usd", F.explode_outer("ledger_names").alias("ledger"))
        .groupBy("batch_id", "ledger")
        .agg(F.min("batch_seq").alias("batch_seq"), F.sum("amount_usd").cast(MONEY).alias("asked_usd"))
    )
    asked = stored(asked)
    limits = headrooms.where(F.col("headroom_usd").isNotNull()).select("ledger", F.col("headroom_usd").cast(MONEY).alias("headroom_usd"))
    # Amounts may be negative in a correction, so only the positive ones decide whether a ledger can run short.
    most = asked.groupBy("ledger").agg(F.sum(F.greatest("asked_usd", F.lit(0).cast(MONEY))).alias("most_usd"))
    scarce = limits.join(most, "ledger").where(F.col("most_usd") > F.col("headroom_usd")).select("ledger", "headroom_usd")
    limited = stored(asked.join(scarce, "ledger"))
    ordered = (
        limited.join(_components(limited), "ledger")
        .repartition("component")
        .sortWithinPartitions("component", "batch_seq", "batch_id", "ledger")
        .select("component", "batch_id", "ledger", "asked_usd", "headroom_usd")
    )
    judged = ordered.mapInArrow(_admit_in_order, "batch_id string, admitted boolean, short_ledgers long")
    free = asked.select("batch_id").distinct().join(limited.select("batch_id").distinct(), "batch_id", "left_anti")
    return judged.unionByName(free.select("batch_id", F.lit(True).alias("admitted"), F.lit(0).cast("long").alias("short_ledgers")))


def judged_events(events: DataFrame) -> DataFrame:
    """Ledger events with the reserved amount and a verdict.

    A close counts when its reservation exists, is still open and the charge stays
    within the reserved amount; an overcharge leaves the reservation open.
    """
    reservation = ["ledger", "reservation_id"]
    reserved = (
        events.where(F.col("kind") == "reserve")
        .groupBy(*reservation)
        .agg(F.min_by("amount_usd", "seq").alias("reserved_usd"), F.min("seq").alias("reserved_seq"))
    )
    known = F.coalesce(F.col("reserved_seq") < F.col("seq"), F.lit(False))
    within = (F.col("kind") == "release") | (F.col("amount_usd") <= F.col("reserved_usd"))
    closes = events.where(F.col("kind") != "reserve").join(reserved, reservation, "left")
    closing = closes.where(known & within).groupBy(*reservation).agg(F.min("seq").alias("closed_seq"))
    verdict = (
        F.when(~known, "unknown_reservation")
        .when(F.col("seq") > F.col("closed_seq"), "already_closed")
        .when(~within, "overcharge")
        .otherwise("ok")
    )
    judged = closes.join(closing, reservation, "left").select(
        "seq", *reservation, "kind", "amount_usd", "reserved_usd", verdict.alias("verdict")
    )
    opens = events.where(F.col("kind") == "reserve").select(
        "seq", *reservation, "kind", "amount_usd", F.col("amount_usd").alias("reserved_usd"), F.lit("ok").alias("verdict")
    )
    return opens.unionByName(judged)


def violations(events: DataFrame) -> DataFrame:
    return judged_events(events).where(F.col("verdict") != "ok").select(
        "seq", "ledger", "reservation_id", "kind", "amount_usd", "reserved_usd", "verdict"
    )


def _changes(events: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return judged_events(events).where(F.col("verdict") == "ok").select(
        "seq", "ledger", "reservation_id", "kind",
        F.when(kind == "reserve", F.col("amount_usd")).otherwise(-F.col("reserved_usd")).cast(MONEY).alias("reserved_change"),
        F.when(kind == "reconcile", F.col("amount_usd")).otherwise(F.lit(0)).cast(MONEY).alias("settled_change"),
    )


def current_balances(events: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Reserved, settled and remaining amount of every ledger after all events."""
    totals = _changes(events).groupBy("ledger").agg(
        F.sum("reserved_change").cast(MONEY).alias("reserved_usd"),
        F.sum("settled_change").cast(MONEY).alias("settled_usd"),
    )
    zero = F.lit(0).cast(MONEY)
    reserved, settled = F.coalesce("reserved_usd", zero), F.coalesce("settled_usd", zero)
    return ledgers.join(totals, "ledger", "left").select(
        "ledger", "ceiling_usd", reserved.alias("reserved_usd"), settled.alias("settled_usd"),
        (F.col("ceiling_usd") - reserved - settled).cast(MONEY).alias("headroom_usd"),
    )


def running_balances(events: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Balance of each ledger after each of its events.

    A run-wide ledger sees every event, so the running sum is taken in two levels: changes are
    dealt by range over ledger and sequence into parts of like row counts, however the sequence
    numbers lie, and stored with their part; each part sums up alone and adds what earlier
    parts of its ledger hold.
    """
    parts = stored(_changes(events).repartitionByRange("ledger", "seq").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("ledger").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(MONEY)
    carried = (
        parts.groupBy("ledger", "part")
        .agg(F.sum("reserved_change").alias("r"), F.sum("settled_change").alias("s"))
        .select(
            "ledger", "part",
            F.coalesce(F.sum("r").over(before), zero).alias("reserved_before"),
            F.coalesce(F.sum("s").over(before), zero).alias("settled_before"),
        )
    )
    inside = Window.partitionBy("ledger", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    reserved = (F.col("reserved_before") + F.sum("reserved_change").over(inside)).cast(MONEY)
    settled = (F.col("settled_before") + F.sum("settled_change").over(inside)).cast(MONEY)
    return (
        parts.join(carried, ["ledger", "part"])
        .select("seq", "ledger", "reservation_id", "kind", reserved.alias("reserved_usd"), settled.alias("settled_usd"))
        .join(ledgers, "ledger", "left")
        .withColumn("headroom_usd", (F.col("ceiling_usd") - F.col("reserved_usd") - F.col("settled_usd")).cast(MONEY))
    )
