"""Following a growing attempt journal with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def follow_attempts(starts: DataFrame, finishes: DataFrame, patience: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Pair starts with finishes as they arrive.

    A start whose finish does not come within ``patience`` of event time is put out as
    ``indeterminate`` once the watermark has passed it, and its state is dropped.  Both
    inputs hold one row per attempt id; ``started_ts`` and ``finished_ts`` are timestamps.
    """
    opened = starts.withWatermark("started_ts", lateness)
    closed = finishes.withColumnRenamed("attempt_id", "finished_attempt_id").withWatermark("finished_ts", lateness)
    on_time = (
        (F.col("attempt_id") == F.col("finished_attempt_id"))
        & (F.col("finished_ts") >= F.col("started_ts"))
        & (F.col("finished_ts") <= F.col("started_ts") + F.expr(f"interval {patience}"))
    )
    return opened.join(closed, on_time, "left_outer").select(
        *starts.columns, "finished_ts",
        F.coalesce("outcome", F.lit("indeterminate")).alias("state"),
    )


class _Attempts(StatefulProcessor):
    """Lives of one group's attempts: open, then an outcome or ``indeterminate``, then perhaps a correction.

    The group's state is one value and one timer, that of the attempt due first: each call to the state
    costs a trip to the JVM, far more than a change of one attempt.
    """

    def __init__(self, patience_ms: int, retention_ms: int):
        self.patience_ms, self.retention_ms = patience_ms, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "lives array<struct<attempt_id:string,started_ms:long,changes:int,state:string,due_ms:long>>, until_ms long")

    def _read(self):
        if not self.seen.exists():
            return {}, None
        lives, until = self.seen.get()
        return {life[0]: tuple(life)[1:] for life in lives}, until

    def _write(self, lives: dict, until: int | None, fired: bool = False) -> None:
        """Store the lives; ``until`` is the timer registered before."""
        due = min((life[3] for life in lives.values()), default=None)
        if due != until or fired:
            if until is not None and not fired:
                self.handle.deleteTimer(until)
            if due is not None:
                self.handle.registerTimer(due)
        if lives:
            self.seen.update(([(attempt, *life) for attempt, life in lives.items()], due))
        else:
            self.seen.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        lives, until = self._read()
        arrived: dict = {}
        for row in rows:
            arrived.setdefault(row.attempt_id, []).append(row)
        for attempt, own in arrived.items():
            own.sort(key=lambda r: (r.at_ms, r.kind != "attempt_started"))
            started, changes, state, _ = lives.get(attempt, (None, 0, None, None))
            if started is None:
                started = next((r.at_ms for r in own if r.kind == "attempt_started"), None)
            before = state
            # Of several finishes the one that arrives last counts, as in the stored journal.
            finish = next((r for r in reversed(own) if r.kind == "attempt_finished"), None)
            if finish is not None:
                state = finish.outcome
            elif state is None and started is not None:
                state = "open"
            if started is not None and state is not None and (state != before or not changes):
                changes += 1
                yield Row(attempt_id=attempt, state=state, change_no=changes, at_ms=own[-1].at_ms, correction=before == "indeterminate")
            due = started + self.patience_ms if state == "open" else own[-1].at_ms + self.retention_ms
            lives[attempt] = (started, changes, state, due)
        self._write(lives, until)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        lives, until = self._read()
        reached = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        for attempt, (started, changes, state, due) in list(lives.items()):
            if due > reached:
                continue
            if state != "open":
                del lives[attempt]
                continue
            lives[attempt] = (started, changes + 1, "indeterminate", due + self.retention_ms)
            yield Row(attempt_id=attempt, state="indeterminate", change_no=changes + 1, at_ms=due, correction=False)
        self._write(lives, until, fired=True)

    def close(self) -> None:
        pass


CHANGES = "attempt_id string, state string, change_no int, at_ms long, correction boolean"


#: Groups that the attempts are dealt into; at ten million attempts within the retention some 600 in each.
GROUPS = 1 << 14


def follow_journal(
    events: DataFrame, patience_ms: int = 3_600_000, retention_ms: int = 7 * 86_400_000, lateness: str = "10 minutes", groups: int = GROUPS
) -> DataFrame:
    """State changes of every attempt, as rows put out while the journal grows.

    ``events`` has attempt_id, kind (``attempt_started`` or ``attempt_finished``), event_ts and outcome.  A start
    gives ``open``.  Without a finish ``patience_ms`` later an event-time timer gives
    ``indeterminate``; a finish gives its outcome, and one that follows ``indeterminate`` (or that replaces
    another outcome) is a correction of it.  The time column is not kept as such, so rows behind the
    watermark are not dropped: they correct what was put out.  State goes ``retention_ms`` of event time
    after the last change.  A finish that arrives before its start waits for it.

    Attempts are dealt by their hash into ``groups`` that share a state value, read and written once for all
    rows of a batch; take more for longer journals.  A checkpoint keeps to the number it began with.

    Use ``drain``, which keeps the state in RocksDB, outside the heap.
    """
    timed = events.withWatermark("event_ts", lateness).select(
        F.col("attempt_id").cast("string").alias("attempt_id"), "kind", F.unix_millis("event_ts").alias("at_ms"), "outcome"
    )
    dealt = timed.withColumn("attempts", F.pmod(F.xxhash64("attempt_id"), F.lit(groups)).cast("int"))
    return dealt.groupBy("attempts").transformWithState(
        _Attempts(patience_ms, retention_ms), CHANGES, outputMode="append", timeMode="EventTime"
    )


def latest_states(changes: DataFrame) -> DataFrame:
    """One row per attempt of what the stream put out: its last state, the number of changes, whether it was corrected."""
    return changes.groupBy("attempt_id").agg(
        F.max_by("state", "change_no").alias("state"), F.max("change_no").alias("changes"), F.bool_or("correction").alias("corrected")
    )


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available now, appending to a Parquet table; state is kept in RocksDB."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = (
            stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        conf.set(name, before)
