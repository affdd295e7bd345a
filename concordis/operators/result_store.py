"""Results that grow with their journal: each call reads only the journal's tail.

Stored are mergeable summaries (the last start of each intent and number, the last finish
of each attempt, the refused intents) and the outcome of every intent.  A call folds the
tail, adds its summaries, and works out anew only the intents that the tail touches.  Of
the stored summaries it scans ids; texts are fetched for touched intents alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordis.operators import journal
from concordis.schemas import MONEY
from concordis.sources.stores import read_table, stored

_INTENT = "dispatch_intent_id"
_FINISH = (
    "STRUCT<outcome: STRING, parsed_output: STRUCT<kind: STRING, text: STRING, parser_version: STRING, complete: BOOLEAN>, "
    f"actual_cost_usd: STRUCT<availability: STRING, value: {MONEY}>, measured_duration_ms: DOUBLE>"
)
_TELLING = "STRUCT<journal_seq: BIGINT, outcome: STRING>"
_TABLES = {
    "starts": f"{_INTENT} STRING, attempt_number INT, journal_seq BIGINT, attempt_id STRING, call INT",
    "finishes": f"attempt_id STRING, journal_seq BIGINT, finish {_FINISH}, telling {_TELLING}, call INT",
    "refusals": f"{_INTENT} STRING, call INT",
    "outcomes": (
        f"{_INTENT} STRING, terminal_outcome STRING, selected_attempt_id STRING, parsed_text STRING, attempt_ids ARRAY<STRING>, "
        f"total_cost_usd DECIMAL(28,6), total_measured_duration_ms DOUBLE, highest INT, open BOOLEAN, telling {_TELLING}, call INT"
    ),
    "calls": "last_seq BIGINT, rows_read BIGINT, touched BIGINT, call INT",
}
_NEEDED = ("journal_seq", "event_type", _INTENT, "attempt_id", "attempt_number", *journal.FINISH_FIELDS)


class ResultStore:
    """Summaries and outcomes parted by call, under ``root``.

    A call counts once its row of the ``calls`` table is there, which is written last; one
    that was cut off is done again under its number and replaces what it left.  Rows that
    enter the journal later must have a greater ``journal_seq``.  One call runs at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _read(self, name: str, last: int) -> DataFrame:
        return read_table(self.spark, self._path(name), _TABLES[name]).where(F.col("call") <= last)

    def _write(self, rows: DataFrame, name: str, call: int) -> None:
        # A journal may hold its money more narrowly than the store.
        fields = T.StructType.fromDDL(_TABLES[name]).fields
        marked = rows.withColumn("call", F.lit(call)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("call").parquet(self._path(name))

    def calls(self) -> DataFrame:
        """One row per finished call: the last journal place, tail rows read, intents worked out."""
        return read_table(self.spark, self._path("calls"), _TABLES["calls"])

    def _state(self) -> tuple[int, int | None]:
        row = self.calls().agg(F.max("call"), F.max("last_seq")).head()
        return row[0] or 0, row[1]

    def advance(self, events: DataFrame) -> None:
        """Take in the journal's rows after the last place read; does nothing if there are none."""
        done, last_seq = self._state()
        new = F.lit(True) if last_seq is None else F.col("journal_seq") > last_seq
        tail = events.where(new).select(*_NEEDED)
        read, seq = tail.agg(F.count(F.lit(1)), F.max("journal_seq")).head()
        if read == 0:
            return
        # The journal itself is read again, up to this place: what is appended meanwhile waits for the next call.
        tail = tail.where(F.coalesce(F.col("journal_seq") <= F.lit(seq), F.lit(True)))
        call = done + 1
        kind = lambda name: tail.where(F.col("event_type") == name)
        last = F.max("journal_seq").alias("journal_seq")
        self._write(
            kind(journal.STARTED).groupBy(_INTENT, "attempt_number").agg(last, F.max_by("attempt_id", "journal_seq").alias("attempt_id")), "starts", call
        )
        finish = F.max_by(F.struct(*journal.FINISH_FIELDS), "journal_seq").alias("finish")
        self._write(
            kind(journal.FINISHED).groupBy("attempt_id").agg(last, finish, F.max(journal.telling_finish()).alias("telling")), "finishes", call
        )
        self._write(kind(journal.REFUSED).select(_INTENT).distinct(), "refusals", call)
        self._write(self._worked_out(call), "outcomes", call)
        touched = self._read("outcomes", call).where(F.col("call") == call).count()
        summary = self.spark.createDataFrame([(seq, read, touched)], "last_seq long, rows_read long, touched long")
        self._write(summary, "calls", call)

    def _starts(self, call: int) -> DataFrame:
        return self._read("starts", call).groupBy(_INTENT, "attempt_number").agg(F.max_by("attempt_id", "journal_seq").alias("attempt_id"))

    def _touched(self, call: int) -> DataFrame:
        """Intents with a start, a refusal or a finished attempt in the call's tail."""
        new = lambda name: self._read(name, call).where(F.col("call") == call)
        finished = self._starts(call).join(new("finishes").select("attempt_id"), "attempt_id", "left_semi")
        return finished.select(_INTENT).unionByName(new("starts").select(_INTENT)).unionByName(new("refusals").select(_INTENT)).distinct()

    def _worked_out(self, call: int) -> DataFrame:
        """Outcome and resume state of each intent that the call touches, from all its summaries."""
        touched = stored(self._touched(call))
        starts = stored(self._starts(call).join(touched, _INTENT, "left_semi"))
        of_touched = self._read("finishes", call).join(starts.select("attempt_id"), "attempt_id", "left_semi")
        finishes = stored(
            of_touched.groupBy("attempt_id").agg(
                F.max_by("finish", "journal_seq").alias("finish"), F.max("telling").alias("telling"), F.lit(True).alias("finished")
            )
        )
        refused = self._read("refusals", call).join(touched, _INTENT, "left_semi").select(_INTENT)
        found = journal.outcomes_of(journal.attempt_rows(starts, finishes), refused)
        states = journal.resume_states(starts, finishes.drop("finish"))
        return found.join(states, _INTENT, "left")

    def outcomes(self) -> DataFrame:
        """The newest outcome row of each intent."""
        rows = self._read("outcomes", self._state()[0])
        # The newest call is found on ids alone; texts are fetched by it.
        newest = rows.groupBy(_INTENT).agg(F.max("call").alias("call"))
        return rows.join(newest, [_INTENT, "call"], "left_semi").drop("call")

    def page_model_results(self, intents: DataFrame, created_at: str) -> DataFrame:
        return journal.sealed_results(intents, self.outcomes().drop("highest", "open", "telling"), created_at)

    def resume_worklist(self, intents: DataFrame, max_attempts: int = journal.MAX_ATTEMPTS) -> DataFrame:
        states = self.outcomes().select(_INTENT, "highest", "open", "telling")
        return journal.worklist(intents, states, max_attempts)

    def compacted(self, root: str) -> ResultStore:
        """A copy under ``root`` with one summary row per key and all of it in one call."""
        done, last_seq = self._state()
        other = ResultStore(self.spark, root)
        if done == 0:
            return other
        last = F.max("journal_seq").alias("journal_seq")
        starts = self._read("starts", done).groupBy(_INTENT, "attempt_number").agg(last, F.max_by("attempt_id", "journal_seq").alias("attempt_id"))
        finishes = self._read("finishes", done).groupBy("attempt_id").agg(
            last, F.max_by("finish", "journal_seq").alias("finish"), F.max("telling").alias("telling")
        )
        outcomes = self.outcomes()
        for name, rows in (("starts", starts), ("finishes", finishes), ("refusals", self._read("refusals", done).select(_INTENT).distinct()), ("outcomes", outcomes)):
            other._write(rows, name, 1)
        read = self.calls().agg(F.sum("rows_read").alias("rows_read"))
        other._write(read.select(F.lit(last_seq).cast("long").alias("last_seq"), "rows_read", F.lit(None).cast("long").alias("touched")), "calls", 1)
        return other
