import json
import random

from pyspark.sql import functions as F

from concordis.operators import journal, result_store
from concordis.operators.result_store import ResultStore
from concordis.schemas import ATTEMPT_EVENTS
from concordis.sources.stores import append_journal, stored
from tests.test_journal import EVENTS, EXPECTED, finish, journal_frames, refused, start


def frame(spark, events, first=0):
    lines = [json.dumps({**e, "journal_seq": first + i}) for i, e in enumerate(events)]
    return spark.read.schema(ATTEMPT_EVENTS).json(spark.sparkContext.parallelize(lines, 2))


def listed(rows):
    return sorted(str(r.asDict(recursive=True)) for r in rows.collect())


def same(store, intents, events):
    assert listed(store.page_model_results(intents, "2026")) == listed(journal.page_model_results(intents, events, "2026"))
    assert listed(store.resume_worklist(intents)) == listed(journal.resume_worklist(intents, events))


def test_calls_equal_one_fold(spark, tmp_path):
    intents, events = journal_frames(spark)
    store, path = ResultStore(spark, str(tmp_path / "s")), str(tmp_path / "journal")
    cuts = (0, 9, len(EVENTS))
    for low, high in zip(cuts, cuts[1:]):
        append_journal(events.where(f"journal_seq >= {low} and journal_seq < {high}"), path)
        store.advance(spark.read.parquet(path))
        same(store, intents, events.where(f"journal_seq < {high}"))
    assert {r.terminal_outcome for r in store.outcomes().collect()} <= set(EXPECTED.values())
    assert [r.rows_read for r in store.calls().orderBy("call").collect()] == [high - low for low, high in zip(cuts, cuts[1:])]
    store.advance(spark.read.parquet(path))
    assert store.calls().count() == 2


def test_only_touched_intents_are_worked_out(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "s"))
    first = [e for i in range(40) for e in (start(f"i{i}", 1), finish(f"i{i}", 1, "timeout"))] + [start("late", 1)]
    # A finish names no intent; it is found through the stored start.
    then = [finish("late", 1, "cancelled"), start("i7", 2), refused("i9")]
    events = frame(spark, first + then)
    store.advance(events.where(f"journal_seq < {len(first)}"))
    store.advance(events)
    calls = store.calls().orderBy("call").collect()
    assert [(c.rows_read, c.touched) for c in calls] == [(81, 41), (3, 3)]
    states = {r[0]: r[1] for r in store.outcomes().select("dispatch_intent_id", "terminal_outcome").collect()}
    assert len(states) == 41 and states["late"] == "cancelled" and states["i7"] == "indeterminate" and states["i9"] == "budget_refused"
    assert states["i8"] == "retry_exhausted"


def test_a_cut_off_call_is_done_again(spark, tmp_path):
    intents, events = journal_frames(spark)
    store = ResultStore(spark, str(tmp_path / "s"))
    store.advance(events.where("journal_seq < 12"))
    whole = store._write

    def cut(rows, name, call):
        if name == "calls":
            raise RuntimeError("lost")
        whole(rows, name, call)

    store._write = cut
    try:
        store.advance(events)
    except RuntimeError:
        pass
    store = ResultStore(spark, str(tmp_path / "s"))
    same(store, intents, events.where("journal_seq < 12"))
    store.advance(events)
    same(store, intents, events)


def test_random_journals_in_random_parts(spark, tmp_path):
    rng = random.Random(5)
    outcomes = ("response_received", "rate_limited", "timeout", "cancelled", "content_filtered")
    events = []
    for _ in range(300):
        intent, number = f"i{rng.randrange(25)}", rng.randrange(1, 4)
        events.append(
            rng.choice((start(intent, number), finish(intent, number, rng.choice(outcomes), None, "0.25"), start(intent, number, f"{intent}/{number}/b"), refused(intent)))
        )
    table = frame(spark, events).cache()
    intents = spark.createDataFrame(
        [(f"i{i}",) * 6 for i in range(27)],
        ["dispatch_intent_id", "run_manifest_id", "page_input_variant_id", "evaluation_unit_id", "roster_member_config_id", "dispatch_pair_id"],
    )
    store = ResultStore(spark, str(tmp_path / "s"))
    for high in (90, 300):
        store.advance(table.where(F.col("journal_seq") < high))
    same(store, intents, table)
    small = store.compacted(str(tmp_path / "c"))
    same(small, intents, table)
    more = table.unionByName(frame(spark, [refused("i3"), finish("i4", 1, "cancelled")], 300))
    small.advance(more)
    same(small, intents, more)
    assert [r.rows_read for r in small.calls().orderBy("call").collect()] == [300, 2]


def test_empty_journal(spark, tmp_path):
    intents, events = journal_frames(spark)
    store = ResultStore(spark, str(tmp_path / "s"))
    store.advance(events.limit(0))
    assert store.calls().count() == 0
    same(store, intents, events.limit(0))


def test_a_call_writes_no_copy_of_the_journal(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(result_store, "stored", lambda df: written.append(df.columns) or stored(df))
    path = str(tmp_path / "journal")
    append_journal(frame(spark, [start("i", 1), finish("i", 1, "timeout")]), path)
    store = ResultStore(spark, str(tmp_path / "s"))
    store.advance(spark.read.parquet(path))
    assert store.outcomes().count() == 1
    assert written and not any("event_type" in columns for columns in written)
