import datetime as dt

from pyspark.sql import functions as F

from concordis.streaming import journal_follow


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_starts_without_finish_become_indeterminate(spark, tmp_path):
    starts_dir, finishes_dir = str(tmp_path / "s"), str(tmp_path / "f")
    starts_schema, finishes_schema = "attempt_id string, started_ts timestamp", "attempt_id string, finished_ts timestamp, outcome string"
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def arrive(starts, finishes):
        spark.createDataFrame(starts, starts_schema).write.mode("append").parquet(starts_dir)
        spark.createDataFrame(finishes, finishes_schema).write.mode("append").parquet(finishes_dir)
        stream = journal_follow.follow_attempts(
            spark.readStream.schema(starts_schema).parquet(starts_dir), spark.readStream.schema(finishes_schema).parquet(finishes_dir)
        )
        journal_follow.drain(stream.select("attempt_id", "state"), out, checkpoint)
        return {(r.attempt_id, r.state) for r in spark.read.parquet(out).collect()}

    first = arrive([("a", at(0)), ("b", at(1)), ("c", at(2))], [("a", at(5), "response_received")])
    assert first == {("a", "response_received")}
    # The finish of b arrives in a later batch; c never finishes and time moves on.
    later = arrive([("z", at(300))], [("b", at(6), "timeout"), ("y", at(300), "timeout")])
    assert ("b", "timeout") in later and ("c", "indeterminate") in later
    assert len([x for x in later if x[0] == "b"]) == 1 and not [x for x in later if x[0] == "z"]


EVENTS = "attempt_id string, kind string, event_ts timestamp, outcome string"


def test_changes_and_corrections_come_from_the_stream(spark, tmp_path):
    journal, out, checkpoint = (str(tmp_path / n) for n in ("journal", "changes", "checkpoint"))
    start = lambda a, m: (a, "attempt_started", at(m), None)
    finish = lambda a, m, o: (a, "attempt_finished", at(m), o)

    def arrive(*rows):
        spark.createDataFrame(rows, EVENTS).write.mode("append").parquet(journal)
        # Every call starts a new query from the checkpoint.
        stream = journal_follow.follow_journal(spark.readStream.schema(EVENTS).parquet(journal), retention_ms=10 * 3_600_000)
        journal_follow.drain(stream, out, checkpoint)
        changes = spark.read.schema(journal_follow.CHANGES).parquet(out)
        return {r.attempt_id: (r.state, r.changes, r.corrected) for r in journal_follow.latest_states(changes).collect()}

    first = arrive(start("a", 0), start("b", 1), finish("b", 3, "timeout"), start("c", 2), finish("d", 2, "early"))
    assert first == {"a": ("open", 1, False), "b": ("timeout", 1, False), "c": ("open", 1, False)}
    # Time moves on: a and c run out of patience; the start of d comes after its finish.
    later = arrive(start("d", 1), start("z", 200))
    assert later["a"] == later["c"] == ("indeterminate", 2, False) and later["d"] == ("early", 1, False) and later["z"][0] == "open"
    # The finish of a, far behind the watermark, corrects; one that says the same again changes nothing.
    last = arrive(finish("a", 5, "response_received"), finish("b", 3, "timeout"), finish("z", 210, "timeout"))
    assert last["a"] == ("response_received", 3, True) and last["b"] == ("timeout", 1, False) and last["z"] == ("timeout", 2, False)
    # State is dropped in the end; what was put out stays.
    assert arrive(start("y", 5000))["c"] == ("indeterminate", 2, False)


def test_attempts_that_share_a_group_keep_their_own_lives(spark, tmp_path):
    def states(name, groups):
        journal, out, checkpoint = (str(tmp_path / f"{name}-{n}") for n in ("journal", "changes", "checkpoint"))
        found = []
        for rows in (
            [(f"a{n}", "attempt_started", at(n), None) for n in range(40)] + [(f"a{n}", "attempt_finished", at(n + 1), "timeout") for n in range(0, 40, 3)],
            [("z", "attempt_started", at(85), None)],
            [("a1", "attempt_finished", at(5), "early"), ("a39", "attempt_finished", at(90), "late"), ("a0", "attempt_finished", at(2), "timeout")],
        ):
            spark.createDataFrame(rows, EVENTS).write.mode("append").parquet(journal)
            stream = journal_follow.follow_journal(spark.readStream.schema(EVENTS).parquet(journal), groups=groups)
            journal_follow.drain(stream, out, checkpoint)
            changes = spark.read.schema(journal_follow.CHANGES).parquet(out)
            found.append(sorted(map(tuple, journal_follow.latest_states(changes).collect())))
        return found

    together = states("one", 1)
    assert together == states("many", 1 << 20)
    last = {attempt: rest for attempt, *rest in together[-1]}
    assert last["a0"] == ["timeout", 1, False] and last["a1"] == ["early", 3, True] and last["a2"] == ["indeterminate", 2, False]
    # At 90 less ten minutes the starts up to 15 and 20 have run out of patience, not those after.
    assert last["a14"] == ["indeterminate", 2, False] and last["a38"] == ["open", 1, False] and last["a39"] == ["late", 2, False]
