import json
from decimal import Decimal

from concordis.operators import budget, journal
from concordis.schemas import ATTEMPT_EVENTS, LEDGER_EVENTS, LEDGERS, RESERVE_REQUESTS

TRANSCRIPTION = {"kind": "transcription", "text": "the quick brown fox", "parser_version": "p", "complete": True}


def start(intent, number, attempt=None):
    return {"event_type": "attempt_started", "dispatch_intent_id": intent, "attempt_number": number, "attempt_id": attempt or f"{intent}/{number}"}


def finish(intent, number, outcome, parsed=None, cost="0", duration=5.0):
    return {
        "event_type": "attempt_finished", "attempt_id": f"{intent}/{number}", "outcome": outcome, "parsed_output": parsed,
        "actual_cost_usd": {"availability": "reported", "value": cost} if cost is not None else {"availability": "unknown"},
        "measured_duration_ms": duration,
    }


def refused(intent):
    return {"event_type": "dispatch_refused", "dispatch_intent_id": intent, "reason": "no headroom"}


EVENTS = [
    start("first", 1), finish("first", 1, "response_received", TRANSCRIPTION, "0.005"),
    start("retry", 1), finish("retry", 1, "rate_limited"), start("retry", 2), finish("retry", 2, "rate_limited"),
    start("retry", 3), finish("retry", 3, "response_received", TRANSCRIPTION, "0.005"),
    *[e for n in range(1, 5) for e in (start("worn", n), finish("worn", n, "rate_limited"))],
    start("open", 1), finish("open", 1, "rate_limited"), start("open", 2),
    refused("refused"),
    start("beats", 1), start("beats", 2), finish("beats", 2, "response_received", TRANSCRIPTION, None),
    start("cut", 1), finish("cut", 1, "response_received", {**TRANSCRIPTION, "complete": False}),
    start("cut", 2), finish("cut", 2, "response_received", {**TRANSCRIPTION, "kind": "whole_unit_abstention", "text": None}),
    start("quiet", 1), finish("quiet", 1, "response_received", {**TRANSCRIPTION, "kind": "whole_unit_abstention", "text": None}),
    start("quiet", 2), finish("quiet", 2, "response_received", {**TRANSCRIPTION, "complete": False}),
    start("barred", 1), finish("barred", 1, "cancelled"), start("barred", 2), finish("barred", 2, "content_filtered"),
    start("odd", 1), finish("odd", 1, "provider_rejected"),
    start("junk", 1), finish("junk", 1, "response_received", {**TRANSCRIPTION, "kind": "parse_failure", "text": None}),
    start("twice", 1), finish("twice", 1, "rate_limited", cost="1"), finish("twice", 1, "response_received", TRANSCRIPTION, "0.25", 7.5),
    start("again", 1, "again/old"), start("again", 1), finish("again", 1, "timeout"),
]
EXPECTED = {
    "first": "success", "retry": "success", "worn": "retry_exhausted", "open": "indeterminate", "refused": "budget_refused",
    "never": "budget_refused", "beats": "success", "cut": "truncated", "quiet": "whole_unit_abstention", "barred": "content_filtered",
    "odd": "unsupported_input", "junk": "permanent_failure", "twice": "success", "again": "retry_exhausted",
}


def journal_frames(spark):
    lines = [json.dumps({**e, "journal_seq": i}) for i, e in enumerate(EVENTS)]
    events = spark.read.schema(ATTEMPT_EVENTS).json(spark.sparkContext.parallelize(lines, 3))
    fields = ("dispatch_intent_id", "run_manifest_id", "page_input_variant_id", "evaluation_unit_id", "roster_member_config_id", "dispatch_pair_id")
    intents = spark.createDataFrame([tuple(f"{i}" for _ in fields) for i in EXPECTED], list(fields))
    return intents, events


def test_terminal_outcomes(spark):
    intents, events = journal_frames(spark)
    rows = {r.dispatch_intent_id: r for r in journal.page_model_results(intents, events, "2026").collect()}
    assert {k: r.terminal_outcome for k, r in rows.items()} == EXPECTED
    assert rows["retry"].selected_attempt_id == "retry/3" and rows["retry"].attempt_ids == ["retry/1", "retry/2", "retry/3"]
    assert rows["retry"].total_cost_usd == Decimal("0.005") and rows["retry"].total_measured_duration_ms == 15.0
    assert rows["open"].attempt_ids == ["open/1", "open/2"] and rows["open"].selected_attempt_id is None
    assert rows["cut"].parsed_text == "the quick brown fox" and rows["cut"].selected_attempt_id == "cut/1"
    assert rows["cut"].eligibility == "eligible" and rows["quiet"].parsed_text is None
    assert rows["twice"].total_cost_usd == Decimal("0.25") and rows["twice"].total_measured_duration_ms == 7.5
    assert rows["again"].attempt_ids == ["again/1"] and rows["beats"].total_cost_usd == 0
    assert rows["never"].ineligibility_reasons == ["budget_refused"] and rows["never"].attempt_ids == []
    assert len({r.page_model_result_id for r in rows.values()}) == len(EXPECTED)


def test_worklist(spark):
    intents, events = journal_frames(spark)
    rows = {r.dispatch_intent_id: (r.status, r.next_attempt_number) for r in journal.resume_worklist(intents, events).collect()}
    assert rows["first"] == ("done", None) and rows["cut"] == ("done", None)
    assert rows["open"] == ("held", None) and rows["beats"] == ("held", None)
    assert rows["worn"] == ("exhausted", None)
    assert rows["never"] == ("ready", 1) and rows["refused"] == ("ready", 1) and rows["barred"] == ("ready", 3)


def d(value):
    return None if value is None else Decimal(value)


def test_batch_admission(spark):
    headrooms = spark.createDataFrame([("run", d("5")), ("open", None)], "ledger string, headroom_usd decimal(18,6)")
    requests = [("three", "m", d("2"), ["run"])] * 3 + [("two", "m", d("2"), ["run", "open"])] * 2 + [
        ("free", "m", d("900"), ["open"]), ("stray", "m", d("900"), ["unlisted"]), ("exact", "m", d("5"), ["run"]), ("none", "m", d("9"), []),
    ]
    rows = budget.admit_batches(spark.createDataFrame(requests, RESERVE_REQUESTS), headrooms).collect()
    assert {r.batch_id: r.admitted for r in rows} == {
        "three": False, "two": True, "free": True, "stray": True, "exact": True, "none": True,
    }


def test_balances_and_violations(spark):
    events = [
        (1, "run", "a", "reserve", "2"), (2, "run", "b", "reserve", "3"), (3, "run", "a", "reconcile", "2.01"), (4, "run", "a", "reconcile", "1.5"),
        (5, "run", "a", "release", "0"), (6, "run", "lost", "release", "0"), (7, "run", "b", "release", "0"), (8, "run", "c", "reconcile", "1"),
        (9, "run", "c", "reserve", "1"), (10, "run", "d", "reserve", "2"), (11, "run", "d", "reconcile", "2.5"),
    ]
    frame = spark.createDataFrame([(*e[:4], d(e[4])) for e in events], LEDGER_EVENTS)
    ledgers = spark.createDataFrame([("run", d("10")), ("idle", None)], LEDGERS)
    bad = {r.seq: r.verdict for r in budget.violations(frame).collect()}
    assert bad == {3: "overcharge", 5: "already_closed", 6: "unknown_reservation", 8: "unknown_reservation", 11: "overcharge"}
    now = {r.ledger: r for r in budget.current_balances(frame, ledgers).collect()}
    assert (now["run"].reserved_usd, now["run"].settled_usd, now["run"].headroom_usd) == (d("3"), d("1.5"), d("5.5"))
    assert now["idle"].reserved_usd == 0 and now["idle"].headroom_usd is None
    for tasks in (1, 3):
        rows = sorted(budget.running_balances(frame.repartition(tasks), ledgers).collect(), key=lambda r: r.seq)
        assert [(r.seq, r.reserved_usd, r.settled_usd) for r in rows] == [
            (1, d("2"), d("0")), (2, d("5"), d("0")), (4, d("3"), d("1.5")), (7, d("0"), d("1.5")), (9, d("1"), d("1.5")), (10, d("3"), d("1.5")),
        ]
