import pytest
from pyspark.sql import functions as F

from concordis.operators import ground_truth as gt

ACTIONS = (
    "assertion_id string, sequence long, action string, actor_id string, event_source string, approval_authorization_id string, "
    "reason string, superseded_by_assertion_id string, created_at string"
)


def actions(spark, *rows):
    full = [(a, n, act, who, src, auth, None, None, f"2026-01-{n + 1:02d}") for a, n, act, who, src, auth in rows]
    return spark.createDataFrame(full, ACTIONS)


def step(assertion, number, action="submit", who="one", source="human_workflow", authorization=None):
    return (assertion, number, action, who, source, authorization)


def listed(events):
    return sorted(tuple(r) for r in events.collect())


ROWS = [step(f"a{i}", n, ("submit", "reject", "supersede")[n % 3]) for i in range(5) for n in range(2 + 3 * i)]


def test_calls_equal_one_build(spark, tmp_path):
    store = gt.ChainStore(spark, str(tmp_path / "s"))
    for low, high in ((0, 1), (1, 4), (4, 99)):
        assert store.append(actions(spark, *[r for r in ROWS if low <= r[1] < high])).count() == 0
    whole = gt.append_chains(actions(spark, *ROWS))
    assert listed(store.events()) == listed(whole)
    assert gt.broken_links(store.events()).count() == 0
    assert listed(store.heads()) == listed(gt.chain_heads(whole)) and store.heads().count() == 5


def test_a_cut_off_call_is_done_again(spark, tmp_path):
    store = gt.ChainStore(spark, str(tmp_path / "s"))
    store.append(actions(spark, *[r for r in ROWS if r[1] < 2]))
    before = listed(store.events())
    heads = store.heads
    store.heads = lambda: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.append(actions(spark, step("a0", 2)))
    store.heads = heads
    # Events of call 2 reach the store, its heads do not: readers do not see them.
    store._write(gt.append_chains(actions(spark, step("a0", 2, who="stray")), "sequence", store.heads()), store.events_path, 2)
    assert listed(store.events()) == before
    store.append(actions(spark, *[r for r in ROWS if r[1] >= 2]))
    assert listed(store.events()) == listed(gt.append_chains(actions(spark, *ROWS)))


def test_refused_actions_enter_no_chain(spark, tmp_path):
    claims = spark.createDataFrame([("a", "one"), ("b", "two")], "assertion_id string, author_actor_id string")
    rows = [
        step("a", 0), step("a", 1, "approve", "one"), step("a", 2, "approve", "two"), step("b", 0, "approve", "x", "dataset_import"),
        step("b", 1, "approve", "two", "dataset_import", "auth"), step("b", 2, "reject", "x", authorization="auth"), step("c", 0, "approve", "any"),
    ]
    store = gt.ChainStore(spark, str(tmp_path / "s"))
    refused = store.append(actions(spark, *rows), claims)
    assert {(r.assertion_id, r.sequence, r.refusal) for r in refused.collect()} == {
        ("a", 1, "self_approval"), ("b", 0, "authorization_missing"), ("b", 2, "authorization_forbidden")
    }
    kept = store.events().orderBy("assertion_id", "sequence").collect()
    assert [(r.assertion_id, r.sequence, r.actor_id) for r in kept] == [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "two"), ("c", 0, "any")]
    assert gt.self_approvals(store.events().join(claims.select("assertion_id"), "assertion_id", "left_semi")).where(F.col("actor_id") == "one").count() == 0
