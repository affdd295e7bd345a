import hashlib
import json

from pyspark.sql import functions as F

from concordis.operators import ground_truth as gt
from concordis.schemas import RECORD_TYPES


def assertion(name, unit="u", guideline="g", state="transcribable", text="t"):
    return (name, unit, "gold_full", state, text, guideline, "s", "author", "2026", None)


def event(name, sequence, action, actor="x", source="human_workflow", auth=None):
    return (f"{name}/{sequence}", sequence, None, name, action, actor, source, auth, None, None, "2026")


def frames(spark, assertions, events):
    return (
        spark.createDataFrame(assertions, RECORD_TYPES["ground_truth_assertion"].schema),
        spark.createDataFrame(events, RECORD_TYPES["ground_truth_event"].schema),
    )


def approved(name):
    return [event(name, 0, "submit"), event(name, 1, "approve")]



def references(spark):
    assertions = [
        assertion("ok", "u-ok"), assertion("c1", "u-conflict"), assertion("c2", "u-conflict"), assertion("r", "u-rejected"),
        assertion("g2", "u-two", "g2", text="second"), assertion("g1", "u-two", "g1", text="first"), assertion("ill", "u-ill", state="fully_illegible"),
        assertion("blank", "u-blank", state="blank", text=None), assertion("old", "u-super"), assertion("new", "u-super", text="new"), assertion("draft", "u-draft"),
        assertion("back", "u-back"),
    ]
    events = [
        *[e for n in ("ok", "c1", "c2", "g2", "g1", "ill", "blank", "new") for e in approved(n)],
        *approved("r"), event("r", 2, "reject"), *approved("old"), event("old", 2, "supersede"), event("draft", 0, "submit"),
        event("back", 2, "approve"), event("back", 1, "reject"), event("back", 0, "submit"), *approved("ghost"),
    ]
    return frames(spark, assertions, events)


def test_reference_of_every_kind_of_unit(spark):
    assertions, events = references(spark)
    units = spark.createDataFrame(
        [(u,) for u in ("u-ok", "u-conflict", "u-rejected", "u-two", "u-ill", "u-blank", "u-super", "u-draft", "u-back", "u-absent")],
        "evaluation_unit_id string",
    )
    rows = {r.evaluation_unit_id: (r.gt_availability, r.gt_text, r.gt_assertion_id) for r in gt.gt_references(units, assertions, events).collect()}
    assert rows["u-ok"] == ("available", "t", "ok")
    assert rows["u-conflict"] == ("conflicted", None, None)
    assert rows["u-rejected"] == ("unavailable", None, None) == rows["u-draft"] == rows["u-absent"]
    assert rows["u-two"] == ("available", "first", "g1")
    assert rows["u-ill"] == ("excluded_fully_illegible", None, "ill")
    assert rows["u-blank"] == ("available", "", "blank")
    assert rows["u-super"] == ("available", "new", "new")
    assert rows["u-back"] == ("available", "t", "back")


def test_snapshot(spark):
    assertions, events = references(spark)
    entries = gt.snapshot_entries(assertions, events)
    ids = lambda kind: sorted(r.id for r in entries.where(F.col("kind") == kind).collect())
    assert ids("assertion") == sorted(["ok", "c1", "c2", "g2", "g1", "ill", "blank", "new", "back"])
    assert ids("conflicted_unit") == ["u-conflict"] and ids("unavailable_unit") == ["u-draft", "u-rejected"]
    assert "back/1" in ids("event") and "ghost/1" not in ids("event") and "r/1" not in ids("event")
    record = gt.snapshot_record(entries).head()
    payload = {f: record[f] for f in RECORD_TYPES["effective_gt_snapshot"].identity_columns}
    body = json.dumps(payload, sort_keys=True, separators=(",", ":"))
    assert record.effective_gt_snapshot_id == "effective_gt_snapshot_sha256:" + hashlib.sha256(body.encode()).hexdigest()
    digests = [gt.snapshot_record(gt.snapshot_entries(assertions, e)).head() for e in (events, events.repartition(5), events.where("event_id <> 'ok/0'"))]
    assert digests[0] == digests[1] and digests[0].event_ids[0].startswith("set_sha256:")
    assert digests[0].effective_gt_snapshot_id != digests[2].effective_gt_snapshot_id


def chain_rows(spark):
    rows = [(f"a{i}", s, action, "x", "human_workflow", None, f"why \n{s}", None, f"2026-0{s + 1}")
            for i in range(6) for s, action in enumerate(["submit", "approve", "reject"][: 1 + i % 3])]
    return spark.createDataFrame(
        rows, "assertion_id string, sequence bigint, action string, actor_id string, event_source string, approval_authorization_id string, "
        "reason string, superseded_by_assertion_id string, created_at string",
    )


def test_chains_link_by_record_hash(spark):
    events = gt.append_chains(chain_rows(spark))
    by_chain = {}
    for r in events.collect():
        by_chain.setdefault(r.assertion_id, []).append(r)
    canon = lambda row, names: json.dumps({n: row[n] for n in names}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    record = RECORD_TYPES["ground_truth_event"]
    for chain in by_chain.values():
        prior = None
        for n, r in enumerate(sorted(chain, key=lambda r: r.sequence)):
            assert r.sequence == n and r.prior_event_hash == prior
            assert r.event_id == "ground_truth_event_sha256:" + hashlib.sha256(canon(r, record.identity_columns).encode()).hexdigest()
            prior = hashlib.sha256(canon(r, record.schema.names).encode()).hexdigest()
    assert gt.broken_links(events).count() == 0


def test_tampering_is_found(spark):
    events = gt.append_chains(chain_rows(spark))
    events = spark.createDataFrame(events.collect(), events.schema)
    late = events.withColumn("created_at", F.when((F.col("assertion_id") == "a2") & (F.col("sequence") == 0), "x").otherwise(F.col("created_at")))
    assert [tuple(r) for r in gt.broken_links(late).select("assertion_id", "sequence", "problem").collect()] == [("a2", 1, "prior_hash_mismatch")]
    gap = events.where("NOT (assertion_id = 'a5' AND sequence = 1)")
    assert [tuple(r) for r in gt.broken_links(gap).select("assertion_id", "sequence", "problem").collect()] == [("a5", 2, "missing_predecessor")]
    twice = gt.broken_links(events.unionByName(events.where("assertion_id = 'a1' AND sequence = 1"))).select("problem").collect()
    assert {r.problem for r in twice} == {"duplicate_sequence"}


def test_approval_rules(spark):
    _, events = frames(spark, [assertion("a")], [
        event("a", 0, "submit", "x"), event("a", 1, "approve", "x"), event("b", 0, "submit", "x"), event("b", 1, "approve", "y"),
        event("c", 1, "approve", "y", "dataset_import"), event("d", 1, "approve", "y", "dataset_import", "auth"), event("e", 0, "submit", "y", "dataset_import", "auth"),
    ])
    assert [r.event_id for r in gt.self_approvals(events).collect()] == ["a/1"]
    assert {r.event_id: r.problem for r in gt.authorization_violations(events).collect()} == {
        "c/1": "missing_authorization", "e/0": "forbidden_authorization",
    }


def test_runs_over_the_same_units_do_not_see_each_other(spark):
    assertions, events = references(spark)
    run = lambda name, df: df.withColumn("run_manifest_id", F.lit(name))
    both = run("a", assertions).unionByName(run("b", assertions))
    units = spark.createDataFrame([(r, u) for r in "ab" for u in ("u-ok", "u-conflict")], "run_manifest_id string, evaluation_unit_id string")
    rows = gt.gt_references(units, both, events, ("run_manifest_id",)).collect()
    assert sorted((r.run_manifest_id, r.evaluation_unit_id, r.gt_availability) for r in rows) == [
        (r, u, "conflicted" if u == "u-conflict" else "available") for r in "ab" for u in ("u-conflict", "u-ok")
    ]
