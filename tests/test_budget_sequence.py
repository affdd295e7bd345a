import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from concordis.operators import budget

REQUESTS = "batch_id string, batch_seq long, label string, amount_usd decimal(18,6), ledger_names array<string>"
HEADROOMS = "ledger string, headroom_usd decimal(18,6)"


def plain(requests, headrooms):
    """Batches one after the other; ledgers keep what is reserved."""
    held = {name: Decimal(0) for name in headrooms}
    out = {}
    for batch in sorted({(r[1], r[0]) for r in requests}):
        asked = {}
        for _, _, _, amount, names in (r for r in requests if r[0] == batch[1]):
            for name in names:
                asked[name] = asked.get(name, Decimal(0)) + amount
        short = sum(headrooms.get(n) is not None and a > headrooms[n] - held[n] for n, a in asked.items())
        if not short:
            for n, a in asked.items():
                if n in held:
                    held[n] += a
        out[batch[1]] = (not short, short)
    return out


def admitted(spark, requests, headrooms):
    rows = budget.admit_in_sequence(
        spark.createDataFrame(requests, REQUESTS).repartition(3), spark.createDataFrame(list(headrooms.items()), HEADROOMS)
    ).collect()
    assert len(rows) == len({r.batch_id for r in rows})
    return {r.batch_id: (r.admitted, r.short_ledgers) for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_equals_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    headrooms = {f"l{i}": None if i % 5 == 4 else Decimal(rng.randrange(20, 120)) for i in range(14)}
    requests = []
    for b in range(80):
        near = rng.randrange(12)
        names = [f"l{near + k}" for k in range(rng.randrange(0, 3))] + (["unknown"] if b % 7 == 0 else [])
        requests += [(f"b{b}", rng.randrange(60), str(k), Decimal(rng.randrange(1, 30)), names) for k in range(1 + b % 3)]
    seqs = {}
    requests = [(r[0], seqs.setdefault(r[0], r[1]), *r[2:]) for r in requests]
    got = admitted(spark, requests, headrooms)
    assert got == plain(requests, headrooms) and {v[0] for v in got.values()} == {True, False}


def test_reserved_amounts_are_carried_on(spark):
    two = Decimal("2.00")
    requests = [(f"b{i}", i, "x", two, ["run", "p"]) for i in range(4)] + [("free", 9, "x", two, []), ("other", 0, "x", two, ["q"])]
    got = admitted(spark, requests, {"run": Decimal("5.00"), "p": None, "q": Decimal("1.99")})
    assert got == {"b0": (True, 0), "b1": (True, 0), "b2": (False, 1), "b3": (False, 1), "free": (True, 0), "other": (False, 1)}
    # The same batches judged apart all fit.
    apart = budget.admit_batches(
        spark.createDataFrame(requests, REQUESTS), spark.createDataFrame([("run", Decimal("5.00"))], HEADROOMS)
    )
    assert apart.where(F.col("batch_id").startswith("b") & ~F.col("admitted")).count() == 0


def test_a_chain_of_ledgers_is_one_component(spark):
    pairs = [(f"b{i}", f"l{i + k:03d}") for i in range(60) for k in range(2)] + [("x", "m1"), ("y", "m1")]
    rows = budget._components(spark.createDataFrame(pairs, "batch_id string, ledger string")).collect()
    assert {r.component for r in rows if r.ledger.startswith("l")} == {"l000"} and [r.component for r in rows if r.ledger == "m1"] == ["m1"]
