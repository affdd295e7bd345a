import math

import numpy as np
import pytest

from concordis.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, place string, cell string, kind string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def plain(rows, every=50):
    """All pairs in Python integers."""
    ok = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)
    ]
    anchors = {}
    for row in ok:
        if row[0] % every == 0:
            anchors[row[0]] = min(anchors.get(row[0], row), row, key=lambda r: (r[2], r[1]))
    out = []
    for anchor, vector, label in anchors.values():
        score = lambda v: max(-hn.HIGHEST, min(hn.HIGHEST, sum(a * b for a, b in zip(vector, v))))
        rest = sorted((-score(v), i, own) for i, v, own in ok if i != anchor)
        for s, positive, own in [r for r in rest if r[2] == label][:5]:
            fits = [(t, i) for t, i, o in rest if o != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(anchor, positive, k + 1, i, -s, -t) for k, (t, i) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **options):
    return sorted(tuple(r) for r in hn.mine(frame(spark, rows), **options).collect())


def random_rows(rng, count, size, spread=0.2, labels=4):
    return [(i, [float(np.float32(x)) for x in rng.normal(0.05, spread, size)], int(rng.integers(labels))) for i in range(count)]


@pytest.mark.parametrize("options", [{}, {"held": 3, "c_slices": 4}])
def test_equals_all_pairs(spark, options):
    rows = random_rows(np.random.default_rng(1), 700, 16)
    assert mined(spark, rows, **options) == plain(rows)


def test_ties_copies_and_a_hot_vector(spark):
    rng = np.random.default_rng(2)
    few = [[0.5, 0.25, -0.5], [0.5, 0.25, 0.0], [0.25, 0.25, 0.25], [0.5, 0.125, -0.25]]
    rows = [(i, few[0] if i % 3 == 0 else few[int(rng.integers(4))], int(rng.integers(3))) for i in range(600)]
    assert mined(spark, rows, c_slices=5) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (0, [0.5, 2.0], 1), (1, [1.0], 1), (2, [], 2), (3, [1.0, 2.0, 9.0], 2), (4, [None, 1.0], 1), (5, None, 1), (6, [nan, 0.0], 2),
        (7, [inf, 1.0], 2), (8, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (9, [0.5, 1.25], 2), (9, [0.5, 1.25], 2), (50, [1.0, 1.0], 3), (-50, [0.5, 1.0], 2),
    ]
    assert mined(spark, rows) == plain(rows) != []
    assert mined(spark, []) == [] and mined(spark, rows[5:8]) == []


@pytest.mark.parametrize("spread", [1e3, 1e7, 1e12, 1e30])
def test_large_values_stay_exact(spark, spread):
    rows = random_rows(np.random.default_rng(4), 120, 5, spread, labels=2)
    assert mined(spark, rows, c_slices=2) == plain(rows)


@pytest.mark.parametrize("spread", [3, 200, 2**15, 2**24, 2**29, 2**31])
def test_packed_products_equal_plain_ones(spread):
    rng = np.random.default_rng(5)
    a, c = (rng.integers(-spread, spread, (n, 20)).astype(float) for n in (7, 33))
    held = lambda v: max(-hn.HIGHEST, min(hn.HIGHEST, v))
    want = [[held(sum(int(x) * int(y) for x, y in zip(r, s))) for s in c] for r in a]
    assert hn.scores(a, c).tolist() == want
    least_a, least_c = int(a.min()), int(c.min())
    bits = (20 * (int(a.max()) - least_a) * (int(c.max()) - least_c)).bit_length()
    assert hn._wide_scores(a, c, least_a, least_c, bits).tolist() == want
    assert hn.scores(a + 2**40, c[:1]).tolist() == [[held(sum((int(x) + 2**40) * int(y) for x, y in zip(r, c[0])))] for r in a]
