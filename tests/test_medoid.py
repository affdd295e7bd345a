import random

from pyspark.sql import functions as F

from concordis.functions._bitparallel import edit_distance
from concordis.functions._medoid import bounds, medoid
from concordis.functions.text import ILLEGIBLE_MARKER
from concordis.operators import alignment as al
from tests.plain_dp import plain_script
from tests.test_alignment import unit_rows

SCHEMA = "run_manifest_id string, evaluation_unit_id string, page_model_result_id string, position int, text string"


def edited(rng, text, times, letters="abcdef "):
    out = list(text)
    for _ in range(times):
        at = rng.randrange(len(out) + 1)
        if rng.random() < 0.4 and at < len(out):
            out[at] = rng.choice(letters)
        elif rng.random() < 0.5 and at < len(out):
            del out[at]
        else:
            out.insert(at, rng.choice(letters))
    return "".join(out)


def by_all_pairs(texts, copies):
    sums = [sum(w * len(plain_script(a, b)[1]) for b, w in zip(texts, copies)) for a in texts]
    return sums.index(min(sums))


def test_equals_all_pairs_on_small_rosters():
    rng = random.Random(11)
    for _ in range(250):
        base = "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
        texts = list(dict.fromkeys(edited(rng, base, rng.randrange(6), "abc") for _ in range(rng.randrange(1, 7))))
        copies = [rng.choice((1, 1, 2, 5)) for _ in texts]
        assert medoid(texts, copies, edit_distance)[0] == by_all_pairs(texts, copies), (texts, copies)


def test_bounds_hold_the_distance():
    rng = random.Random(3)
    texts = ["", "a", *("".join(rng.choice("abcd") for _ in range(rng.randrange(20))) for _ in range(20))]
    for members in (texts, [list(t) for t in texts]):
        low, high = bounds(members)
        for i, a in enumerate(texts):
            for j, b in enumerate(texts):
                assert low[i, j] == low[j, i] <= edit_distance(a, b) <= high[i, j] == high[j, i]


def test_members_that_only_replace_need_no_pair():
    text = "a man on the moon, " * 40
    texts = [text, text.replace("a", "@"), text.replace("n", "#"), text.replace("o", "0")]
    assert medoid(texts, [1] * 4, None) == (0, 0)


def test_rosters_of_fifty_solve_few_pairs():
    rng = random.Random(7)
    solved = []
    for _ in range(6):
        base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300))
        # Some members read well, most badly.
        texts = [edited(rng, base, 2 + 2 * n, "abcdefghijklmnopqrstuvwxyz ") for n in range(50)]
        rng.shuffle(texts)
        sums = [sum(edit_distance(a, b) for b in texts) for a in texts]
        place, pairs = medoid(texts, [1] * 50, edit_distance)
        assert place == sums.index(min(sums))
        solved.append(pairs)
    assert max(solved) < 50 * 49 // 2 // 2, solved


def test_two_texts_need_no_pair():
    assert medoid(["a", "b"], [1, 1], None) == (0, 0)
    assert medoid(["a", "b"], [1, 2], None) == (1, 0)
    assert medoid(["a"], [4], None) == (0, 0)


def test_units_equal_the_full_pairing(spark):
    rng = random.Random(23)
    units = [("solo",), ("", ""), ("", "a"), ("x", "y", "y"), (f"a{ILLEGIBLE_MARKER}", "ab", f"{ILLEGIBLE_MARKER}b", "a")]
    for _ in range(60):
        base = "".join(rng.choice("abcd ") for _ in range(rng.randrange(30)))
        units.append(tuple(edited(rng, base, rng.randrange(5)) for _ in range(rng.randrange(1, 9))))
    texts = al.distinct_texts(al.ranked_members(spark.createDataFrame(unit_rows(units), SCHEMA).repartition(3)))
    full = {r.evaluation_unit_id: r.centre_index for r in al.centre_ranks(al.pair_distances(texts)).collect()}
    found = al.unit_centres(texts).collect()
    assert len(found) == len(units)
    assert {r.evaluation_unit_id: r.centre_index for r in found} == {str(u): full.get(str(u), 0) for u in range(len(units))}
    pairs = {r.evaluation_unit_id: r["count"] for r in al.pair_distances(texts).groupBy("evaluation_unit_id").count().collect()}
    assert all(r.solved_pairs <= pairs.get(r.evaluation_unit_id, 0) for r in found)
    assert sum(r.solved_pairs for r in found) < sum(pairs.values())
