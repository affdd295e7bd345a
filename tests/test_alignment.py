import math
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from concordis.functions import edits
from concordis.operators import alignment as al
from concordis.operators import artifacts
from tests.plain_dp import plain_script


def unit_rows(units):
    return [
        ("r", str(u), f"res-{u}-{p}", p, text) for u, texts in enumerate(units) for p, text in enumerate(texts)
    ]


def aligned(spark, units):
    rows = unit_rows(units)
    df = spark.createDataFrame(
        rows, "run_manifest_id string, evaluation_unit_id string, page_model_result_id string, position int, text string"
    )
    return al.align(df.repartition(3))


def by_unit(df, *columns):
    return {int(r.evaluation_unit_id): (r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns)) for r in df.collect()}


def matrix(alignment):
    out = {}
    for r in al.aligned_rows(alignment).collect():
        out.setdefault(int(r.evaluation_unit_id), {})[r.hyp_index] = tuple(r.symbols)
    return out


GOLDEN = [
    ("cat", "cat"),
    ("cat", "cot"),
    ("cat", "cots"),
    ("cats", "cat"),
    ("ac", "aXYZc", "aWc"),
    ("cat", "cot", "cut"),
    ("cat", "cat", "cats"),
    ("solo",),
    ("", ""),
    ("the <ILLEGIBLE> cat", "the big cat"),
    ("cat", "cat", "cat"),
    ("abc", "abd", "xyz"),
    ("the quick brown fox", "the quick brown fax"),
    ("a\r\nb", "a\nb"),
]


def test_goldens(spark):
    a = aligned(spark, GOLDEN)
    rows = matrix(a)
    assert rows[0] == {0: ("c", "a", "t"), 1: ("c", "a", "t")}
    assert rows[4][0] == ("a", None, None, None, "c")
    assert rows[4][1] == ("a", "X", "Y", "Z", "c")
    assert rows[4][2] == ("a", "W", None, None, "c")
    assert rows[3] == {0: ("c", "a", "t", "s"), 1: ("c", "a", "t", None)}
    assert rows[9][0].count("<ILLEGIBLE>") == 1
    assert rows[13][0] == rows[13][1] == ("a", "\n", "b")
    ce = by_unit(al.consensus_entropy(a), "consensus_entropy")
    assert ce[0] == 0.0 and ce[10] == 0.0
    assert math.isclose(ce[1], 1 / 3) and math.isclose(ce[5], 1 / 3)
    assert ce[7] is None and ce[8] is None
    assert math.isclose(ce[12], 1 / 19)
    fused = by_unit(al.fused_texts(a), "fused_text")
    assert fused[5] == "cat" and fused[6] == "cat" and fused[7] == "solo" and fused[8] == ""
    assert by_unit(a.centres, "centre_index")[11] == 0
    ties = by_unit(al.fused_texts(a), "tied_columns")
    assert ties[5] == 1 and ties[0] == 0
    gap = [r for r in al.fusion_columns(a).collect() if r.evaluation_unit_id == "6"]
    assert len(gap) == 1 and gap[0].winning_symbol is None and not gap[0].emitted and not gap[0].tie


def plain_matrix(texts):
    k = len(texts)
    if k == 1:
        return 0, [list(texts[0])]
    cost = [[plain_script(texts[i], texts[j])[0] if i < j else 0 for j in range(k)] for i in range(k)]
    total = [sum(cost[min(i, j)][max(i, j)] for j in range(k)) for i in range(k)]
    centre = total.index(min(total))
    n = len(texts[centre])
    runs = [[[] for _ in range(n + 1)] for _ in range(k)]
    facing = [list(texts[centre]) for _ in range(k)]
    for i in range(k):
        if i != centre:
            for slot, inserted, token in plain_script(texts[centre], texts[i])[1]:
                if inserted:
                    runs[i][slot].append(token)
                else:
                    facing[i][slot] = token
    out = [[] for _ in range(k)]
    for slot in range(n + 1):
        width = max(len(runs[i][slot]) for i in range(k))
        for i in range(k):
            out[i] += runs[i][slot] + [None] * (width - len(runs[i][slot]))
            if slot < n:
                out[i].append(facing[i][slot])
    return centre, out


def test_random_units_match_a_plain_merge(spark):
    rng = random.Random(3)
    units = []
    for _ in range(120):
        base = "".join(rng.choice("abc") for _ in range(rng.randrange(14)))
        texts = []
        for _ in range(rng.randrange(1, 6)):
            t = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(t) + 1)
                if rng.random() < 0.5:
                    t.insert(at, rng.choice("abcd"))
                elif t:
                    t[min(at, len(t) - 1)] = rng.choice(["", "d", "a"])
            texts.append("".join(t))
        units.append(tuple(texts))
    a = aligned(spark, units)
    rows, ce = matrix(a), by_unit(al.consensus_entropy(a), "consensus_entropy", "column_count")
    fused, centres = by_unit(al.fused_texts(a), "fused_text"), by_unit(a.centres, "centre_index")
    pairs = {(int(r.evaluation_unit_id), r.hyp_index): (r.centre_symbols, r.other_symbols) for r in al.pair_alignments(a).collect()}
    detail = {}
    for r in al.indexed_columns(al.fusion_columns(a)).collect():
        detail[int(r.evaluation_unit_id), r.col_idx] = r
    for u, texts in enumerate(units):
        centre, expected = plain_matrix(texts)
        k, width = len(texts), len(expected[0])
        assert centres[u] == centre
        assert [list(rows[u][i]) for i in range(k)] == expected
        assert ce[u][1] == width
        entropy, text = 0.0, ""
        for c in range(width):
            votes = {}
            for i in range(k):
                votes.setdefault(expected[i][c], []).append(i)
            entropy += -sum(len(v) / k * math.log(len(v) / k) for v in votes.values()) / (math.log(k) if k > 1 else 1)
            best = max(len(v) for v in votes.values())
            winner = min((v for v in votes.values() if len(v) == best), key=min)
            text += expected[winner[0]][c] or ""
            if len(votes) > 1:
                found = detail.pop((u, c))
                assert [(x.symbol, x.supporters) for x in found.candidates] == list(votes.items())
                assert found.tie == (sum(len(v) == best for v in votes.values()) > 1)
        assert fused[u] == text
        if k < 2 or width == 0:
            assert ce[u][0] is None
        else:
            assert math.isclose(ce[u][0], entropy / width, abs_tol=1e-12)
        for i in range(k):
            if texts[i] != texts[centre]:
                left, right = pairs[u, i]
                assert "".join(x or "" for x in left) == texts[centre]
                assert "".join(x or "" for x in right) == texts[i]
    assert not detail


def test_partition_count_does_not_change_results(spark):
    df = spark.createDataFrame(
        unit_rows(GOLDEN), "run_manifest_id string, evaluation_unit_id string, page_model_result_id string, position int, text string"
    )
    results = []
    for parts in (1, 8):
        a = al.align(df.repartition(parts))
        results.append(sorted(map(tuple, al.fused_texts(a).collect())))
    assert results[0] == results[1]


def test_consensus_records(spark):
    a = aligned(spark, [("cat", "cot"), ("solo",)])
    consensus, fused = al.consensus_records(a, artifacts.build(a).headers, "file:/x", "2026-01-01T00:00:00Z")
    c = {r.evaluation_unit_id: r for r in consensus.collect()}
    f = {r.evaluation_unit_id: r for r in fused.collect()}
    assert c["0"].consensus_result_id == f["0"].consensus_result_id
    assert c["0"].alignment_artifact_sha256 == f["0"].alignment_artifact_sha256
    assert f["0"].text == "cat" and c["1"].consensus_entropy is None
    assert c["0"].eligible_page_model_result_ids == ["res-0-0", "res-0-1"]


def test_entropy_is_the_same_sum_in_any_order_of_rows(spark):
    text = "abcdefgh" * 700
    members = (text, text.replace("a", "x").replace("b", "y"), text.replace("a", "x").replace("c", "z"), text.replace("h", ""), text)
    found = by_unit(al.consensus_entropy(aligned(spark, [members])), "consensus_entropy")[0]
    share = lambda *votes: (math.log(5) - sum(n * math.log(n) for n in votes) / 5) / math.log(5)
    # Bit for bit: equal columns are counted, so no sum runs over 700 of them.
    assert found == (700 * share(4, 1) * 3 + 700 * share(2, 3)) / 5600 or found == (2100 * share(4, 1) + 700 * share(2, 3)) / 5600


def test_spliced_text_keeps_markers_and_inserted_runs(spark):
    units = [("a<ILLEGIBLE>cd", "a<ILLEGIBLE>cXYd", "a<ILLEGIBLE>cXYd"), ("", "ab", "ab"), ("ab", "", ""), ("é<b", "é<b", "<b")]
    assert by_unit(al.fused_texts(aligned(spark, units)), "fused_text") == {0: "a<ILLEGIBLE>cXYd", 1: "ab", 2: "", 3: "é<b"}


def test_fused_texts_take_the_winners_of_the_fusion_columns(spark):
    rng = random.Random(23)
    units = [[["".join(rng.choice("ab") for _ in range(rng.randrange(7)))][0] for _ in range(rng.randrange(1, 7))] for _ in range(120)]
    alignment = aligned(spark, units)
    winners = {}
    for r in al.all_fusion_columns(alignment).collect():
        winners.setdefault(int(r.evaluation_unit_id), []).append((r.slot, r.lane, r.winning_symbol or "", r.tie))
    for unit, (text, tied) in by_unit(al.fused_texts(alignment), "fused_text", "tied_columns").items():
        columns = sorted(winners.get(unit, []))
        assert text == "".join(c[2] for c in columns)
        assert tied == sum(c[3] for c in columns)


def test_rows_as_texts_are_those_of_the_matrix(spark):
    rng = random.Random(12)
    drawn = [tuple("".join(rng.choice("abc\U0001f600") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    a = al.materialized(aligned(spark, [*GOLDEN, *drawn, ("a<ILLEGIBLE>b", "ab", "axb"), ("", "ab", "b")]))
    rows = matrix(a)
    for gap in ("", "-", "[gap]"):
        found = al.aligned_texts(a, gap).collect()
        assert len(found) == sum(map(len, rows.values()))
        for r in found:
            symbols = rows[int(r.evaluation_unit_id)][r.hyp_index]
            assert (r.columns, r.row_text) == (len(symbols), "".join(gap if s is None else s for s in symbols))


def test_rows_solve_each_script_once(spark):
    plan = al.aligned_rows(aligned(spark, [("cat", "cot", "cats")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("edit_script(") == 1


def test_entropy_makes_no_row_of_a_column(spark):
    a = aligned(spark, [("cat", "cot", "cats"), ("solo",), ("", "ab")])
    plan = al.consensus_entropy(a)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_scripts_of_the_search_for_the_centre_are_kept():
    text = "the thin man on the moor and the other thing " * 8
    roster = [text.replace("e", "3"), text.replace("th", "tli"), text.replace("o", "#"), text.replace("th", "tli").replace("o", "#")]
    marked = ["a<ILLEGIBLE>bcd", "abxcd", "a<ILLEGIBLE>bxcdd", "zab<ILLEGIBLE>"]
    for texts in (roster, marked):
        found = edits.solved_centre.func(pa.array([texts]), pa.array([[1] * len(texts)])).to_pylist()[0]
        place, kept = found["place"], found["scripts"]
        assert kept[place] is None and any(kept)
        rest = edits.roster_edit_script.func(pa.array([place]), pa.array([texts])).to_pylist()[0]
        plain = edits.edit_script.func(pa.array([texts[place]] * len(texts)), pa.array(texts)).to_pylist()
        assert rest == [None if k == place else script for k, script in enumerate(plain)]
        assert all(script is None or script == rest[k] for k, script in enumerate(kept))


def test_a_batch_of_scripts_is_not_held_as_lists():
    text = "abcdefgh" * 200
    pairs = [(f"{n}" + text, f"{n}" + text.replace("a", "#").replace("b", "$")) for n in range(2000)]
    left, right = (pa.array(side) for side in zip(*pairs))
    tracemalloc.start()
    found = edits.edit_script.func(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 2000 and len(found[1999]) == 400
    assert found[7].as_py()[1] == {"slot": 2, "lane": edits.CENTRE_LANE, "symbol": "$", "centre_symbol": "b"}
    # 800,000 entries as lists of Python objects took over 30 MB.
    assert peak < 16 << 20


def test_texts_move_once_and_nothing_is_stored(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(al, "stored", lambda df: kept.append(df) or df)
    a = al.align(spark.createDataFrame([("r", "u", n, text) for n, text in enumerate(("cat", "cot", "cats"))], "run_manifest_id string, evaluation_unit_id string, position int, text string"))
    for rows in (al.aligned_texts(a), al.consensus_entropy(a), al.fused_texts(a)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
    assert not kept


def test_units_fold_copies_and_keep_null_texts():
    rosters = [["cat", None, "cot", "cat"], ["b", "a", "a"], [None], ["x", None]]
    found = edits.unit_edit_script.func(pa.array(rosters, pa.list_(pa.string()))).to_pylist()
    assert [r["centre_ranks"] for r in found] == [[0, 3], [1, 2], [0], [0]]
    assert [[(o["hyp_index"], o["member_ranks"], o["script"] and len(o["script"])) for o in r["readings"]] for r in found] == [
        [(1, [1], None), (2, [2], 1)], [(0, [0], 1)], [], [(1, [1], None)]
    ]
    centres = edits.unit_centre.func(pa.array(rosters, pa.list_(pa.string()))).to_pylist()
    assert centres == [{k: r[k] for k in ("centre_index", "centre_ranks")} for r in found]


def test_fused_text_and_entropy_come_from_one_pass(spark):
    a = aligned(spark, [*GOLDEN, ("cat", "cot", "cats", "cot"), ("solo",), ("", "ab")])
    both = al.fused_with_entropy(a)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("edit_script(") == 1 and "Join" not in plan
    unit = lambda r: r.evaluation_unit_id
    found = sorted(both.select("evaluation_unit_id", "fused_text", "tied_columns", "consensus_entropy", "column_count").collect(), key=unit)
    fused, entropy = (sorted(rows.collect(), key=unit) for rows in (al.fused_texts(a), al.consensus_entropy(a)))
    assert [(unit(r), r.fused_text, r.tied_columns) for r in found] == [(unit(r), r.fused_text, r.tied_columns) for r in fused]
    assert [(r.consensus_entropy, r.column_count) for r in found] == [(r.consensus_entropy, r.column_count) for r in entropy]
