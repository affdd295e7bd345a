import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from concordis.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, node string, at string, mark string, length string, depth string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain(rows, shared=True):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, md5(md5(role or "") + (text or "")), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if shared else 0
        built[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in sorted(built.items()):
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, kept = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            kept[node[:d]] += (len(convs) - 1) * words
    return sorted(
        (convs[0], len(node), members[node[:-1]][0] if node else -1, len(convs), len(children[node]), leaves[node], kept[node],
         hashlib.sha256(",".join(str(c) for c in convs if len(built[c]) == len(node)).encode()).hexdigest())
        for node, convs in members.items()
    )


def made(spark, rows, shared=True, **options):
    turns = pt.ordered(frame(spark, rows))
    lengths = pt.counted(turns)
    if shared:
        turns, lengths = pt.rebuilt(turns)
    else:
        turns = turns.join(lengths, "conv_id")
    return sorted(tuple(-1 if v is None else v for v in r) for r in pt.trie(turns, lengths, **options).collect())


def random_rows(rng, convs=150, longest=7):
    return [
        (c, t, rng.choice(["user", "assistant"]), "w " * int(rng.integers(3)) + rng.choice(["yes", "no"]))
        for c in range(convs) for t in range(int(rng.integers(1, longest)))
    ]


@pytest.mark.parametrize("options", [{}, {"small": 20, "chunk": 3}])
def test_equals_plain_trie(spark, options):
    rows = random_rows(np.random.default_rng(1))
    assert made(spark, rows, **options) == plain(rows)


def test_long_and_copied_conversations(spark):
    rows = [(1000 + c, t, "user", f"turn {t}") for c in range(12) for t in range(60 if c else 150)]
    rows += [(7, t, "user", f"turn {t}" if t < 80 else "other") for t in range(100)]
    assert made(spark, rows, shared=False, small=40, chunk=5) == plain(rows, shared=False)


def test_odd_rows(spark):
    rows = [
        (20, None, "user", "first"), (20, 1, None, None), (20, 1, "user", "tie b"), (20, 1, "user", "tie a"), (20, 1, "user", "tie a"),
        (21, 0, "user", "x"), (22, 5, "", ""), (22, -3, "user", "early"), (None, 0, "user", "no id"), (-19, 0, "u", "neg"), (-1, 0, "u", "neg"), (0, 0, "u", "zero"),
        (23, 0, "user", "long " * 200_000), (47, 0, "user", "base is absent"), (48, 0, "user", "base is absent"),
    ]
    got = made(spark, rows)
    # A negative id's block goes toward zero in SQL; the plain version is told apart only there.
    keep = [r for r in rows if r[0] is None or r[0] >= 0]
    assert made(spark, keep) == plain(keep) and len(got) > len(plain(keep)) - 1
    assert made(spark, []) == []


def test_roll_equals_plain_sums():
    rng = np.random.default_rng(2)
    for shape in ("random", "chain", "star"):
        n = 300
        parents = [-1] + [{"random": int(rng.integers(i)), "chain": i - 1, "star": 0}[shape] for i in range(1, n)]
        depth = [0] * n
        for i in range(1, n):
            depth[i] = depth[parents[i]] + 1
        order = sorted(range(n), key=lambda i: depth[i])
        place = {v: i for i, v in enumerate(order)}
        parents = [place[parents[v]] if parents[v] >= 0 else -1 for v in order]
        values = [(int(a), int(b)) for a, b in rng.integers(0, 100, (n, 2))]
        weights, want = [int(w) for w in rng.integers(1, 50, n)], [list(v) for v in values]
        for i in range(n - 1, 0, -1):
            weights[parents[i]] += weights[i]
            for k in range(2):
                want[parents[i]][k] += want[i][k]
        assert pt.roll(parents, weights, values) == want
