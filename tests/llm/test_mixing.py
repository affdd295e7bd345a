import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordis.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), ratio=1.5, limit=2.0):
    """Share by weight; cut at the limit; share the rest again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, total = {}, ratio * sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > limit * sizes[s]]
        if not over:
            return {**stopped, **share}
        stopped |= {s: limit * sizes[s] for s in over}


@pytest.fixture(scope="module")
def mixed(documents):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        source = None if i % 11 == 0 else f"s{min(i % 7, 4)}"
        rows.append((i, " ".join(f"w{rng.integers(50)}" for _ in range(int(rng.integers(0, 80)))), "en", source))
    rows += [(1000, None, "en", "s1"), (1001, "big " * 5000, "en", "s2"), (7, "twin twin", "en", "s3"), (7, "twin twin", "en", "s3")]
    docs = documents(rows)
    return rows, docs, mixing.mix(docs, block_words=16, shard_slots=32)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets(mixed):
    rows, _, (_, sources, _) = mixed
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += size(text)
    expected = plain_targets(sizes)
    found = {None if r.no_source else r.source_name: r for r in sources.collect()}
    assert {s: r.source_size for s, r in found.items()} == dict(sizes)
    for s, r in found.items():
        assert r.target == pytest.approx(expected[s])


def test_taken_words(mixed):
    """Each source meets its target within a block; no row more than twice; pieces match a plain replay."""
    rows, _, (sized, sources, pieces) = mixed
    target = {(r.no_source, r.source_name): r.target for r in sources.collect()}
    taken, by_row, words = Counter(), Counter(), {}
    for p in pieces.collect():
        key = (p.no_source, p.source_name)
        taken[key] += p.words
        by_row[(*key, p.row_no)] += p.words
        words.setdefault((*key, p.pass_no, p.row_no), []).append((p.from_word, p.words))
    for key, want in target.items():
        assert abs(taken[key] - want) <= 16
    sizes = {(r.no_source, r.source_name, r.row_no): r["size"] for r in sized.collect()}
    assert all(by_row[k] <= 2 * sizes[k] for k in by_row)
    for ranges in words.values():  # inside a pass no word is taken twice
        ranges.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(ranges, ranges[1:]))


def test_slots_are_consecutive_and_counts_are_drawn(mixed):
    _, _, (_, sources, _) = mixed
    plans = mixing.plan_slots(sources, 16)
    counts = mixing.draw_counts(plans, 32)
    slots = mixing.assign_blocks(plans, counts, 16).collect()
    wanted = {(r.no_source, r.source_name): r for r in plans.collect()}
    per_source, per_pass = {}, {}
    for s in slots:
        key = (s.no_source, s.source_name)
        per_source.setdefault(key, []).append(s.slot)
        per_pass.setdefault((*key, s.pass_no), []).append(s.block)
    for key, numbers in per_source.items():
        assert sorted(numbers) == list(range(wanted[key].slots))
    for (*key, pass_no), blocks in per_pass.items():
        assert len(set(blocks)) == len(blocks)
        if pass_no < wanted[tuple(key)].passes:
            assert sorted(blocks) == list(range(wanted[tuple(key)].blocks))
    drawn = Counter()
    for r in counts.collect():
        drawn[r.shard] += r.slot_count
    assert len(drawn) > 3 and sum(drawn.values()) == len(slots)


def test_reruns_agree(mixed):
    _, docs, (_, _, pieces) = mixed
    again = mixing.mix(docs.repartition(5), block_words=16, shard_slots=32)[2]
    assert sorted(map(tuple, pieces.collect())) == sorted(map(tuple, again.collect()))


def test_mixed_documents(mixed):
    rows, docs, (_, _, pieces) = mixed
    out = mixing.mixed_documents(docs, block_words=16, shard_slots=32).collect()
    assert sum(size(r.text) for r in out) == pieces.agg(F.sum("words")).first()[0]
    texts = {}
    for i, text, *_ in rows:
        texts.setdefault(i, []).append(text or "")
    for r in out:
        assert r.n_chars == len(r.text)
        have = [Counter(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts[r.doc_id]]
        assert any(not Counter(r.text.split()) - h for h in have)


def test_white_space_inside_a_take_stays(documents):
    rng = np.random.default_rng(8)
    texts = ["".join(f"w{k}" + rng.choice([" ", "\n", "\t\t", " \r\n", "\x0b"]) for k in range(int(rng.integers(1, 60)))) for _ in range(40)]
    out = mixing.mixed_documents(documents([(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]), block_words=7, shard_slots=8).collect()
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t)
    partial = 0
    for r in out:
        own = iter(cut(texts[r.doc_id]))
        *body, last = cut(r.text)
        assert all(any(piece == o for o in own) for piece in body) and any(o.startswith(last) for o in own)
        partial += r.text != texts[r.doc_id]
    assert partial > 5


def test_blocks_are_made_by_many_tasks(spark, documents):
    _, sources, _ = mixing.mix(documents([(1, "a b c", "en", "s")]))
    wide = sources.withColumn("blocks", F.lit(3_000_000).cast("long"))
    made = mixing._counted(wide, "blocks", "block", 3_000_000)
    tasks = made.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert sum(r["count"] for r in tasks) == 3_000_000 and len(tasks) >= 12 and max(r["count"] for r in tasks) < 1_000_000


def test_odd_rows(documents, odd_texts):
    rows, sources, pieces = mixing.mix(documents(odd_texts), block_words=8)
    assert rows.count() == len(odd_texts)
    assert pieces.where("words <= 0").count() == 0
    assert mixing.mixed_documents(documents(odd_texts), block_words=8).count() > 0


def test_empty_table(documents):
    rows, sources, pieces = mixing.mix(documents([]))
    assert (rows.count(), sources.count(), pieces.count()) == (0, 0, 0)
    assert mixing.mixed_documents(documents([])).collect() == []


def test_short_last_block_meets_the_target(documents):
    """Sources of 300 words and many seeds: the 44-word block comes first in the partial pass for some of them."""
    rows = [(i, "w " * 300, "en", f"s{i}") for i in range(3)]
    for seed in range(3):
        _, sources, pieces = mixing.mix(documents(rows), seed=seed)
        taken = {r["source_name"]: r["sum(words)"] for r in pieces.groupBy("source_name").sum("words").collect()}
        assert taken == {r.source_name: round(r.target) for r in sources.collect()}
