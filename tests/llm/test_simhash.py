import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from concordis.llm import simhash as sh


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=4):
    """Component of every fingerprint by comparing all pairs."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_words_of_the_code_share_keys_within_two_bits():
    """All 2048 remainders (words up to a code word) against all errors of up to two bits."""
    tables = sh.golay_tables()
    words = np.arange(2048, dtype=np.int64)  # every remainder occurs once
    assert len({sh._remainder(int(w)) for w in words}) == 2048
    own = sh.segment_keys(words, tables)
    assert sorted(set((own >= 0).sum(axis=1).tolist())) == [1, 6]
    for error in [0, *(1 << i for i in range(23)), *(1 << i | 1 << j for i in range(23) for j in range(i))]:
        other = sh.segment_keys(words ^ error, tables)
        shared = (own[:, :, None] == other[:, None, :]) & (own[:, :, None] >= 0)
        assert shared.any(axis=(1, 2)).all()


def test_fingerprints_with_up_to_four_differing_bits_share_a_key():
    rng, tables = random.Random(7), sh.golay_tables()
    base = np.array([rng.getrandbits(64) for _ in range(2000)], dtype=np.uint64)
    near = np.array([int(x) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for x in base], dtype=np.uint64)
    keys = lambda fps: [set() for _ in fps]
    own, other = keys(base), keys(near)
    for fps, sets in ((base, own), (near, other)):
        for row, key in zip(*sh.fuzzy_keys(fps.view(np.int64), tables)):
            sets[row].add(int(key))
    assert all(a & b for a, b in zip(own, other))


def test_fingerprint_of_texts(odd_texts):
    for _, text, *_ in odd_texts:
        assert sh.simhash(text) == plain_fingerprint(text)


@pytest.mark.parametrize("block", [4096, 3])
def test_components_equal_all_pairs(spark, block):
    """Chains, a dense cluster and scattered prints; small blocks force the dealt path."""
    rng, prints = random.Random(block), []
    for _ in range(20):
        x = rng.getrandbits(64)
        prints.append(x)
        for _ in range(rng.randint(0, 6)):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            prints.append(x)
    centre = rng.getrandbits(64)
    prints += [centre ^ sum(1 << b for b in rng.sample(range(12), 3)) for _ in range(60)]
    prints = sorted(set(prints))
    ids = list(range(len(prints)))
    rng.shuffle(ids)
    signed = np.array(prints, dtype=np.uint64).view(np.int64)
    rows = spark.createDataFrame([(int(i), int(p)) for i, p in zip(ids, signed)], "first_id long, fp long")
    at = lambda side: rows.select(F.col("fp").alias(side), F.col("first_id").alias(f"{side}_id"))
    edges = sh.links(rows, block=block).join(at("a"), "a").join(at("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    found = {r.node: r.component for r in sh.components(edges).collect()}
    roots = plain_components(prints)
    least = {}
    for i, r in zip(ids, roots):
        least[r] = min(least.get(r, i), i)
    assert {i: found.get(i, i) for i in ids} == {i: least[r] for i, r in zip(ids, roots)}


def test_forest_has_fewer_links_than_rows():
    prints = np.array([1 << i for i in range(40)], dtype=np.int64)
    assert len(sh.forest(prints, 4)) == 39


def test_odd_rows(documents, odd_texts):
    found = {(r.doc_id, r.fingerprint): r.component_id for r in sh.near_dedup(documents(odd_texts)).collect()}
    zero = "0" * 16
    assert found[(3, zero)] == found[(4, zero)] == found[(5, zero)] == 3
    assert {found[k] for k in found if k[0] in (1, 2)} == {1}
    assert {found[k] for k in found if k[0] in (8, 10)} == {8}
    assert {found[k] for k in found if k[0] in (6, 7)} == {6}
    assert len(sh.near_dedup(documents(odd_texts)).collect()) == len(odd_texts)
    kept = sh.kept_documents(documents(odd_texts)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept) == [-1, 1, 3, 6, 8, 9]


def test_empty_table(documents):
    assert sh.near_dedup(documents([])).collect() == []


def plain_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows, similarity=0.8):
    """Smallest ids of the components of all pairs with at least this similarity of five-word sets."""
    sets, parent = {i: plain_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if j < i and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i for i in ids if root(i) == i}


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [4096, 20])
def test_stage_finds_all_pairs_of_similarity(documents, block):
    """Edited copies from near 1 down to below 0.8, chains and a large group, against all pairs by brute force."""
    rng, rows = random.Random(11), []
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(150, 400))]
        rows.append(" ".join(words))
        rows += [edited(rng, words, max(1, len(words) * k // 400)) for k in (1, 4, 8, 9, 10)]
    words = [f"v{rng.randrange(3000)}" for _ in range(200)]
    rows += [edited(rng, words, 1 + i % 4) for i in range(80)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    kept = {r.doc_id for r in sh.kept_documents(documents(rows), block=block).collect()}
    assert kept == plain_kept(rows)


def test_wide_fingerprints_tell_the_similarity():
    grams = np.unique(np.random.default_rng(3).integers(0, 2**63, 9000).astype(np.uint64))
    bits = lambda g: np.frombuffer(sh.wide_simhash(g), np.uint64)
    near = int(np.bitwise_count(bits(grams[:8000]) ^ bits(grams[889:8889])).sum())
    far = int(np.bitwise_count(bits(grams[:4000]) ^ bits(grams[4000:8000])).sum())
    assert near <= sh.STAGE_RADIUS < far


@pytest.mark.parametrize("sizes", [(5, 4, 4), (10, 8, 8), (9, 9, 8), (45, 45, 40), (360, 360, 320), (500, 400, 400)])
def test_sets_of_similarity_share_a_pair_of_code_words(sizes):
    """At a similarity of exactly 0.8: a key of Golay words in common, and fingerprints within the radius."""
    (first, second, both), rng = sizes, np.random.default_rng(sum(sizes))
    grams = [rng.integers(0, 2**63, first + second - both).astype(np.uint64) for _ in range(1000)]
    sides = [np.array([sh.votes(g[part]) for g in grams]) for part in (slice(first), slice(first - both, None))]
    own, other = (sh.stage_keys(side, sh.golay_signs()) for side in sides)
    assert all(np.intersect1d(a, b).size for a, b in zip(own, other))
    bits = [side[:, : sh.STAGE_BITS] > 0 for side in sides]
    assert (bits[0] != bits[1]).sum(axis=1).max() <= sh.STAGE_RADIUS


def test_stage_keys_are_the_nearest_pairs_of_code_words():
    rng, signs = np.random.default_rng(8), sh.golay_signs()
    code = np.empty((4096, 23))
    code[0::2], code[1::2] = signs.T, -signs.T
    numbers = [sum(1 << b for b in range(23) if word[b] > 0) for word in code]
    assert len(set(numbers)) == 4096 and not any(map(sh._remainder, numbers))
    margins = rng.integers(-40, 41, (300, sh.VOTED_BITS))
    agreement = np.stack([margins[:, 23 * i : 23 * i + 23] @ code.T for i in range(2 * sh.STAGE_PAIRS)])
    listed = -np.sort(-agreement, axis=2)[:, :, : sh.LISTED]
    keys = sh.stage_keys(margins, signs).reshape(300, sh.STAGE_PAIRS, sh.PROBES)
    for row in range(300):
        assert len(set(keys[row].ravel().tolist())) == sh.STAGE_PAIRS * sh.PROBES
        for pair in range(sh.STAGE_PAIRS):
            key = keys[row, pair]
            assert (key >> 24 == pair).all()
            found = agreement[2 * pair, row, key >> 12 & 4095] + agreement[2 * pair + 1, row, key & 4095]
            sums = np.add.outer(listed[2 * pair, row], listed[2 * pair + 1, row]).ravel()
            assert np.array_equal(np.sort(found), np.sort(sums)[-sh.PROBES :])


def test_stage_takes_its_candidates_from_golay_keys(documents, monkeypatch):
    """Near texts are joined, but not when they are given keys of their own instead of code words."""
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1]))]
    assert [r.doc_id for r in sh.kept_documents(documents(rows)).collect()] == [1]
    # The number of shingles is a margin's parity, so the two texts get different keys.
    monkeypatch.setattr(sh, "stage_keys", lambda margins, signs: (margins[:, :1] % 2).astype(np.int32))
    assert sorted(r.doc_id for r in sh.kept_documents(documents(rows)).collect()) == [1, 2]


@pytest.mark.parametrize("paired", [32, 2])
def test_pairs_of_sorted_keys(paired, monkeypatch):
    """Small and large groups, neighbours of another group, against all pairs: equal components."""
    monkeypatch.setattr(sh, "PAIRED", paired)
    rng, groups, words = np.random.default_rng(paired), [], []
    for group, size in enumerate([1, 2, 3, 1, 40, 2, 7, 31, 32, 33]):
        centres = rng.integers(0, 2**63, (3, 3)).astype(np.uint64)
        groups += [(group // 2, group % 2, 0)] * size
        words += [centres[k % 3] ^ np.uint64(1 << int(rng.integers(60))) for k in range(size)]
    groups, words = np.array(groups, np.int32), np.array(words)
    names = [tuple(g) for g in groups.tolist()]

    def components_of(pairs):
        of = list(range(len(words)))
        for i, j in pairs:
            low, high = sorted((of[i], of[j]))
            of = [low if x == high else x for x in of]
        return of

    near = [
        (i, j) for j in range(len(words)) for i in range(j)
        if names[i] == names[j] and int(np.bitwise_count(words[i] ^ words[j]).sum()) <= sh.STAGE_RADIUS
    ]
    found = [tuple(p) for p in sh.near_pairs(groups, words).tolist()]
    assert set(found) <= set(near) and components_of(found) == components_of(near)


def test_different_sets_of_one_fingerprint_meet(documents, monkeypatch):
    """Two sets whose fingerprints are equal and whose keys differ are still compared."""
    rng = np.random.default_rng(4)
    words = [f"w{rng.integers(5000)}" for _ in range(600)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"]))]
    monkeypatch.setattr(sh, "votes", lambda grams: np.full(sh.VOTED_BITS, len(grams), np.int64))
    monkeypatch.setattr(sh, "stage_keys", lambda margins, signs: np.repeat(margins[:, :1].astype(np.int32), 2, axis=1))
    assert [r.doc_id for r in sh.kept_documents(documents(rows)).collect()] == [1]


def test_texts_without_id_link_others(documents, monkeypatch):
    """Two texts six bits apart are joined by one between them that has no id."""
    prints = {"left": 0, "between": 0b111, "right": 0b111111}
    rows = [(7, "left"), (None, "between"), (9, "right")]
    monkeypatch.setattr(sh, "fingerprints", lambda docs, shingle: docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"),
        F.coalesce(*[F.when(F.col("text") == k, F.lit(v)) for k, v in prints.items()]).cast("long").alias("fp"),
    ))
    assert {r.doc_id: r.component_id for r in sh.near_dedup(documents(rows)).collect()} == {7: 7, None: 7, 9: 7}


def test_rows_of_a_hot_key_are_dealt_over_tasks(spark):
    from concordis.llm.common import joined_by_hot_key

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for key, value in zip(before, ("64", "false", "-1")):
            spark.conf.set(key, value)
        rows = spark.range(20000).select(F.when(F.col("id") < 10000, 0).otherwise(F.col("id")).alias("key"), "id")
        values = rows.groupBy("key").agg(F.max("id").alias("most"))
        found = joined_by_hot_key(rows, values, "key", F.xxhash64("id")).withColumn("task", F.spark_partition_id())
        tasks = found.groupBy("task").count().collect()
        assert len(tasks) == 64 and max(r["count"] for r in tasks) < 2 * 20000 / 64
        assert found.columns == ["key", "id", "most", "task"] and found.count() == 20000
        assert found.where("most <> if(key = 0, 9999, id)").count() == 0
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
