import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from concordis.llm import sharding


@settings(max_examples=40, deadline=None)
@given(count=st.integers(1, 5000), seed=st.integers(0, 2**31))
def test_permutation_and_inverse(count, seed):
    numbers = np.arange(count)
    places = sharding.permuted(numbers, count, seed)
    assert sorted(places.tolist()) == numbers.tolist()
    assert (sharding.permuted(places, count, seed, inverse=True) == numbers).all()


def test_permutation_scatters():
    places = sharding.permuted(np.arange(100_000), 100_000)
    assert abs(np.corrcoef(np.arange(100_000), places)[0, 1]) < 0.02
    assert np.diff(places).tolist().count(1) < 20


@pytest.mark.parametrize("count", [0, 1, 7, 300])
def test_shards(documents, count):
    rows = [(i * 3, None if i % 5 == 0 else f"té {i}") for i in range(count)]
    found = sharding.shard(documents(rows)).collect()
    assert len(found) == count
    texts = {i: (t or "").encode() for i, t in rows}
    order = {i: n for n, i in enumerate(sorted(texts))}
    slots = {}
    for r in found:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "rows", None)
        slots.setdefault(r.shard, []).append(r.slot)
        # Shard and slot follow from the row number alone.
        p = int(sharding.permuted(np.array([order[r.doc_id]]), count)[0])
        assert (r.shard, r.slot) == (p % 8, p // 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(documents, odd_texts):
    found = sharding.shard(documents(odd_texts)).collect()
    assert len(found) == len(odd_texts)
    assert len({(r.shard, r.slot) for r in found}) == len(odd_texts)
