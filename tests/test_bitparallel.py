import random

import pytest

from concordis.functions import _bitparallel as bp
from tests.plain_dp import plain_script


@pytest.mark.parametrize("alphabet,longest,rounds", [("ab", 12, 4000), ("abcd", 30, 1500), ("abcdefgh ", 90, 300)])
def test_matches_full_table(alphabet, longest, rounds):
    rng = random.Random(7)
    for _ in range(rounds):
        a = [rng.choice(alphabet) for _ in range(rng.randrange(longest))]
        b = [rng.choice(alphabet) for _ in range(rng.randrange(longest))]
        cost, script = plain_script(a, b)
        assert bp.edit_distance(a, b) == cost
        assert bp.edit_script(a, b) == script


@pytest.mark.parametrize("band,chunk", [(1, 1), (2, 3), (5, 4), (8, 16)])
def test_narrow_bands_and_chunks(monkeypatch, band, chunk):
    monkeypatch.setattr(bp, "_MIN_BAND", band)
    monkeypatch.setattr(bp, "_MIN_CHUNK", chunk)
    monkeypatch.setattr(bp, "_CHUNK_BYTES", 64)
    rng = random.Random(11)
    for _ in range(600):
        a = [rng.choice("abc") for _ in range(rng.randrange(60))]
        b = list(a)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(b) + 1)
            roll = rng.random()
            if roll < 0.4:
                b.insert(at, rng.choice("abc"))
            elif b and roll < 0.7:
                del b[min(at, len(b) - 1)]
            elif b:
                b[min(at, len(b) - 1)] = rng.choice("abc")
        cost, script = plain_script(a, b)
        assert bp.edit_distance(a, b) == cost
        assert bp.edit_script(a, b) == script
