import random
import time

import pyarrow as pa
import pytest

from concordis.functions import _bitparallel as bp
from concordis.functions import edits
from concordis.functions._guided import shared_tail, straight, walk
from tests.plain_dp import plain_script


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij "])
def test_a_walk_that_ends_finds_the_script_of_the_full_table(alphabet):
    rng = random.Random(5)
    ended = 0
    for _ in range(400):
        a = [rng.choice(alphabet) for _ in range(rng.randrange(1, 50))]
        b = "".join(a).replace("a", rng.choice(("a", "", "xy", "z")))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            b = b[:at] + rng.choice(("", "b", "qq")) + b[at + rng.randrange(2):]
        for left, right in ((a, list(b)), ("".join(a), b)):
            found = walk(left, right)
            if found is not None:
                ended += 1
                assert found[::-1] == plain_script(left, right)[1]
            assert bp.edit_script(left, right) == plain_script(left, right)[1]
    assert ended > 400


def test_shared_tails():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rng.choice("aab") for _ in range(rng.randrange(90))) for _ in range(2))
        same = "".join(rng.choice("ab") for _ in range(rng.randrange(90)))
        a, b = a + same, b + same
        size = 0
        while size < min(len(a), len(b)) and a[-1 - size] == b[-1 - size]:
            size += 1
        assert shared_tail(a, b, len(a), len(b)) == size


def test_edits_of_a_long_misreading_cost_by_the_edit_not_by_the_symbol():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvw    ") for _ in range(300_000))
    started = time.process_time()
    assert len(bp.edit_script(text, text.replace("o", "0"))) == text.count("o")
    # The sweep of the whole band takes over ten times this.
    assert time.process_time() - started < 2


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij "])
def test_straight_scripts_are_those_of_the_full_table(alphabet):
    rng = random.Random(8)
    found = 0
    for n in range(600):
        a = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30)))
        b = a.replace("a", rng.choice(("b", "z", "", "ax", "xya", "\U0001f600")))
        if n % 3 == 0:
            b = "".join(rng.choice(alphabet) for _ in a)
        if n % 2:
            a, b = b, a
        for left, right in ((a, b), (list(a), list(b))):
            if left and right and (edits := straight(left, right)) is not None:
                found += 1
                assert edits == plain_script(left, right)[1]
    assert found > 300


def test_many_plain_edits_cost_next_to_nothing():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdef ") for _ in range(1_000_000))
    started = time.process_time()
    assert len(bp.edit_script(text, text.replace("a", "0").replace("b", "1"))) == text.count("a") + text.count("b")
    assert len(bp.edit_script(text, text.replace("a", "a01"))) == 2 * text.count("a")
    # The walk takes over five times this.
    assert time.process_time() - started < 0.8


def test_plain_scripts_are_kept_as_arrays():
    text = "the thin man é \U0001f600 on the moor " * 40
    for other in (text.replace("a", "@"), text.replace("\U0001f600", "☃"), text.replace("o", "o\U0001f601"), text.replace("h", "")):
        for left, right in ((text, other), (other, text)):
            slots, inserted, codes = bp.plain_script(left, right)
            script = [(s, i, None if c < 0 else chr(c)) for s, i, c in zip(slots.tolist(), inserted.tolist(), codes.tolist())]
            assert script == bp.edit_script(left, right) and len(script) > 30
            found = edits.edit_script.func(pa.array([left, None]), pa.array([right, right])).to_pylist()
            laned = zip(*edits._laned(left, right, script))
            assert found == [[dict(zip(("slot", "lane", "symbol", "centre_symbol"), entry)) for entry in laned], None]
    assert bp.plain_script("abc", "abc") is None and bp.plain_script("", "x") is None
