"""Edit scripts found by a depth-first walk from the texts' ends, for pairs whose token counts nearly tell their distance.

Task-side helper in front of the band sweep of ``_bitparallel.py``.  What is left of two texts needs at least as
many edits as one side has more tokens than the other; an edit changes that bound in constant time and a run of equal
tokens not at all.  The walk passes equal tokens, then tries a substitution, a deletion and an insertion, as the sweep's
way back does, and turns round where the bound exceeds what may still be spent.  Its first whole path within the least
sufficient budget is therefore the very script of the sweep.  Steps follow the edits, not the tokens.  A pair that needs
more than its share of steps is given up here and swept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np

_FREE_STEPS = 64
#: Tokens of a diagonal that are compared at once.
_WINDOW = 256


def _surplus(a, b) -> dict:
    """Of each token how many more ``a`` has than ``b``."""
    if isinstance(a, str):
        left, right = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in (a, b))
        size = 1 + int(max(left.max(initial=0), right.max(initial=0)))
        if size <= 1 << 16:
            more = np.bincount(left, minlength=size) - np.bincount(right, minlength=size)
            places = np.flatnonzero(more)
            return dict(zip(map(chr, places.tolist()), more[places].tolist()))
    surplus = Counter(a)
    surplus.subtract(Counter(b))
    return dict(surplus)


def shared_tail(a, b, i: int, j: int) -> int:
    """Number of equal tokens at the ends of ``a[:i]`` and ``b[:j]``; compares growing pieces, then halves the last one."""
    most = min(i, j)
    size, step = 0, 16
    while size < most:
        step = min(step, most - size)
        p, q = i - size, j - size
        if a[p - step : p] == b[q - step : q]:
            size += step
            step *= 2
            continue
        while step > 1:
            half = step >> 1
            p, q = i - size, j - size
            if a[p - half : p] == b[q - half : q]:
                size += half
                step -= half
            else:
                step = half
        return size
    return size


def _most_surplus(a, b) -> int:
    """The greater number of tokens that one side has more of."""
    if isinstance(a, np.ndarray):
        symbols, ranks = np.unique(np.concatenate((a, b)), return_inverse=True)
        more = np.bincount(ranks[: len(a)], minlength=len(symbols)) - np.bincount(ranks[len(a) :], minlength=len(symbols))
        return int(max(more[more > 0].sum(), -more[more < 0].sum()))
    surplus = _surplus(a, b)
    more = sum(v for v in surplus.values() if v > 0)
    return max(more, more - len(a) + len(b))


def straight_codes(a: str, b: str):
    """As ``straight`` for two texts, as arrays: slots, whether inserted, and code points, -1 for a token that is dropped."""
    left, right = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in (a, b))
    if len(left) == len(right):
        places = np.flatnonzero(left != right)
        if _most_surplus(left[places], right[places]) < len(places):
            return None
        return places, np.zeros(len(places), bool), right[places].astype(np.int64)
    short, long = sorted((left, right), key=len)
    present = np.zeros(1 + int(max(short.max(initial=0), long.max(initial=0))), bool)
    present[short] = True
    shared = present[long]
    if np.count_nonzero(shared) != len(short) or not np.array_equal(long[shared], short):
        return None
    places = np.flatnonzero(~shared)
    if long is left:
        return places, np.zeros(len(places), bool), np.full(len(places), -1, np.int64)
    return places - np.arange(len(places)), np.ones(len(places), bool), right[places].astype(np.int64)


def straight(a, b):
    """Edits left to right as (slot, inserted, token) where no other script has as few, else None.

    Either tokens are replaced in place and the token counts show that fewer edits cannot do, or one side has
    just some tokens more that the other holds nowhere.  The sweep's way back takes the same ones: it tries
    the diagonal first, and a cheaper rest would make the whole cheaper.
    """
    if isinstance(a, str):
        found = straight_codes(a, b)
        if found is None:
            return None
        return [(slot, inserted, None if code < 0 else chr(code)) for slot, inserted, code in zip(*(column.tolist() for column in found))]
    if len(a) == len(b):
        places = [k for k, (x, y) in enumerate(zip(a, b)) if x != y]
        if _most_surplus([a[k] for k in places], [b[k] for k in places]) < len(places):
            return None
        return [(k, False, b[k]) for k in places]
    short, long = sorted((a, b), key=len)
    known = set(short)
    places = [k for k, token in enumerate(long) if token not in known]
    if len(long) - len(places) != len(short) or [token for token in long if token in known] != list(short):
        return None
    if len(a) > len(b):
        return [(k, False, None) for k in places]
    return [(k - n, True, b[k]) for n, k in enumerate(places)]


class _Diagonals:
    """Where two texts differ along the diagonals that a walk is on, a window of each at a time."""

    def __init__(self, a: str, b: str):
        self.a, self.b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in (a, b))
        self.windows: dict = {}

    def tail(self, i: int, j: int) -> int:
        """As ``shared_tail``."""
        low, high, places = self.windows.get(i - j, (i, i, ()))
        top = i
        if not low < i <= high:
            low = i
        else:
            at = bisect_left(places, i - low)
            if at:
                return i - low - places[at - 1] - 1
            top = low
        end, size = max(i - j, 0), _WINDOW
        while top > end:
            low = max(end, top - size)
            places = np.flatnonzero(self.a[low:top] != self.b[low - i + j : top - i + j]).tolist()
            self.windows[i - j] = low, top, places
            if places:
                return i - low - places[-1] - 1
            top = low
            size *= 4
        return i - end


def walk(a, b):
    """Edits from the end as (slot, inserted, token), or None where some three steps for each edit of the bound do not suffice."""
    surplus = _surplus(a, b)
    get = surplus.get
    more = sum(v for v in surplus.values() if v > 0)
    less = more - len(a) + len(b)
    budget = max(more, less)
    steps = _FREE_STEPS + 3 * budget
    dead: dict = {}
    diagonals = _Diagonals(a, b) if isinstance(a, str) and len(a) > _WINDOW else None
    tail_of = diagonals.tail if diagonals else lambda i, j: shared_tail(a, b, i, j)
    while True:
        i, j, left = len(a), len(b), budget
        path: list = []
        choice = -1
        while True:
            if choice < 0:
                steps -= 1
                if steps < 0:
                    return None
                if i and j and a[i - 1] == b[j - 1]:
                    tail = tail_of(i, j)
                    i -= tail
                    j -= tail
                if not i or not j:
                    if i + j <= left:
                        edits = []
                        for at, other, kind, _, _ in path:
                            edits.append((at, True, b[other - 1]) if kind == 2 else (at - 1, False, None if kind else b[other - 1]))
                        edits.extend((k, False, None) for k in range(i - 1, -1, -1))
                        edits.extend((0, True, b[k]) for k in range(j - 1, -1, -1))
                        return edits
                    choice = 3
                else:
                    choice = 3 if dead.get((i, j), -1) >= left else 0
            if not choice and diagonals and i - j in diagonals.windows:
                # Substitutions follow each other along a window whose differing places are known.
                shift = i - j
                low, high, places = diagonals.windows[shift]
                at = bisect_left(places, i - 1 - low) if low < i <= high else len(places)
                while 0 < at < len(places):
                    x, y = a[i - 1], b[j - 1]
                    had, lacked = get(x, 0), get(y, 0)
                    after = more - (had > 0) + (lacked >= 0)
                    under = less + (had <= 0) - (lacked < 0)
                    if after >= left or under >= left:
                        break
                    path.append((i, j, 0, more, less))
                    surplus[x] = had - 1
                    surplus[y] = lacked + 1
                    more, less = after, under
                    left -= 1
                    steps -= 1
                    at -= 1
                    i = low + places[at] + 1
                    j = i - shift
                    if dead and dead.get((i, j), -1) >= left:
                        choice = 3
                        break
            if choice < 3:
                kept = more, less
                if choice < 2:
                    token = a[i - 1]
                    had = get(token, 0)
                    surplus[token] = had - 1
                    if had > 0:
                        more -= 1
                    else:
                        less += 1
                if choice != 1:
                    token = b[j - 1]
                    had = get(token, 0)
                    surplus[token] = had + 1
                    if had < 0:
                        less -= 1
                    else:
                        more += 1
                path.append((i, j, choice, *kept))
                if more < left and less < left:
                    if choice < 2:
                        i -= 1
                    if choice != 1:
                        j -= 1
                    left -= 1
                    choice = -1
                    continue
                spent = 0
            else:
                if dead.get((i, j), -1) < left:
                    dead[i, j] = left
                spent = 1
            # One edit back, then the next kind of edit at that place.
            if not path:
                break
            i, j, choice, more, less = path.pop()
            left += spent
            if choice < 2:
                surplus[a[i - 1]] += 1
            if choice != 1:
                surplus[b[j - 1]] -= 1
            choice += 1
        budget += 1
