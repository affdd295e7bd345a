"""Exact weighted medoid of one unit's texts, solving only the pairs that can matter.

Task-side helper behind ``centre_of`` in ``edits.py``.  Every pair has a lower and an upper
bound of its distance; at first the symbols one side has more of, and the longer length.
The row whose lower bounds sum to the least is always worked on next, and each solved pair
narrows the others by the triangle inequality.  Once that row is wholly known, no other
can have a smaller sum, nor an equal one and an earlier place.
"""

from __future__ import annotations

import numpy as np


def numbered(texts) -> list[np.ndarray]:
    """Each text (a string or a list of tokens) as numbers from 0; equal tokens have equal numbers."""
    if all(isinstance(text, str) for text in texts):
        codes = [np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") for text in texts]
        joined = np.concatenate(codes)
        present = np.zeros(1 + int(joined.max(initial=0)), bool)
        present[joined] = True
        ranks = (np.cumsum(present) - 1)[joined]
        return np.split(ranks, np.cumsum([len(c) for c in codes])[:-1])
    known: dict = {}
    return [np.array([known.setdefault(token, len(known)) for token in text], np.int64) for text in texts]


def bounds(texts) -> tuple[np.ndarray, np.ndarray]:
    """For each pair a number of edits that is never too many and one that always suffices.

    The first counts the tokens one side has more of.  The second lays the texts upon each other, from
    their starts or from their ends, and replaces every token that differs.
    """
    rows = numbered(texts)
    size = 1 + max((int(row.max()) for row in rows if len(row)), default=0)
    bags = np.stack([np.bincount(row, minlength=size) for row in rows])
    low, high = (np.zeros((len(rows), len(rows)), np.int64) for _ in range(2))
    for i, one in enumerate(rows):
        more = bags - bags[i]
        low[i] = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
        for j in range(i):
            other = rows[j]
            both, rest = min(len(one), len(other)), abs(len(one) - len(other))
            differ = np.count_nonzero(one[:both] != other[:both])
            if rest and both:
                differ = min(differ, np.count_nonzero(one[-both:] != other[-both:]))
            high[i, j] = high[j, i] = rest + differ
    return low, high


def medoid(texts, copies, distance) -> tuple[int, int]:
    """Place of the text with the least summed distance, the earlier one on a tie, and the pairs solved.

    ``copies`` weigh the texts.
    """
    if len(texts) < 3:
        # The sums are one distance times the other's copies.
        return (1 if len(texts) == 2 and copies[1] > copies[0] else 0), 0
    weights = np.asarray(copies, np.int64)
    low, high = bounds(texts)
    solved = 0
    while True:
        i = int(np.argmin(low @ weights))
        gap = (high[i] - low[i]) * weights
        j = int(np.argmax(gap))
        if gap[j] == 0:
            return i, solved
        found = distance(texts[i], texts[j])
        solved += 1
        low[i, j] = low[j, i] = high[i, j] = high[j, i] = found
        for one, other in ((i, j), (j, i)):
            nearest = np.maximum(low[other] - found, found - high[other])
            low[one] = low[:, one] = np.maximum(low[one], nearest)
            high[one] = high[:, one] = np.minimum(high[one], high[other] + found)
