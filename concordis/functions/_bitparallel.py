"""Unit-cost edit distance and edit scripts for one pair of token sequences.

Task-side helper behind the Arrow functions in ``edits.py``.  It is the published
bit-parallel recurrence (Myers 1999, Hyyro 2003) on Python integers, run over a
diagonal band that grows until it provably holds every optimal path.  Columns are
swept in chunks; inside one chunk the band is a fixed window of rows, so each step
costs a few machine operations per 30 rows.

The edit script uses one fixed priority when several optimal paths exist, walking
back from the end: diagonal first, then a deletion, then an insertion.  Pairs whose token
counts tell or nearly tell their distance are solved by ``_guided.py``, with the same script.
"""

from __future__ import annotations

import numpy as np

from concordis.functions._guided import shared_tail, straight, straight_codes, walk

# Upper bound on the bytes of bit vectors held while one chunk is walked back.
_CHUNK_BYTES = 32 << 20
_MIN_CHUNK = 256
_MIN_BAND = 48


def _sweep(masks, columns, rows, vp, vn, keep):
    """Advance one chunk of columns; return final deltas and, if kept, each column's bits."""
    full = (1 << rows) - 1
    kept_diag, kept_vp = [], []
    lookup = masks.get
    for token in columns:
        match = lookup(token, 0) | vn
        diag = ((((match & vp) + vp) ^ vp) | match) & full
        horizontal = ((vn | (full ^ (diag | vp))) << 1) | 1
        vp = (((vp & diag) << 1) | (full ^ (diag | horizontal))) & full
        vn = horizontal & diag
        if keep:
            kept_diag.append(diag)
            kept_vp.append(vp)
    return vp, vn, kept_diag, kept_vp


def _windows(n, m, band):
    """Chunks as (first column, last column, first row, last row), rows half open."""
    step = max(_MIN_CHUNK, min(band, (_CHUNK_BYTES * 4) // (2 * band + _MIN_CHUNK)))
    for start in range(0, m, step):
        stop = min(m, start + step)
        yield start, stop, max(0, start - band), min(n, stop + band)


def _numbered(a, b):
    """Both token sequences as integer arrays; equal tokens have equal numbers."""
    if isinstance(a, str):
        codes = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype="<u4") for x in (a, b))
        return tuple(codes)
    numbers: dict = {}
    return tuple(np.fromiter((numbers.setdefault(t, len(numbers)) for t in x), dtype=np.int64, count=len(x)) for x in (a, b))


def _window_masks(rows, columns):
    """For each symbol of the columns that occurs in the window of rows: its rows as bits."""
    order = np.argsort(rows, kind="stable")
    symbols, starts = np.unique(rows[order], return_index=True)
    ends = np.append(starts[1:], len(rows))
    wanted = set(columns.tolist())
    bits = np.zeros(len(rows), dtype=np.uint8)
    masks = {}
    for symbol, start, end in zip(symbols.tolist(), starts.tolist(), ends.tolist()):
        if symbol not in wanted:
            continue
        places = order[start:end]
        if end - start <= 4:
            masks[symbol] = sum(1 << p for p in places.tolist())
        else:
            bits[places] = 1
            masks[symbol] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            bits[places] = 0
    return masks


def _banded(a, b, band, trace):
    """Banded sweep over number arrays: (cost inside the band, saved state at each chunk start).

    Masks are built for each chunk's window of rows alone and dropped after it.  With ``trace``
    each state also holds its columns' bits, as far as all of them fit the byte bound;
    otherwise they are swept again on the way back.
    """
    n, m = len(a), len(b)
    trace = trace and m * (2 * min(n, 2 * band + _MIN_CHUNK) // 8 + 64) <= _CHUNK_BYTES
    states = []
    vp = vn = 0
    top_row, bottom_row, top_cost = 0, 0, 0
    for start, stop, low, high in _windows(n, m, band):
        skipped = low - top_row
        if skipped:
            head = (1 << skipped) - 1
            top_cost += (vp & head).bit_count() - (vn & head).bit_count()
            vp >>= skipped
            vn >>= skipped
        if high > bottom_row:
            vp |= ((1 << (high - bottom_row)) - 1) << (bottom_row - low)
        top_row, bottom_row = low, high
        before = (vp, vn)
        columns = b[start:stop]
        vp, vn, diags, vps = _sweep(_window_masks(a[low:high], columns), columns.tolist(), high - low, vp, vn, trace)
        states.append((start, stop, low, high, *before, diags, vps))
        top_cost += stop - start
    return top_cost + vp.bit_count() - vn.bit_count(), states


def _least_edits(a, b) -> int:
    """A lower bound of the distance: tokens one side has more of than the other."""
    # Stray characters of either side can have wide codes, so they are counted by rank.
    symbols, ranks = np.unique(np.concatenate((a, b)), return_inverse=True)
    more = np.bincount(ranks[: len(a)], minlength=len(symbols)) - np.bincount(ranks[len(a) :], minlength=len(symbols))
    return int(max(more[more > 0].sum(), -more[more < 0].sum()))


def _solve(a, b, trace=False):
    """Exact distance plus the chunk states of a band that holds all optimal paths.

    A path of cost c that strays k off the main diagonal, with s the difference of the
    lengths, has at least 2k - s insertions and deletions, so k is at most (c + s) / 2.
    """
    n, m = len(a), len(b)
    shift = abs(n - m)
    least = _least_edits(a, b)
    band = max(_MIN_BAND, (least + least // 2 + shift) // 2 + 16)
    while True:
        cost, states = _banded(a, b, band, trace)
        if cost + shift <= 2 * band or band >= max(n, m):
            return cost, states
        band *= 2


def guided_script(a, b):
    """The script of ``edit_script`` where token counts tell or nearly tell the distance, else None."""
    if a == b:
        return []
    tail = shared_tail(a, b, len(a), len(b))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return [(k, False, None) for k in range(len(a))] + [(0, True, token) for token in b]
    plain = straight(a, b)
    if plain is not None:
        return plain
    walked = walk(a, b)
    return None if walked is None else walked[::-1]


def plain_script(a: str, b: str):
    """The script of two different texts as the arrays of ``straight_codes`` where their symbols alone tell it, else None."""
    tail = shared_tail(a, b, len(a), len(b))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    return straight_codes(a, b) if a and b else None


def swept_distance(a, b) -> int:
    tail = shared_tail(a, b, len(a), len(b))
    return _solve(*_numbered(a[: len(a) - tail], b[: len(b) - tail]))[0]


def edit_distance(a, b) -> int:
    script = guided_script(a, b)
    return swept_distance(a, b) if script is None else len(script)


def edit_script(a, b):
    """Edits turning ``a`` into ``b``, left to right, as (slot, inserted, token).

    ``slot`` counts the tokens of ``a`` consumed before the edit.  ``inserted`` is
    true for a token of ``b`` with no partner; otherwise the edit replaces
    ``a[slot]`` by ``token``, or drops it when ``token`` is None.
    """
    guided = guided_script(a, b)
    if guided is not None:
        return guided
    tail = shared_tail(a, b, len(a), len(b))
    i, j = len(a) - tail, len(b) - tail
    edits = []
    rows, columns = _numbered(a[:i], b[:j])
    _, states = _solve(rows, columns, trace=True)
    while states and i and j:
        start, stop, low, high, vp, vn, diags, vps = states.pop()
        if not diags:
            part = columns[start:stop]
            _, _, diags, vps = _sweep(_window_masks(rows[low:high], part), part.tolist(), high - low, vp, vn, True)
        while i and j > start:
            if a[i - 1] == b[j - 1]:
                i -= 1
                j -= 1
                continue
            row = i - 1 - low
            column = j - 1 - start
            if not (diags[column] >> row) & 1:
                i -= 1
                j -= 1
                edits.append((i, False, b[j]))
            elif (vps[column] >> row) & 1:
                i -= 1
                edits.append((i, False, None))
            else:
                j -= 1
                edits.append((i, True, b[j]))
    while i:
        i -= 1
        edits.append((i, False, None))
    while j:
        j -= 1
        edits.append((0, True, b[j]))
    edits.reverse()
    return edits
