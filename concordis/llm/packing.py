"""Order-preserving packing of token streams into sequences by dynamic programming.

Documents are dealt by ranges of their id and read in order.  Each is tokenised, closed by one
end id and appended to a stream; the stream is handled in runs of about ``RUN_TOKENS`` that
end with a document, so a task holds one run and no more.

Cuts may fall after documents, after sentences, and, at a higher penalty, every ``window / FORCED_PARTS``
tokens inside a sentence longer than that.  A window costs its padding (none when its length is a power of
two, else up to ``window``) plus a penalty for truncating a document at its end.  With
``best[k]`` the least cost of packing the stream up to cut k,

    best[k] = penalty[k] + min over i, with 0 < p[k] - p[i] <= window, of best[i] + padding(p[k] - p[i])

Apart from powers of two the padding is window - p[k] + p[i], so the minimum is the front of a
monotone queue of best[i] + p[i] over a sliding range; the few cuts at a distance of a power of two
are tried on top.

Ids are those of the tokenizer file, its added tokens included; other text is cut at single spaces, where that vocabulary
always starts a new token, and each distinct part is tokenised once while a bounded cache lasts.

Cases: a null or empty text is the end id alone; repeated rows are packed each; a null id comes
first; a text of any length is cut as above; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordis.llm.common import table

WINDOW = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
RUN_TOKENS = 1 << 20
CACHE_ENTRIES = 300_000
SENTENCE_PENALTY = 24.0
FORCED_PENALTY = 96.0
#: Inside sentences a window may end at every such part of its length.
FORCED_PARTS = 32

#: White space around a single space, or doubled: cutting at that space could change tokens.
_UNSAFE = re.compile(r"\s \s|  | $")
#: How the vocabulary splits text before merging; equal to its published pattern, with possessive repeats.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class Encoder:
    """Token ids as little-endian 32-bit bytes."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("packing", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._after_space = _Parts(self._whole)
        #: Added tokens of the tokenizer file beside the ranks, longest first, which always stand alone.
        self._added: dict[str, bytes] = {}
        numbers = set(ranks.values())
        if vocabulary == VOCABULARY:
            with open(public_tokenizers.path(TOKENIZER)) as file:
                added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
            self._added = {t: array("I", [added[t]]).tobytes() for t in sorted(added, key=len, reverse=True)}
            numbers |= set(added.values())
        self._borders = re.compile("(" + "|".join(map(re.escape, self._added)) + ")") if self._added else None
        #: Ids after which a sentence can end.
        self.sentence_end = np.zeros(max(numbers) + 1, dtype=bool)
        for part, number in ranks.items():
            if part[-1:] in b".!?" or b"\n" in part:
                self.sentence_end[number] = True

    def _whole(self, text: str) -> bytes:
        return array("I", self._encoding.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if self._borders is None or not self._borders.search(text):
            return self._ordinary(text)
        return b"".join(self._added[part] if part in self._added else self._ordinary(part) for part in self._borders.split(text))

    def _ordinary(self, text: str) -> bytes:
        if not text or _UNSAFE.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        return self._whole(first) + b"".join(map(self._after_space.__getitem__, rest))


class _Parts(dict):
    """Ids of parts of text that follow a space, kept while there are few enough of them."""

    def __init__(self, encode):
        self._encode = encode

    def __missing__(self, part: str) -> bytes:
        ids = self._encode(" " + part)
        if len(self) < CACHE_ENTRIES and len(part) < 64:
            self[part] = ids
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and the penalty of ending there."""
    kinds = sentence_end[ids].astype(np.uint8)
    kinds[doc_ends - 1] = 2
    places = np.flatnonzero(kinds) + 1
    penalty = np.where(kinds[places - 1] == 2, 0.0, SENTENCE_PENALTY)
    starts = np.concatenate(([0], places[:-1]))
    step = max(1, window // FORCED_PARTS)
    long = np.flatnonzero(places - starts > step)
    if long.size:
        forced = np.concatenate([np.arange(starts[i] + step, places[i], step) for i in long])
        at = np.searchsorted(places, forced)
        places, penalty = np.insert(places, at, forced), np.insert(penalty, at, FORCED_PENALTY)
    return places, penalty


def choose_cuts(points: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Window ends of least total cost, in order; the stream starts at 0."""
    places = np.concatenate(([0], points))
    number = np.full(places[-1] + 1, -1, dtype=np.int64)
    number[places] = np.arange(len(places))
    tries: dict[int, list[int]] = {}
    size = 1
    while size < window:
        back = np.where(points >= size, number[np.maximum(points - size, 0)], -1)
        for k in np.flatnonzero(back >= 0).tolist():
            tries.setdefault(k + 1, []).append(int(back[k]))
        size *= 2
    at, costs = places.tolist(), [0.0, *penalty.tolist()]
    best, came = [0.0] * len(at), [0] * len(at)
    queue = deque([(0.0, 0)])  # (best[i] + p[i], i), smallest first
    for k in range(1, len(at)):
        place = at[k]
        while at[queue[0][1]] < place - window:
            queue.popleft()
        value, source = queue[0]
        value += window - place
        for i in tries.get(k, ()):
            if best[i] < value:
                value, source = best[i], i
        value += costs[k]
        best[k], came[k] = value, source
        key = value + place
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, k))
    ends, k = [], len(at) - 1
    while k:
        ends.append(at[k])
        k = came[k]
    return ends[::-1]


def pack_run(doc_ids, bodies: list[bytes], sentence_end: np.ndarray, window: int, first_sequence: int):
    """Piece rows of one run, as columns, and the number of sequences used."""
    lengths = np.array([len(b) // 4 for b in bodies], dtype=np.int64)
    ends = np.cumsum(lengths)
    ids = np.frombuffer(b"".join(bodies), dtype="<u4")
    cuts = np.array(choose_cuts(*cut_points(ids, ends, sentence_end, window), window), dtype=np.int64)
    starts = ends - lengths
    borders = np.union1d(ends, cuts)
    piece_start = np.concatenate(([0], borders[:-1]))
    doc = np.searchsorted(ends, piece_start, side="right")
    sequence = np.searchsorted(cuts, piece_start, side="right")
    window_start = np.concatenate(([0], cuts[:-1]))[sequence]
    crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(piece_start.tolist(), borders.tolist())]
    return [
        pa.array([doc_ids[d] for d in doc.tolist()], pa.int64()), pa.array(piece_start - starts[doc]), pa.array(borders - piece_start),
        pa.array(crcs, pa.int64()), pa.array(lengths[doc]), pa.array(sequence + first_sequence), pa.array(piece_start - window_start),
    ], len(cuts)


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    names = [field.split()[0] for field in PIECES.split(", ")]

    def run(batches):
        tool, closing = encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        # Sequences are numbered inside the task's range of documents.
        sequence = TaskContext.get().partitionId() << 36
        doc_ids, bodies, held = [], [], 0

        def flush():
            columns, used = pack_run(doc_ids, bodies, tool.sentence_end, window, sequence)
            return pa.RecordBatch.from_arrays(columns, names), used

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                doc_ids.append(doc_id)
                bodies.append(tool.encode(text.as_py() or "") + closing)
                held += len(bodies[-1]) // 4
                if held >= RUN_TOKENS:
                    rows, used = flush()
                    sequence += used
                    doc_ids, bodies, held = [], [], 0
                    yield rows
        if bodies:
            yield flush()[0]

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    return ordered.sortWithinPartitions("doc_id", "text").mapInArrow(run, PIECES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
