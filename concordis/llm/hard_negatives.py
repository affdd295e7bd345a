"""Hard-negative mining with exact scores from Kronecker-packed products.

A row's components become integers floor(256 * x).  All components are biased to be non-negative,
and the same component of several candidates is put into separated fields of one wide
integer, each field wide enough for a whole biased score.  One multiplication by an anchor's biased
component then serves all candidates of a word, the products are added up over the components, and
the fields are unpacked and freed of the bias: every score is exact.

Words of 53 bits are multiplied as whole numbers in doubles (a sum never passes 2^53, so nothing is
rounded).  Where the values are too large for one field of 53 bits, the words are
Python integers with as many fields as there are candidates.

Anchors are compared with all rows in blocks.  They are dealt into slices that a task holds while
candidates stream past; candidates are dealt into slices too, as many as the square root of their
number asks for, and each pair of slices is a cell.  Cells first give each anchor's best positives, which are
merged; a second pass gives the best negatives in each positive's window.  Only those few rows per
anchor and cell leave a cell.

Cases: rows with a null id, label or vector, or with a null or non-finite component (before or after
scaling), take no part; a shorter vector counts as padded with zeros; repeated rows are rows of their own,
but an anchor's own id is neither its positive nor its negative, and of rows that share an anchor's id the
least by label and components is the anchor; a score beyond 2^63-2 on either side is held at that bound; an anchor
without positives, or a positive without negatives, gives no row; an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordis.llm.common import saved, table

#: Rows whose id this divides are the anchors.
EVERY = 50
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Negatives score from 50 to 95 hundredths of the positive's score.
WINDOW = (50, 95)
#: Anchors that a task holds, candidates that are packed at a time, and anchors compared with those at a time.
HELD, PACKED, TILE = 16_384, 1_024, 512
WORD_BITS = 53
HIGHEST = 2**63 - 2
NONE = -HIGHEST - 1
MOST_TASKS = 20_000
FOUND = "vec_id long, other_id long, positive_no int, positive_id long, positive_score long, score long"


def usable(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows that take part, each with a place of its own."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    return (
        rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
        .where(finite)
        .select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding",
            F.monotonically_increasing_id().alias("place"),
        )
    )


def matrix(vectors: pa.Array, scale: int) -> np.ndarray:
    """Whole components in doubles, short rows padded with zeros."""
    lengths = np.asarray(pa.compute.list_value_length(vectors), dtype=np.int64)
    flat = np.floor(np.asarray(vectors.flatten(), dtype=np.float64) * scale)
    out = np.zeros((len(lengths), max(1, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def widened(rows: np.ndarray, columns: int) -> np.ndarray:
    return rows if rows.shape[1] == columns else np.pad(rows, ((0, 0), (0, columns - rows.shape[1])))


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all anchors with all candidates, through packed words; exact, as int64."""
    columns = max(anchors.shape[1], candidates.shape[1])
    anchors, candidates = widened(anchors, columns), widened(candidates, columns)
    least_a, least_c = int(anchors.min()), int(candidates.min())
    bits = (columns * (int(anchors.max()) - least_a) * (int(candidates.max()) - least_c)).bit_length() or 1
    fields = WORD_BITS // bits
    most_a, most_c = int(np.abs(anchors).max()), int(np.abs(candidates).max())
    if not fields or columns * most_a * most_c >= 2**61 or columns * max(most_a, most_c) >= 2**52:
        return _wide_scores(anchors, candidates, least_a, least_c, bits)
    own, theirs = anchors - least_a, candidates - least_c
    words = -(-len(theirs) // fields)
    padded = np.zeros((words * fields, columns))
    padded[: len(theirs)] = theirs
    packed = np.ldexp(padded.reshape(fields, words, columns), (bits * np.arange(fields))[:, None, None]).sum(axis=0)
    product = (own @ packed.T).astype(np.int64)
    parts = [(product >> (bits * f)) & ((1 << bits) - 1) for f in range(fields)]
    biased = np.concatenate(parts, axis=1)[:, : len(theirs)]
    sums_a, sums_c = own.sum(axis=1).astype(np.int64), theirs.sum(axis=1).astype(np.int64)
    return biased + (least_c * sums_a)[:, None] + (least_a * sums_c)[None, :] + columns * least_a * least_c


def _wide_scores(anchors: np.ndarray, candidates: np.ndarray, least_a: int, least_c: int, bits: int) -> np.ndarray:
    """The same through Python integers of any width: one field for each candidate."""
    width, columns = -(-bits // 8), anchors.shape[1]
    theirs = [[int(v) - least_c for v in row] for row in candidates]
    packed = [
        int.from_bytes(b"".join(row[j].to_bytes(width, "little") for row in theirs), "little") for j in range(columns)
    ]
    sums_c = [sum(row) for row in theirs]
    out = np.empty((len(anchors), len(candidates)), dtype=np.int64)
    for i, row in enumerate(anchors):
        own = [int(v) - least_a for v in row]
        product = sum(a * word for a, word in zip(own, packed)).to_bytes(width * len(theirs), "little")
        shift = least_c * sum(own) + columns * least_a * least_c
        for k, total in enumerate(sums_c):
            exact = int.from_bytes(product[k * width : (k + 1) * width], "little") + shift + least_a * total
            out[i, k] = max(-HIGHEST, min(HIGHEST, exact))
    return out


def best(found: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` highest of each row; ``ids`` ascend, so the first of equals is the least id.  ``found`` is spent."""
    rows = np.arange(len(found))
    tops, names = np.full((len(found), count), NONE), np.zeros((len(found), count), dtype=np.int64)
    for k in range(min(count, found.shape[1])):
        at = found.argmax(axis=1)
        tops[:, k], names[:, k] = found[rows, at], ids[at]
        found[rows, at] = NONE
    return tops, names


def merged(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The best of two lists per row, as long as each of them."""
    tops, names = (np.concatenate(pair, axis=-1) for pair in zip(one, other))
    order = np.lexsort((names, -tops), axis=-1)[..., : one[0].shape[-1]]
    return np.take_along_axis(tops, order, -1), np.take_along_axis(names, order, -1)


class _Cell:
    """The anchors of one cell and the best that passed them so far."""

    def __init__(self, anchors: pa.Table, scale: int, window: tuple[int, int] | None, count: int):
        self.vectors = matrix(anchors["embedding"].combine_chunks(), scale)
        self.ids, self.labels = (np.asarray(anchors[c].combine_chunks()) for c in ("vec_id", "label"))
        self.window, self.count = window, count
        self.lists = anchors["positives"].to_pylist() if window else None
        width = max(len(p) for p in self.lists) if window else 1
        if window:
            # Whole bounds for 100 * score, from Python integers; an absent positive's window is empty.
            least, most = window
            bounds = [[(-(-least * p["score"] // 100), most * p["score"] // 100) for p in ps] + [(1, 0)] * (width - len(ps)) for ps in self.lists]
            self.bounds = np.array(bounds, dtype=np.int64)
        self.tops = np.full((len(self.ids), width, count), NONE)
        self.names = np.zeros((len(self.ids), width, count), dtype=np.int64)

    def pass_by(self, candidates: pa.Table, scale: int) -> None:
        order = pa.compute.sort_indices(candidates["vec_id"])
        candidates = candidates.take(order)
        vectors = matrix(candidates["embedding"].combine_chunks(), scale)
        ids, labels = (np.asarray(candidates[c].combine_chunks()) for c in ("vec_id", "label"))
        for start in range(0, len(self.ids), TILE):
            tile = slice(start, start + TILE)
            found = scores(self.vectors[tile], vectors)
            same = self.labels[tile, None] == labels[None, :]
            for k in range(self.tops.shape[1]):
                if self.window:
                    low, high = self.bounds[tile, k, 0, None], self.bounds[tile, k, 1, None]
                    fits = ~same & (found >= low) & (found <= high)
                else:
                    fits = same
                fits &= self.ids[tile, None] != ids[None, :]
                new = best(np.where(fits, found, NONE), ids, self.count)
                self.tops[tile, k], self.names[tile, k] = merged((self.tops[tile, k], self.names[tile, k]), new)

    def rows(self) -> pa.RecordBatch:
        at, k, j = np.nonzero(self.tops != NONE)
        positives = [self.lists[a][b] for a, b in zip(at.tolist(), k.tolist())] if self.window else [None] * len(at)
        columns = {
            "vec_id": self.ids[at], "other_id": self.names[at, k, j], "positive_no": k.astype(np.int32),
            "positive_id": pa.array([p and p["other_id"] for p in positives], pa.int64()),
            "positive_score": pa.array([p and p["score"] for p in positives], pa.int64()),
            "score": self.tops[at, k, j],
        }
        return pa.RecordBatch.from_pydict(columns)


def cells(batches: Iterator[pa.RecordBatch], scale: int, window: tuple[int, int] | None, count: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of cell, anchors first; candidates pass the anchors that are held."""
    at, waiting, cell = None, [], None
    for batch in batches:
        for start in range(0, batch.num_rows, PACKED):
            part = pa.Table.from_batches([batch.slice(start, PACKED)])
            keys = np.asarray(part["cell"].combine_chunks()) * 2 + np.asarray(part["kind"].combine_chunks())
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for first, last in zip(cuts, cuts[1:]):
                rows, number, kind = part.slice(first, last - first), int(keys[first]) // 2, int(keys[first]) % 2
                if number != at:
                    if cell:
                        yield cell.rows()
                    at, waiting, cell = number, [], None
                if not kind:
                    waiting.append(rows)
                elif waiting or cell:
                    if waiting:
                        cell, waiting = _Cell(pa.concat_tables(waiting), scale, window, count), []
                    cell.pass_by(rows, scale)
    if cell:
        yield cell.rows()


def _passed(anchors: DataFrame, rows: DataFrame, slices: tuple[int, int], scale: int, window: tuple[int, int] | None, count: int) -> DataFrame:
    """What the cells find, each anchor's best ``count`` rows for each positive."""
    a_slices, c_slices = slices
    own = F.pmod(F.xxhash64("vec_id"), F.lit(a_slices)) * c_slices
    sent = anchors.select(
        F.lit(0).alias("kind"), F.explode(F.sequence(own, own + (c_slices - 1))).alias("cell"),
        "vec_id", "label", "embedding", "positives",
    )
    first = F.pmod(F.xxhash64("place"), F.lit(c_slices))
    last = F.lit(a_slices - 1) * c_slices + first
    streamed = rows.select(
        F.lit(1).alias("kind"), F.explode(F.sequence(first, last, F.lit(c_slices).cast("long"))).alias("cell"),
        "vec_id", "label", "embedding", F.lit(None).cast(anchors.schema["positives"].dataType).alias("positives"),
    )
    dealt = sent.unionByName(streamed).repartition(min(a_slices * c_slices, MOST_TASKS), "cell")
    found = dealt.sortWithinPartitions("cell", "kind").mapInArrow(lambda batches: cells(batches, scale, window, count), FOUND)
    order = Window.partitionBy("vec_id", "positive_no").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(
    rows: DataFrame, every: int = EVERY, scale: int = SCALE, positives: int = POSITIVES,
    negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, held: int = HELD, c_slices: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``rows`` as (vec_id, label, embedding)."""
    rows = saved(usable(rows, scale), "vectors")
    anchors = (
        rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row"))
        .select("vec_id", "row.label", "row.embedding")
    )
    everything, own = rows.count(), anchors.count()
    slices = (max(1, ceil(own / held)), c_slices or max(1, isqrt(everything) // 8))
    nothing = F.array().cast("array<struct<other_id:bigint,score:bigint>>")
    first = _passed(anchors.withColumn("positives", nothing), rows, slices, scale, None, positives)
    lists = first.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("rank", "other_id", "score"))).alias("ranked"))
    told = saved(
        anchors.join(lists, "vec_id").select(
            "vec_id", "label", "embedding",
            F.transform("ranked", lambda p: F.struct(p["other_id"].alias("other_id"), p["score"].alias("score"))).alias("positives"),
        ),
        "positives",
    )
    second = _passed(told, rows, slices, scale, window, negatives)
    return second.select(
        F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", changed))


OP13_SQL = """
WITH usable AS (
    SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS parts
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_dot_product(a.parts, b.parts) AS BIGINT) AS score
    FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
