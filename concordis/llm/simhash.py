"""SimHash near-dedup with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits, each read as a word of the
binary Golay code (23, 12, 7).  A word's keys are the numbers of all code words within four
bits of it: the nearest one, and five more when the nearest is three bits away.  Two words that
differ in at most two bits always share a key (checked over the whole code in the tests).
Four differing bits spread over three segments leave two segments with at most two between
them, so the fingerprints share a pair of keys there.  Rows are joined on (segment pair, two
keys) and every candidate is verified on all 64 bits, so no link is lost and none is false.

Equal fingerprints are folded first.  Inside one key the fingerprints are compared in the
owner task, and only a spanning forest of the links leaves it, never all pairs.  A key with
more than ``BLOCK`` fingerprints is dealt into blocks whose pairs are separate groups.
Components come from the forest by alternating stars, each round stored in the shared folder.

The pipeline's stage (``kept_documents``) asks for another nearness: five words and a Jaccard similarity of
0.8.  There about every seventh bit differs, more than the nearest code word of a segment survives.  So the
fingerprint is wider and its segments are decoded by their margins: a bit counts as much as the shingles' votes
for it differ from a tie, since it is the close votes that an edit turns.  The ``LISTED`` code words nearest to each of two
segments give the ``PROBES`` nearest pairs of code words, and these are the keys, ``STAGE_PAIRS`` times.  Rows that share a
key are compared by ``STAGE_BITS`` bits inside it.  Their links make coarse components; inside those every
pair within the radius is verified by its whole shingle sets, unless other verified links connect it already.

Cases: a null text counts as empty; its fingerprint is zero and links like any other.
Repeated rows share a component.  A null id is no candidate for the smallest id, but its text links others.  An empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordis.llm.common import DOCUMENT_COLUMNS, joined_by_hot_key, saved, slices, table

SHINGLE = 4
DISTANCE = 4
SEED = 42
BLOCK = 4096
#: Bits of each segment, low bits first, and the segment pairs that make a key.
SEGMENTS = (23, 23, 18)
SEGMENT_PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY = 0b101011100011
#: The pipeline's stage: five words, a similarity of 0.8, and fingerprints wide enough to tell it.
STAGE_SHINGLE = 5
SIMILARITY = 0.8
STAGE_BITS = 192
#: At a similarity of 0.8 about 29 of 192 bits differ, 36 if the sets have four and five shingles, with a deviation of 5; of unrelated texts 96.
STAGE_RADIUS = 60
#: A pair of similarity 0.8 shares a key of one segment pair with probability 0.78, measured, and none of all with 0.22^8 = 0.000006.
STAGE_PAIRS, LISTED, PROBES = 8, 5, 16
#: Bits whose votes are counted: 16 segments of 23, in words of 64.
VOTED_BITS = 384
#: Up to this many rows of a key all pairs are compared at once, in larger keys row by row.
PAIRED = 32
SET_BLOCK, SET_BLOCKS = 64, 32
STAGE_WORDS = 300_000


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(shingle, len(words))
    hashes = np.array(
        [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist())],
        dtype="<u8",
    )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, a hash of the text and the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = np.array([simhash(t.as_py(), shingle) for t in texts], dtype=np.uint64)
        return pa.array(found.view(np.int64), pa.int64())

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), of("text").alias("fp")
    )


def _remainder(word: int) -> int:
    for at in range(22, 10, -1):
        if word >> at & 1:
            word ^= GOLAY << (at - 11)
    return word


def golay_errors() -> list[list[int]]:
    """For each of the 2048 remainders: what to add to a word to reach each of its key code words.

    Patterns of up to four bits are tried in order of weight; the nearest code word is the
    first, those four bits away follow.
    """
    units = [_remainder(1 << i) for i in range(23)]
    found: list[list[int]] = [[] for _ in range(2048)]
    level = {0: 0}
    found[0].append(0)
    for _ in range(4):
        level = {
            p | 1 << i: r ^ units[i] for p, r in level.items() for i in range(p.bit_length(), 23)
        }
        for pattern, remainder in level.items():
            found[remainder].append(pattern)
    return found


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Additions by remainder (2048 x 6, short lists filled with -1), and the remainder of each high part."""
    errors = golay_errors()
    additions = np.full((2048, max(map(len, errors))), -1, dtype=np.int64)
    for remainder, patterns in enumerate(errors):
        additions[remainder, : len(patterns)] = patterns
    high = np.array([_remainder(h << 11) for h in range(4096)], dtype=np.int64)
    return additions, high


def segment_keys(words: np.ndarray, tables) -> np.ndarray:
    """Code word numbers (their upper twelve bits) of 23-bit words, -1 where there are fewer."""
    additions, high = tables
    added = additions[high[words >> 11] ^ (words & 2047)]
    return np.where(added < 0, -1, (words[:, None] ^ added) >> 11)


def fuzzy_keys(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: for each segment pair every combination of the two segments' keys."""
    unsigned, parts, shift = fps.view(np.uint64), [], 0
    for bits in SEGMENTS:
        parts.append(segment_keys((unsigned >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64), tables))
        shift += bits
    rows, keys = [], []
    for number, (i, j) in enumerate(SEGMENT_PAIRS):
        both = (parts[i][:, :, None] >= 0) & (parts[j][:, None, :] >= 0)
        joined = (number << 24) + (parts[i][:, :, None] << 12) + parts[j][:, None, :]
        at = np.nonzero(both)
        rows.append(at[0])
        keys.append(joined[at])
    return np.concatenate(rows), np.concatenate(keys)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if (above == parent).all():
            return parent
        parent = above


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one group of different fingerprints."""
    parent, links = np.arange(len(fps)), []
    unsigned = fps.view(np.uint64)
    for i in range(len(fps) - 1):
        near = np.flatnonzero(np.bitwise_count(unsigned[i + 1 :] ^ unsigned[i]) <= distance) + i + 1
        if near.size:
            own = parent[i]
            for root in np.unique(parent[near]):
                if root != own:
                    j = int(near[np.flatnonzero(parent[near] == root)[0]])
                    links.append((int(fps[i]), int(fps[j])))
                    parent[parent == root] = own
    return links


def group_links(keys: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links within runs of equal keys; rows come sorted by key."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
    sizes = ends - starts
    pairs = starts[sizes == 2]
    near = pairs[np.bitwise_count((fps[pairs] ^ fps[pairs + 1]).view(np.uint64)) <= distance]
    links = list(zip(fps[near].tolist(), fps[near + 1].tolist()))
    for a, b in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
        links += forest(np.unique(fps[a:b]), distance)
    return links


def links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links between different fingerprints: a spanning forest of each key's links."""

    def key_rows(batches):
        tables = golay_tables()
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            rows, keys = fuzzy_keys(fps, tables)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fps[rows], pa.int64())], ["key", "fp"])

    keyed = prints.select("fp").mapInArrow(key_rows, "key long, fp long").repartition("key")
    # Keys with more fingerprints than one comparison should take are dealt into pairs of blocks.
    large = keyed.groupBy("key").count().where(F.col("count") > block)
    blocks = large.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    placed = keyed.join(blocks, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    plain = placed.where(F.col("blocks").isNull()).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    dealt = (
        placed.where(F.col("blocks").isNotNull())
        .select("key", own.alias("own"), other.alias("other"), "fp")
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
        .repartition("key", "i", "j")
    )

    def compare(batches):
        held_keys, held_fps = np.empty(0, np.int64), np.empty(0, np.int64)
        held_i, held_j = np.empty(0, np.int64), np.empty(0, np.int64)

        def emit(k, i, j, f):
            changed = np.flatnonzero((np.diff(k) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            groups = np.zeros(len(k), np.int64)
            groups[changed] = 1
            found = group_links(np.cumsum(groups), f, distance)
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64").drop_duplicates()

        for batch in batches:
            k, i, j, f = (batch[c].to_numpy(dtype=np.int64) for c in ("key", "i", "j", "fp"))
            held_keys, held_fps = np.concatenate((held_keys, k)), np.concatenate((held_fps, f))
            held_i, held_j = np.concatenate((held_i, i)), np.concatenate((held_j, j))
            if not len(held_keys):
                continue
            last = (held_keys == held_keys[-1]) & (held_i == held_i[-1]) & (held_j == held_j[-1])
            end = int(np.flatnonzero(~last)[-1]) + 1 if (~last).any() else 0
            if end:
                yield emit(held_keys[:end], held_i[:end], held_j[:end], held_fps[:end])
                held_keys, held_fps, held_i, held_j = held_keys[end:], held_fps[end:], held_i[end:], held_j[end:]
        if len(held_keys):
            yield emit(held_keys, held_i, held_j, held_fps)

    found = [
        part.sortWithinPartitions("key", "i", "j").mapInPandas(compare, "a long, b long") for part in (plain, dealt)
    ]
    return found[0].unionByName(found[1]).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) by alternating large and small stars over stored edges."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        side = both if large else both.where(F.col("b") < F.col("a"))
        least = side.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        moved = joined_by_hot_key(side, least, "a", F.xxhash64("b"))
        if large:
            moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            moved = moved.where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
            moved = moved.unionByName(least.select("a", F.col("low").alias("b")))
        return moved.where(F.col("a") != F.col("b")).distinct()

    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    current = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    state = mark(current)
    while state[0]:
        current = saved(star(star(current, True), False), "stars")
        state, before = mark(current), state
        if tuple(state) == tuple(before):
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))


def clusters(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, fp and component_id, the smallest id reachable over links."""
    # A number of each row, stored with it, deals the copies of one text over tasks.
    prints = saved(fingerprints(docs, shingle).withColumn("copy", F.xxhash64(F.monotonically_increasing_id())), "prints")
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    pairs = links(distinct, distance, block)
    # Nodes order like ids, those without one last, so the least node of a component has the smallest id reachable.
    node = F.struct(F.col("first_id").isNull().alias("unnamed"), F.coalesce("first_id", F.lit(0)).alias("id"), "fp")
    nodes = lambda side: distinct.select(F.col("fp").alias(side), node.alias(f"{side}_node"))
    edges = pairs.join(nodes("a"), "a").join(nodes("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    found = components(edges).select(F.col("node.fp").alias("fp"), F.when(~F.col("component.unnamed"), F.col("component.id")).alias("component_id"))
    labelled = distinct.join(found, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return joined_by_hot_key(prints, labelled, "fp", F.col("copy")).drop("copy")


def near_dedup(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id."""
    return clusters(docs, distance, shingle, block).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


class _Words(dict):
    """Hashes of words, kept while there are few enough of them."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        number = xxh64_intdigest(word, SEED)
        if len(self) < STAGE_WORDS and len(word) < 64:
            self[word] = number
        return number


def _mixed(numbers: np.ndarray) -> np.ndarray:
    numbers = (numbers ^ (numbers >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    numbers = (numbers ^ (numbers >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return numbers ^ (numbers >> np.uint64(31))


def shingle_set(text: str | None, known: dict, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """The different shingles of a text as sorted hashes; fewer words than ``shingle`` are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    numbers = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    span = min(shingle, len(words))
    hashes = np.full(len(words) - span + 1, span, dtype=np.uint64)
    for i in range(span):
        hashes = _mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + numbers[i : len(words) - span + 1 + i])
    return np.unique(hashes)


def votes(grams: np.ndarray) -> np.ndarray:
    """For each of ``VOTED_BITS`` bits: the different shingles that set it, less those that do not."""
    ones = np.zeros(VOTED_BITS, np.int64)
    salts = np.arange(1, VOTED_BITS // 64 + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for at in range(0, len(grams), 4096):
        part = np.ascontiguousarray(_mixed(grams[at : at + 4096, None] ^ salts)).view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones * 2 - len(grams)


def wide_simhash(grams: np.ndarray) -> bytes:
    """SimHash of ``STAGE_BITS`` bits over the different shingles, each with weight one."""
    return np.packbits((votes(grams)[:STAGE_BITS] > 0).astype(np.uint8), bitorder="little").tobytes()


def golay_signs() -> np.ndarray:
    """23 x 2048 signs: the even code words; the others are their complements."""
    words = [high << 11 ^ _remainder(high << 11) for high in range(4096)]
    even = np.array([word for word in words if not word & 1], dtype=np.int64)
    return ((even >> np.arange(23)[:, None] & 1) * 2 - 1).astype(np.float32)


def nearest_words(margins: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``LISTED`` code words that agree most with each row of 23 margins: their numbers and agreements."""
    agreement = margins @ signs
    size, rows = np.abs(agreement), np.arange(len(margins))
    numbers, best = np.empty((len(margins), LISTED), np.int32), np.empty((len(margins), LISTED), np.float32)
    for at in range(LISTED):
        top = size.argmax(axis=1)
        numbers[:, at], best[:, at] = top * 2 + (agreement[rows, top] < 0), size[rows, top]
        size[rows, top] = -1
    return numbers, best


def stage_keys(margins: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of ``STAGE_PAIRS`` x ``PROBES`` keys: the pairs of code words nearest to two segments, for each two."""
    keys = []
    for at in range(0, len(margins), 256):
        part, found = margins[at : at + 256].astype(np.float32), []
        for pair in range(STAGE_PAIRS):
            (a, near_a), (b, near_b) = (nearest_words(part[:, 23 * i : 23 * i + 23], signs) for i in (2 * pair, 2 * pair + 1))
            both = (near_a[:, :, None] + near_b[:, None, :]).reshape(len(part), -1)
            words = ((pair << 24) + (a[:, :, None] << 12) + b[:, None, :]).reshape(len(part), -1)
            found.append(np.take_along_axis(words, np.argsort(-both, axis=1, kind="stable")[:, :PROBES], axis=1))
        keys.append(np.concatenate(found, axis=1))
    return np.concatenate(keys) if keys else np.empty((0, STAGE_PAIRS * PROBES), np.int32)


def stage_prints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, a 128-bit digest of the shingle set, its wide fingerprint and its keys."""

    def run(batches):
        from xxhash import xxh128_digest

        known, signs = _Words(), golay_signs()
        for batch in slices(batches):
            digests, margins = [], np.empty((batch.num_rows, VOTED_BITS), np.int64)
            for row, text in enumerate(batch.column("text")):
                grams = shingle_set(text.as_py(), known)
                digests.append(xxh128_digest(grams.tobytes()))
                margins[row] = votes(grams)
            fps = np.packbits((margins[:, :STAGE_BITS] > 0).astype(np.uint8), axis=1, bitorder="little")
            keys = stage_keys(margins, signs)
            ends = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(digests, pa.binary()),
                 pa.array([fp.tobytes() for fp in fps], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))],
                ["doc_id", "text_hash", "digest", "fp", "keys"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, digest binary, fp binary, keys array<int>")


def near_forest(fps: np.ndarray, alike=None, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of one group's pairs within ``STAGE_RADIUS`` for which ``alike`` holds, if given.

    With ``apart`` (a side of each row) only pairs of different sides count.
    """
    parent, found, words = np.arange(len(fps)), [], fps.view(np.uint64)
    for i in range(1, len(fps)):
        near = np.bitwise_count(words[:i] ^ words[i]).sum(axis=1) <= STAGE_RADIUS
        if apart is not None:
            near &= apart[:i] != apart[i]
        at = np.flatnonzero(near)
        if alike is None:  # one row of each tree will do
            at = at[np.unique(parent[at], return_index=True)[1]]
        for j in at.tolist():
            if parent[j] != parent[i] and (alike is None or alike(j, i)):
                found.append((j, i))
                parent[parent == parent[j]] = parent[i]
    return found


def near_pairs(groups: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Row numbers of pairs within the radius, rows sorted by group: all pairs of small groups, a forest of larger ones."""
    starts = np.flatnonzero(np.append(True, (groups[1:] != groups[:-1]).any(axis=1)))
    sizes = np.diff(np.append(starts, len(groups)))
    last = np.repeat(starts + sizes, sizes)  # where the row's group ends
    left, found = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= PAIRED), sizes)), [np.empty((0, 2), np.int64)]
    for step in range(1, PAIRED):
        left = left[left + step < last[left]]
        if not left.size:
            break
        near = left[np.bitwise_count(words[left] ^ words[left + step]).sum(axis=1) <= STAGE_RADIUS]
        found.append(np.stack((near, near + step), axis=1))
    for start, size in zip(starts[sizes > PAIRED].tolist(), sizes[sizes > PAIRED].tolist()):
        forest_of = near_forest(words[start : start + size])
        found.append(np.array(forest_of, np.int64).reshape(-1, 2) + start)
    return np.concatenate(found)


def candidates(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of fingerprints that share a key and lie within the radius; a spanning forest in large keys."""
    # Equal shingle sets have equal fingerprints and keys; different sets may share a fingerprint, but not its keys.
    sets = prints.select("digest", "fp", "keys").dropDuplicates(["digest"])
    keyed = sets.select(F.explode("keys").alias("key"), "fp").repartition("key")
    large = keyed.groupBy("key").count().where(F.col("count") > block)
    blocks = large.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    placed = keyed.join(blocks, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    plain = placed.where(F.col("blocks").isNull()).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    dealt = (
        placed.where(F.col("blocks").isNotNull())
        .select("key", own.alias("own"), other.alias("other"), "fp")
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
        .repartition("key", "i", "j")
    )

    def compare(batches):
        groups, words = np.empty((0, 3), np.int32), np.empty((0, STAGE_BITS // 64), np.uint64)

        def emit(end):
            pairs = near_pairs(groups[:end], words[:end])
            a, b = np.ascontiguousarray(words[pairs[:, 0]]), np.ascontiguousarray(words[pairs[:, 1]])
            found = {(x.tobytes(), y.tobytes()) for x, y, far in zip(a, b, (a != b).any(axis=1)) if far}
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.binary()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            fps = batch.column("fp").cast(pa.binary(STAGE_BITS // 8))
            held = np.frombuffer(fps.buffers()[1], np.uint64).reshape(-1, words.shape[1])[fps.offset : fps.offset + len(fps)]
            groups = np.concatenate((groups, np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)))
            words = np.concatenate((words, held))
            # The last group may go on in the next batch.
            before = np.flatnonzero((groups != groups[-1:]).any(axis=1))
            if before.size:
                end = int(before[-1]) + 1
                yield emit(end)
                groups, words = groups[end:], words[end:]
        if len(groups):
            yield emit(len(groups))

    found = [part.sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a binary, b binary") for part in (plain, dealt)]
    return found[0].unionByName(found[1]).distinct()


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of documents for each (kept_id, kept_hash, ...) of ``chosen``, with its columns."""
    rows = docs.select(*DOCUMENT_COLUMNS, F.xxhash64("text").alias("text_hash"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))
    copies = Window.partitionBy("kept_id", "kept_hash").orderBy(F.lit(0))
    return rows.join(chosen, same).withColumn("copy_no", F.row_number().over(copies)).where("copy_no = 1")


def verified(docs: DataFrame, distinct: DataFrame, coarse: DataFrame, similarity: float = SIMILARITY, block: int = SET_BLOCK) -> DataFrame:
    """Pairs (a, b) of digests: a forest of the pairs of one coarse component (of fingerprints) whose whole sets are similar enough.

    A component of more than ``block`` sets is dealt into at most ``SET_BLOCKS`` blocks whose pairs are groups of their own.
    """

    def sets(batches):
        known = _Words()
        for batch in slices(batches):
            grams = [shingle_set(t.as_py(), known).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("component", "digest", "fp")), pa.array(grams, pa.binary())], ["component", "digest", "fp", "grams"]
            )

    chosen = distinct.join(coarse, F.col("fp") == F.col("node")).select("component", "digest", "fp", "kept_id", "kept_hash")
    members = _texts(docs, chosen).select("component", "digest", "fp", "text")
    members = saved(members.mapInArrow(sets, "component binary, digest binary, fp binary, grams binary"), "sets")
    large = members.groupBy("component").count().where(F.col("count") > block)
    blocks = large.select("component", F.least(F.ceil(F.col("count") / block), F.lit(SET_BLOCKS)).cast("int").alias("blocks"))
    count = F.coalesce("blocks", F.lit(1))
    dealt = (
        members.join(blocks, "component", "left")
        .select("*", F.pmod(F.xxhash64("digest"), count).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), count - 1)).alias("other"))
        .select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "digest", "fp", "grams")
        .repartition("component", "i", "j")
        .sortWithinPartitions("component", "i", "j", "digest")
    )

    def compare(batches):
        group, held = None, []

        def pairs():
            if len(held) < 2:
                return None
            own, digests, fps, grams = zip(*held)
            arrays = [np.frombuffer(g, np.uint64) for g in grams]

            def alike(j, i):
                a, b = arrays[j], arrays[i]
                if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                    return False
                both = len(np.intersect1d(a, b, assume_unique=True))
                return both >= similarity * (len(a) + len(b) - both)

            apart = np.array(own) if group[1] != group[2] else None
            found = near_forest(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), alike, apart)
            if not found:
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array([digests[j] for j, _ in found], pa.binary()), pa.array([digests[i] for _, i in found], pa.binary())], ["a", "b"]
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("component", "i", "j", "own", "digest", "fp", "grams")]
            for component, i, j, *row in zip(*columns):
                if group != (component, i, j):
                    if (rows := pairs()) is not None:
                        yield rows
                    group, held = (component, i, j), []
                held.append(row)
        if (rows := pairs()) is not None:
            yield rows

    return dealt.mapInArrow(compare, "a binary, b binary").distinct()


def kept_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The pipeline's stage: one row of each component of near copies, that of the smallest id, with the columns of documents.

    Two texts are near if their sets of five-word shingles have a Jaccard similarity of at least 0.8.
    """
    prints = saved(stage_prints(docs), "stage_prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first")
    distinct = saved(
        prints.groupBy("digest").agg(first, F.min("fp").alias("fp")).select(
            "digest", "fp", F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash")
        ),
        "stage_distinct",
    )
    coarse = components(candidates(prints, block))
    # Different sets of one fingerprint need no key to meet.
    twins = distinct.groupBy("fp").count().where("count > 1").select(F.col("fp").alias("node"), F.col("fp").alias("component"))
    inner = coarse.unionByName(coarse.select(F.col("component").alias("node"), "component")).unionByName(twins).distinct()
    pairs = verified(docs, distinct, inner)
    # Nodes order like ids, those without one last, so the least node of a component is the row that stays.
    node = F.struct(F.col("kept_id").isNull().alias("unnamed"), F.coalesce("kept_id", F.lit(0)).alias("id"), "digest")
    nodes = lambda side: distinct.select(F.col("digest").alias(side), node.alias(f"{side}_node"))
    edges = pairs.join(nodes("a"), "a").join(nodes("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    dropped = components(edges).select(F.col("node.digest").alias("digest"))
    return _texts(docs, distinct.join(dropped, "digest", "left_anti").select("kept_id", "kept_hash")).select(*DOCUMENT_COLUMNS)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
