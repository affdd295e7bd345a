"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Every shingle of five words is hashed once.  The top eight bits of the hash name one of 256 bins; a bin's value is the
least hash in it.  Empty bins are filled by optimal densification: bin i takes the value of the first non-empty bin in
a probe sequence of its own, the same for all documents (eight universal hash probes, then all bins in the order
of a hash of both numbers).  Of each value the low four bits are kept, packed into sixteen longs.

Two fingerprints agree in a share m of bins.  Unequal values agree in four bits by chance
(1 in 16), so the likeness is (m - 1/16) / (1 - 1/16), kept within 0 to 1.

Cases: a null text counts as empty; a text without words has the all-zero fingerprint; one of fewer than
five words has one shingle, the whole of it; equal texts have equal fingerprints.  Rows of one id are ordered by a
hash of the text; repeated rows are neighbours like any other; the only row is its own next row.
An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordis.llm.common import WORD, numbered, saved, table, whole

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
LOW_BITS = 4
PROBES = 8
_EMPTY = -1


def _bin(value: Column) -> Column:
    """Bins in the order of signed sorting."""
    return F.shiftrightunsigned(value, 64 - BIN_BITS).bitwiseXOR(F.lit(BINS // 2).cast("long"))


def _low(value: Column) -> Column:
    return value.bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("long"))


def _shingles(words: Column) -> Column:
    """Hashes of all runs of five words; of the whole when there are fewer."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])
    )
    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) >= SHINGLE, runs).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(none)


def _spread(least: Column) -> Column:
    """Low bits of the bins' values in order of bins, with marks for empty bins."""
    gap = lambda n: F.array_repeat(F.lit(_EMPTY).cast("long"), n.cast("int"))
    following = lambda i: F.coalesce(_bin(F.get(least, i + 1)), F.lit(BINS).cast("long"))
    runs = F.transform(least, lambda x, i: F.concat(F.array(_low(x)), gap(following(i) - _bin(x) - 1)))
    return F.concat(gap(_bin(F.get(least, F.lit(0)))), F.flatten(runs))


def _filled(bins: Column, least: Column) -> Column:
    def probe(i, t):
        # An odd factor makes the probe a permutation of the bins.
        factor, shift = 2 * (t * 37 + 11) + 1, t * 101 + 29
        return F.get(bins, F.pmod(i * factor + shift, F.lit(BINS)))

    def value(x, i):
        out = F.when(x != _EMPTY, x)
        for t in range(PROBES):
            out = out.when(probe(i, t) != _EMPTY, probe(i, t))
        order = F.transform(least, lambda y: F.struct(F.xxhash64(i, _bin(y)).alias("rank"), _low(y).alias("low")))
        return out.otherwise(F.array_min(order)["low"])

    return F.transform(bins, value)


def _packed(bins: Column) -> Column:
    per_long = 64 // LOW_BITS
    return F.transform(
        F.sequence(F.lit(0), F.lit(BINS // per_long - 1)),
        lambda j: F.aggregate(
            F.slice(bins, j * per_long + 1, F.lit(per_long)), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, LOW_BITS).bitwiseOR(x)
        ),
    )


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add the packed fingerprint (array of longs) of a text column.

    Each step is a column of its own, so that no step's work is repeated inside a later one.
    """
    w, s, b = (f"{name}_{k}" for k in ("words", "least", "bins"))
    out = rows.withColumn(w, F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)))
    out = out.withColumn(s, F.sort_array(_shingles(F.col(w)))).drop(w)
    first = lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(s), i - 1)))
    out = out.withColumn(s, F.filter(s, first))
    out = out.withColumn(b, F.when(F.size(s) > 0, _spread(F.col(s))))
    out = out.withColumn(b, F.when(F.array_contains(b, _EMPTY), _filled(F.col(b), F.col(s))).otherwise(F.col(b)))
    zero = F.array_repeat(F.lit(0).cast("long"), BINS * LOW_BITS // 64)
    return out.withColumn(name, F.when(F.col(b).isNull(), zero).otherwise(_packed(F.col(b)))).drop(s, b)


def likeness(left: Column, right: Column) -> Column:
    """Estimated share of common shingles, corrected for low bits that agree by chance."""

    def agreeing(a, b):
        x = a.bitwiseXOR(b)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return 16 - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    same = F.aggregate(F.zip_with(left, right, agreeing), F.lit(0), lambda a, x: a + x)
    chance = 1.0 / (1 << LOW_BITS)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same / BINS - chance) / (1 - chance)))


def shown(packed: Column) -> Column:
    return F.lower(F.array_join(F.transform(packed, lambda v: F.lpad(F.hex(v), 16, "0")), ""))


#: A row's key: whether it has no id, its id, and a hash of its text; none of these is null.
KEY = ("no_id", "id", "text_hash")


def edited_texts(docs: DataFrame) -> DataFrame:
    """row_no, next_no, doc_id, n_chars, text and edited text, in order of id.

    Only ids and lengths are ordered.  Texts are dealt by key once, for both uses; of the next
    document just the characters that are needed move on.
    """
    keyed = docs.select(
        F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"),
        F.xxhash64("text").alias("text_hash"), whole(F.col("text")).alias("text"),
    )
    narrow = saved(keyed.select((~F.col("no_id")).alias("has_id"), *KEY, F.char_length("text").cast("long").alias("n_chars")), "lengths")
    count = F.lit(max(narrow.count(), 1))
    rows = saved(numbered(narrow, ("has_id", "id", "text_hash")).drop("has_id"), "order")
    # What row r gives away goes to the row before it.
    before = rows.select(
        F.pmod(F.col("row_no") + 1, count).alias("row_no"), F.col("row_no").alias("before_no"),
        F.struct(*KEY).alias("before"), F.floor(F.col("n_chars") / 4).cast("int").alias("replaced"),
    )
    wanted = rows.join(before, "row_no").groupBy(*KEY).agg(F.collect_list(F.struct("before", "before_no", "replaced")).alias("wanted"))
    # Repeated rows have one key and one text.
    once = keyed.withColumn("copy_no", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(0)))).where("copy_no = 1").drop("copy_no")
    heads = once.join(wanted, list(KEY)).select("text", F.inline("wanted")).select(
        "before.*", "before_no", "replaced", F.left("text", F.col("replaced")).alias("head")
    )
    return once.join(heads, list(KEY)).select(
        F.col("before_no").alias("row_no"), F.pmod(F.col("before_no") + 1, count).alias("next_no"),
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), F.char_length("text").cast("long").alias("n_chars"), "text",
        F.concat(F.left("text", F.char_length("text") - F.col("replaced")), "head").alias("edited"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, with likeness to the edited and the next text."""
    rows = edited_texts(docs).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = with_fingerprint(with_fingerprint(rows, "text", "fp"), "edited", "edited_fp")
    prints = saved(rows.select("row_no", "next_no", "doc_id", "n_chars", "edited_sha256", "fp", "edited_fp"), "prints")
    following = prints.select(F.col("row_no").alias("next_no"), F.col("fp").alias("next_fp"))
    return prints.join(following, "next_no").select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("fp")).alias("fingerprint"), shown(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
