"""Exact dedup over an extendible-hash index kept in shared files.

1. Every text gets a key of ``key_bits`` hash bits.  Counts by key prefix decide the
   directory: it doubles as long as some bucket holds more than ``capacity`` rows, and each
   doubling splits just the overfull buckets.  The directory has at most 2^max_depth slots,
   so it may be sent to every task (16 bytes a slot, 16 MB at depth 20).
2. Owner tasks each get whole buckets, that is ranges of keys.  Inside a bucket rows of one
   key form chains, one chain for each different text: the texts themselves are compared, byte
   by byte, so colliding keys never merge.  A bucket that no split can shrink (one key with many
   copies) is dealt into overflow pages of about ``capacity`` rows by document id.
3. The chains are written as the index.  Only texts of paged buckets are compared once more,
   one row per chain and page, to join the pages of one text.

Cases: a null text counts as empty, and empty texts equal each other.  Among repeated rows of
one id and text one stays.  A null id sorts below all ids.  An empty table gives no rows.
Other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordis.llm.common import DOCUMENT_COLUMNS, saved, slices, table

CAPACITY = 16384
MAX_DEPTH = 20
KEY_BITS = 62


def _keyed(docs: DataFrame, key_bits: int, with_text: bool) -> DataFrame:
    """doc_id, key and, if wanted, the normalised text and its digest."""

    def run(batches):
        for batch in slices(batches):
            bodies = [(t or "").encode().lower() for t in batch.column("text").to_pylist()]
            digests = [hashlib.sha256(b) for b in bodies]
            keys = [int.from_bytes(d.digest()[:8], "big") >> (64 - key_bits) for d in digests]
            columns = [batch.column("doc_id"), pa.array(keys, pa.int64())]
            names = ["doc_id", "key"]
            if with_text:
                columns += [pa.array(bodies, pa.binary()), pa.array([d.hexdigest() for d in digests], pa.string())]
                names += ["body", "text_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, key long" + (", body binary, text_sha256 string" if with_text else "")
    )


def directory(counts: np.ndarray, capacity: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Global depth, and each slot's bucket (its first slot) and overflow pages."""
    depth, deepest = 0, int(counts.size).bit_length() - 1
    local = np.zeros(1, dtype=np.int64)
    while depth < deepest:
        overfull = (local == depth) & (counts.reshape(1 << depth, -1).sum(axis=1) > capacity)
        if not overfull.any():
            break
        depth += 1
        local = np.repeat(local, 2)
        local[np.repeat(overfull, 2)] = depth
    slots = np.arange(1 << depth)
    buckets = (slots >> (depth - local)) << (depth - local)
    held = np.bincount(buckets, weights=counts.reshape(1 << depth, -1).sum(axis=1), minlength=1 << depth)
    pages = np.maximum(1, np.ceil(held[buckets] / capacity)).astype(np.int64)
    return depth, buckets, pages


def build_directory(docs: DataFrame, capacity: int, max_depth: int, key_bits: int) -> tuple[int, DataFrame]:
    spark = docs.sparkSession
    found = (
        _keyed(docs, key_bits, with_text=False)
        .groupBy(F.shiftright("key", key_bits - max_depth).alias("prefix"))
        .count()
        .toPandas()
    )
    counts = np.zeros(1 << max_depth, dtype=np.int64)
    counts[found["prefix"].to_numpy(dtype=np.int64)] = found["count"].to_numpy(dtype=np.int64)
    depth, buckets, pages = directory(counts, capacity)
    slots = pa.table({"slot": np.arange(1 << depth), "bucket": buckets, "pages": pages})
    return depth, saved(spark.createDataFrame(slots), "directory")


def build_index(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key_bits: int = KEY_BITS) -> DataFrame:
    """The index: one row per bucket, page and chain, with the ids of the chain's rows."""
    max_depth = min(max_depth, key_bits)
    depth, slots = build_directory(docs, capacity, max_depth, key_bits)
    placed = (
        _keyed(docs, key_bits, with_text=True)
        .withColumn("slot", F.shiftright("key", key_bits - depth) if depth else F.lit(0).cast("long"))
        .join(F.broadcast(slots), "slot")  # at most 2^max_depth slots
        .withColumn("page", F.pmod(F.xxhash64("doc_id"), F.col("pages")))
    )
    chains = (
        placed.repartition("bucket", "page")
        .groupBy("bucket", "page", "key", "body")
        .agg(
            F.max("doc_id").alias("page_keep"),
            F.sort_array(F.collect_list(F.struct("doc_id")), asc=False).alias("ids"),
            F.any_value("text_sha256").alias("text_sha256"),
            F.max("pages").alias("pages"),
        )
    )
    return saved(
        chains.select(
            "bucket", "page", "key", F.when(F.col("pages") > 1, F.col("body")).alias("body"),
            F.size("ids").cast("long").alias("rows"), "page_keep", "ids", "text_sha256",
        ),
        "index",
    )


def resolve(index: DataFrame) -> DataFrame:
    """One row per document: the row that stays, the group's size and whether it stays itself."""
    texts = (
        index.where(F.col("body").isNotNull())
        .groupBy("key", "body")
        .agg(F.max("page_keep").alias("keep"), F.sum("rows").alias("total"))
        .withColumnRenamed("key", "text_key")
        .withColumnRenamed("body", "text_body")
    )
    merged = index.join(
        texts, (F.col("key") == F.col("text_key")) & (F.col("body") == F.col("text_body")), "left"
    ).withColumns(
        {
            "keep_id": F.when(F.col("total").isNull(), F.col("page_keep")).otherwise(F.col("keep")),
            "group_size": F.coalesce("total", "rows"),
        }
    )
    return merged.select(
        "keep_id", "group_size", "page_keep", "text_sha256", F.posexplode("ids").alias("at", "member")
    ).select(
        F.col("member.doc_id").alias("doc_id"), "keep_id", "group_size",
        ((F.col("at") == 0) & F.col("page_keep").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key_bits: int = KEY_BITS) -> DataFrame:
    return resolve(build_index(docs, capacity, max_depth, key_bits))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with the columns of documents; of repeated rows one."""

    @F.arrow_udf("string")
    def digest(texts: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256((t.as_py() or "").encode().lower()).hexdigest() for t in texts], pa.string())

    winners = exact_dedup(docs, **options).where("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha256")
    )
    rows = docs.select(*DOCUMENT_COLUMNS, digest("text").alias("text_sha256"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_sha256") == F.col("kept_sha256"))
    copies = Window.partitionBy("kept_id", "kept_sha256").orderBy(F.lit(0))
    return rows.join(winners, same).withColumn("copy_no", F.row_number().over(copies)).where("copy_no = 1").select(*DOCUMENT_COLUMNS)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
), k AS (
  SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM k
"""
