"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows are numbered by id (``common.numbered``: by ranges, no single window).  Row number r of n goes to
place p(r), where p is a permutation of 0 to n-1: a balanced Feistel network over the least even
number of bits that holds n, applied again while the outcome is n or more (cycle walking).  Shard is p mod shards
and slot is p div shards, so shard sizes differ by one row at most and slots have no gaps; both can be computed
from the row number, the row count and the seed alone, and the permutation can be inverted.

Cases: a null text has no bytes and so size 1; a null id is numbered first; rows of one id are ordered
by checksum and size, and repeated rows are alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordis.llm.common import numbered, saved, table, whole

SHARDS = 8
SEED = 20250101
ROUNDS = 6


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; wraps modulo 2^64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> np.ndarray:
    steps = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mixed(steps + np.uint64(seed))


def _pass(x: np.ndarray, half: int, keys: np.ndarray, inverse: bool) -> np.ndarray:
    mask, width = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> width, x & mask
    for key in keys[::-1] if inverse else keys:
        if inverse:
            left, right = right ^ (_mixed(left + key) & mask), left
        else:
            left, right = right, left ^ (_mixed(right + key) & mask)
    return left << width | right


def permuted(numbers: np.ndarray, count: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The places of row numbers below ``count``; with ``inverse`` the row numbers of places."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    keys = _keys(seed)
    out = _pass(numbers.astype(np.uint64), half, keys, inverse)
    while (outside := out >= count).any():
        out[outside] = _pass(out[outside], half, keys, inverse)
    return out.astype(np.int64)


def place(row_no: Column, count: int, seed: int = SEED) -> Column:
    @F.arrow_udf("long")
    def of(numbers: pa.Array) -> pa.Array:
        return pa.array(permuted(numbers.to_numpy(), count, seed), pa.int64())

    return of(row_no)


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    rows = saved(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(whole(F.col("text"))) + 1).cast("long").alias("size"),
            F.crc32(whole(F.col("text")).cast("binary")).alias("text_crc32"),
        ),
        "rows",
    )
    placed = numbered(rows, ("doc_id", "text_crc32", "size")).withColumn("place", place(F.col("row_no"), rows.count(), seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
