"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordis.session import work_folder

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A word is a run of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Parts into which the rows of one key are dealt where a key may hold a third of all rows.
HOT_PARTS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 1000):
    """Arrow batches cut into smaller ones, so that few texts are Python strings at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared work folder: computed once, safe when executors go."""
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined_by_hot_key(rows: DataFrame, values: DataFrame, key: str, salt: Column) -> DataFrame:
    """``rows`` joined with ``values`` (one row for each key) by ``key``, a key's rows dealt over tasks by ``salt``.

    The values go to the (key, part) pairs that occur first: at most ``HOT_PARTS`` rows for a hot key, one for a
    key of one row.  No key is told apart by its size.
    """
    dealt = rows.withColumn("hot_part", F.pmod(salt, F.lit(HOT_PARTS)))
    parts = dealt.select(key, "hot_part").distinct().join(values, key)
    return dealt.join(parts, [key, "hot_part"]).drop("hot_part")


def numbered(rows: DataFrame, order: Sequence[str], group: Sequence[str] = (), sizes: Sequence[str] = ()) -> DataFrame:
    """Add ``row_no`` and ``<size>_before`` for each size: ranks and running sums without one big window.

    Rows are dealt by range over (group, order) and stored with their range; each range is
    numbered alone and shifted by what earlier ranges of the group hold.  The result depends
    on the order only, not on where the ranges were cut.  Group columns must not be null.
    """
    ranged = saved(
        rows.repartitionByRange(*group, *order).withColumn("range_no", F.spark_partition_id()), "ranges"
    )
    earlier = Window.partitionBy(*group).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range_no", *group).agg(
        F.count(F.lit(1)).alias("total_rows"), *[F.sum(s).alias(f"total_{s}") for s in sizes]
    )
    shifts = totals.select(
        "range_no", *group,
        *[F.coalesce(F.sum(f"total_{s}").over(earlier), F.lit(0)).alias(f"shift_{s}") for s in ("rows", *sizes)],
    )
    inside = Window.partitionBy("range_no", *group).orderBy(*order)
    up_to = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("row_no", (F.row_number().over(inside) - 1).cast("long")).withColumns(
        {f"{s}_before": F.coalesce(F.sum(s).over(up_to), F.lit(0)) for s in sizes}
    )
    return out.join(shifts, ["range_no", *group]).select(
        *rows.columns,
        (F.col("row_no") + F.col("shift_rows")).alias("row_no"),
        *[(F.col(f"{s}_before") + F.col(f"shift_{s}")).alias(f"{s}_before") for s in sizes],
    )


def whole(text: Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(text, F.lit(""))
