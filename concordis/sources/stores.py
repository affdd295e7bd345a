"""Record stores: JSON lines for interchange, Parquet inside, journals by append."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordis.functions.identity import money_text
from concordis.session import work_folder

_RUN = "run_manifest_id"
_MARKER = "run_marker"


def _read_or_empty(spark: SparkSession, load, schema: T.StructType) -> DataFrame:
    try:
        return load()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _as_stored(data_type: T.DataType) -> T.DataType:
    """The type a value has in JSON: money is text, never a number."""
    if isinstance(data_type, T.DecimalType):
        return T.StringType()
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(_as_stored(data_type.elementType))
    if isinstance(data_type, T.MapType):
        return T.MapType(data_type.keyType, _as_stored(data_type.valueType))
    if isinstance(data_type, T.StructType):
        return T.StructType([T.StructField(f.name, _as_stored(f.dataType)) for f in data_type.fields])
    return data_type


def _to_stored(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.DecimalType):
        return money_text(value)
    if isinstance(data_type, T.StructType) and _as_stored(data_type) != data_type:
        members = [_to_stored(value[f.name], f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(value.isNotNull(), F.struct(*members))
    if isinstance(data_type, T.ArrayType) and _as_stored(data_type) != data_type:
        return F.transform(value, lambda item: _to_stored(item, data_type.elementType))
    if isinstance(data_type, T.MapType) and _as_stored(data_type) != data_type:
        return F.transform_values(value, lambda _, item: _to_stored(item, data_type.valueType))
    return value


def _parsed(schema) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else T.StructType(list(schema))


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON lines store under a stated schema; a missing store is empty.

    Blank lines are skipped.  A line that does not fit the schema fails the read.
    """
    wanted = _parsed(schema)
    reader = spark.read.schema(_as_stored(wanted)).option("mode", "FAILFAST")
    rows = _read_or_empty(spark, lambda: reader.json(path), _as_stored(wanted))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])


def _check(df: DataFrame, violation: Column | None) -> DataFrame:
    if violation is None:
        return df
    refused = F.raise_error(F.concat(F.lit("record breaks a store rule: "), F.to_json(F.struct(*df.columns))))
    # The check is part of the write, so a bad record stops the commit of the whole store.
    return df.where(F.when(violation, refused.cast("boolean")).otherwise(True))


def write_jsonl(df: DataFrame, path: str, violation: Column | None = None, by_run: bool = False) -> None:
    """Replace a JSON lines store; the output committer makes the swap."""
    checked = _check(df, violation)
    stored = checked.select(*[_to_stored(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
    writer = stored.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(_RUN) if by_run else writer).json(path)


def write_table(df: DataFrame, path: str, violation: Column | None = None, by_run: bool = True, runs: DataFrame | None = None) -> None:
    """Replace a Parquet store, or only some runs of it when parted by run.

    Replaced are the runs present in ``df`` and those named in ``runs``.  Each of these gets a
    marker row, so that a run without rows replaces its old rows too; readers leave markers out.
    Rows of one run are brought together before the write, large runs in several tasks.
    """
    rows = _check(df, violation)
    if not by_run:
        rows.write.mode("overwrite").parquet(path)
        return
    if runs is not None:
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name != _RUN]
        markers = runs.select(_RUN).distinct().select(_RUN, *blank).withColumn(_MARKER, F.lit(True))
        rows = rows.withColumn(_MARKER, F.lit(None).cast("boolean")).unionByName(markers.select(*df.columns, _MARKER))
    rows.hint("rebalance", _RUN).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_RUN).parquet(path)


def live(rows: DataFrame) -> DataFrame:
    """Rows of a store read without a schema, without its marker rows."""
    return rows.where(F.col(_MARKER).isNull()).drop(_MARKER) if _MARKER in rows.columns else rows


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet store under a stated schema; a missing store is empty."""
    wanted = _parsed(schema)
    marked = T.StructType([*wanted.fields, T.StructField(_MARKER, T.BooleanType())])
    rows = _read_or_empty(spark, lambda: spark.read.schema(marked).parquet(path), marked)
    return rows.where(F.col(_MARKER).isNull()).select(*[f.name for f in wanted.fields])


def append_journal(events: DataFrame, path: str, violation: Column | None = None) -> None:
    """Add events to a journal.  Costs the new rows only; earlier rows are not read."""
    _check(events, violation).write.mode("append").parquet(path)


def documents(runs: DataFrame, store: DataFrame, key: str = _RUN) -> DataFrame:
    """Single-document stores: one row per run, NULL where the run has no document."""
    payload = F.struct(*[c for c in store.columns if c != key]).alias("document")
    return runs.select(key).distinct().join(store.select(key, payload), key, "left")


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared work folder and read it back.

    Cuts the lineage of a result with several readers; survives the loss of executors.
    """
    path = work_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
