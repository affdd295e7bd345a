"""Cross-site boilerplate: lines that many sites share are removed from every document.

Each different line gets a HyperLogLog sketch of the sites it occurs on.  Sketches are built inside the
tasks and merged by aggregation, so neither a line on every site nor one in a third of all documents gathers rows.
Estimates decide lines well above or below the threshold; those within ``BAND`` of it (more than ten standard errors) get
an exact count of distinct sites over all their occurrences.  A line of ``MIN_SITES`` sites or more is boilerplate.

The occurrences of boilerplate lines are joined by line hash (128 bits), gathered as line numbers
for each document, and dropped there.

Cases: a null text is one empty line; empty lines are never removed; a line repeated inside a document counts once for
its site and is removed everywhere; a null site is a site of its own; repeated rows are cleaned alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordis.llm.common import saved, table, whole

MIN_SITES = 8
SKETCH_BITS = 12
BAND = 0.2


def _keyed(docs: DataFrame, site: str) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.split(whole(F.col("text")), "\n").alias("lines"),
        # The prefix keeps a missing site apart from every named one.
        F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("none")).alias("site"),
    )


def _lines(keyed: DataFrame) -> DataFrame:
    """doc_id, text_hash, site, line number and line hash of every line that is not empty."""
    return keyed.select("doc_id", "text_hash", "site", F.posexplode("lines").alias("line_no", "line")).where("line <> ''").select(
        "doc_id", "text_hash", "site", "line_no", F.unhex(F.md5("line")).alias("line_hash")
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, sketch_bits: int = SKETCH_BITS, band: float = BAND) -> DataFrame:
    """line_hash and sites (estimated, exact near the threshold) of the lines to remove."""
    spread = lines.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", sketch_bits)).alias("sites"))
    candidates = saved(spread.where(F.col("sites") >= min_sites * (1 - band)), "candidates")
    sure = candidates.where(F.col("sites") > min_sites * (1 + band))
    near = candidates.where(F.col("sites") <= min_sites * (1 + band)).select("line_hash")
    exact = (
        lines.select("line_hash", "site").join(near, "line_hash", "left_semi").distinct()
        .groupBy("line_hash").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    )
    return sure.unionByName(exact)


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, **options) -> DataFrame:
    """doc_id, cleaned text, and the numbers of lines before and removed."""
    keyed = _keyed(docs, site)
    lines = _lines(keyed)
    shared = saved(boilerplate(lines, min_sites, **options), "boilerplate")
    removed = (
        lines.join(shared.select("line_hash"), "line_hash")
        .groupBy(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"))
        .agg(F.collect_set("line_no").alias("hits"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    marked = keyed.join(removed, same, "left").withColumn(
        "drop", F.array_sort(F.coalesce("hits", F.array().cast("array<int>")))
    )
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(F.array_except(places, F.col("drop")), lambda i: F.get("lines", i))
    return marked.select(
        "doc_id", F.when(F.size("drop") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"), F.size("drop").cast("long").alias("removed_lines"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "removed_lines", F.sha2(F.col("text").cast("binary"), 256).alias("cleaned_sha256"))


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'none') AS site, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, site, unnest(lines) AS line, unnest(range(len(lines))) AS line_no FROM d
), b AS (
  SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}
), m AS (
  SELECT l.doc_id, l.line, l.line_no, b.line IS NOT NULL AS hit FROM l LEFT JOIN b ON l.line = b.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hit) AS removed_lines,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT hit), '')) AS cleaned_sha256
FROM m GROUP BY doc_id
"""
