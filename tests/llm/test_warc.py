import gzip
import hashlib
import io
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from concordis.llm import warc
from concordis.llm.common import saved


class Slow(io.BytesIO):
    """Gives a few bytes at a time, as a remote file may."""

    def read(self, size=-1):
        return super().read(min(size, 7) if size > 0 else 7)


def members(*parts):
    return b"".join(warc.record(*p) for p in parts)


def test_round_trip_of_a_stream():
    big = os.urandom(300_000)
    data = members((1, "http://a/", b"hello", None), (2, None, big, None), (3, "u r\nl", b"hello", 1), (None, "x", b"", None))
    for stream in (io.BytesIO(data), Slow(data)):
        assert list(warc.records(stream)) == [
            (1, 5, warc.digest(b"hello"), "response", None), (2, len(big), warc.digest(big), "response", None),
            (3, None, warc.digest(b"hello"), "revisit", 1), (None, 0, warc.digest(b""), "response", None),
        ]


def test_each_record_is_a_gzip_member_of_its_own():
    one, two = warc.record(1, "a", b"x" * 1000, None), warc.record(2, "b", b"y", None)
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\n")
    assert gzip.decompress(one + two).count(b"WARC/1.1\r\n") == 2
    assert warc.digest(b"").isupper() and len(warc.digest(b"")) == 32


@pytest.mark.parametrize("spoil", ["cut", "payload", "longer", "shorter", "no record"])
def test_damage_is_noticed(spoil):
    plain = gzip.decompress(warc.record(1, "a", b"some payload", None))
    if spoil == "cut":
        data = warc.record(1, "a", b"some payload", None)[:-20]
    elif spoil == "payload":
        data = gzip.compress(plain.replace(b"some payload", b"SOME payload"))
    elif spoil == "longer":
        data = gzip.compress(plain.replace(b"some payload", b"some more payload"))
    elif spoil == "shorter":
        data = gzip.compress(plain[:-9])
    else:
        data = gzip.compress(b"hello\r\n\r\n")
    with pytest.raises(warc.CorruptArchive):
        list(warc.records(io.BytesIO(data)))


@pytest.fixture
def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i % 6}</p>" if i % 6 else None) for i in range(40)]
    rows += [(100, None, ""), (101, "http://big/", "x" * 3_000_000), (102, "http://e/", "été \U0001f600")]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, refers_to string, payload_size int")


def test_pages(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    found = warc.op5_warc(spark, str(tmp_path)).collect()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({warc.OP5_SQL})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in found) == sorted(expected)


def test_archives_stay_small(pages):
    folder = warc.work_folder(pages.sparkSession, "warc")
    archives = warc.write_archives(warc.with_references(pages).coalesce(1), folder, archive_bytes=2000)
    assert archives.count() > 3
    assert warc.read_archives(archives, folder).count() == pages.count()


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "a", "same"), (5, "a", "same"), (3, "b", "same"), (None, "c", "same"), (None, "d", "alone")]
    found = warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id or 0), r.record_type, r.refers_to or 0, r.payload_bytes) for r in found) == [
        (0, "response", 0, 5), (0, "revisit", 5, 4), (3, "revisit", 5, 4), (5, "response", 0, 4), (5, "response", 0, 4)
    ]


def test_empty_table(spark):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_url_longer_than_a_megabyte():
    data = warc.record(1, "http://a/" + " é" * 600_000, b"body", None) + warc.record(2, "b", b"other", None)
    assert len(list(warc.records(io.BytesIO(data)))) == 2


def test_every_archive_may_have_a_reader_of_its_own(spark, tmp_path):
    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "repeat(uuid(), 20) AS html", "CAST(NULL AS LONG) AS refers_to")
    folder = f"file://{tmp_path}/archives"
    archives = warc.write_archives(pages.repartition(8), folder, archive_bytes=8_000)
    count = archives.count()
    read = warc.read_archives(archives, folder)
    tasks = read.select(F.spark_partition_id().alias("task")).distinct().count()
    assert count > 20 and read.count() == 400 and read.rdd.getNumPartitions() == count and tasks > count / 2


def test_a_folder_without_scheme_is_not_guessed(spark):
    assert warc._shared(spark, "hdfs://host/x") == "hdfs://host/x" and warc._shared(spark, "/x") == "file:///x"


def test_a_plain_folder_of_a_cluster_is_named_by_spark(spark):
    class OnCluster:
        conf, read = {"spark.master": "spark://host:7077", "spark.checkpoint.dir": "/y"}, spark.read

    assert warc._shared(OnCluster, "/y/archives") == "file:///y/archives"
