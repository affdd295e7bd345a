import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from concordis.functions.identity import field_value_violation
from concordis.sources import corpus, stores

SCHEMA = "id string, amount decimal(18,6), cost struct<availability:string,value:decimal(18,6)>, tags array<string>"


def rows(spark):
    return spark.createDataFrame(
        [("a", Decimal("0.005"), ("reported", Decimal("1.5")), ["x"]), ("é\n", None, ("unknown", None), [])], SCHEMA
    )


def test_jsonl_round_trip_keeps_money_as_text(spark, tmp_path):
    path = str(tmp_path / "s.jsonl")
    stores.write_jsonl(rows(spark), path)
    text = "".join(open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".json"))
    assert '"amount":"0.005"' in text and '"value":"1.5"' in text and '"amount":null' in text
    assert sorted(stores.read_jsonl(spark, path, SCHEMA).collect(), key=str) == sorted(rows(spark).collect(), key=str)


def test_missing_store_is_empty_and_blank_lines_are_skipped(spark, tmp_path):
    assert stores.read_jsonl(spark, str(tmp_path / "none.jsonl"), SCHEMA).count() == 0
    path = tmp_path / "one.jsonl"
    path.write_text('{"id":"a"}\n\n{"id":"b"}\n')
    assert [r.id for r in stores.read_jsonl(spark, str(path), "id string").collect()] == ["a", "b"]
    path.write_text('{"id":"a"}\n{broken\n')
    with pytest.raises(Exception):
        stores.read_jsonl(spark, str(path), "id string").collect()


def test_a_bad_record_leaves_the_store_as_it_was(spark, tmp_path):
    path = str(tmp_path / "t")
    good = rows(spark).withColumn("run_manifest_id", F.lit("r"))
    rule = field_value_violation(F.col("cost"))
    stores.write_table(good, path, rule)
    bad = good.withColumn("cost", F.struct(F.lit("unknown").alias("availability"), F.lit(Decimal("1")).cast("decimal(18,6)").alias("value")))
    with pytest.raises(Exception):
        stores.write_table(bad, path, rule)
    assert stores.read_table(spark, path, good.schema).count() == 2


def test_writing_one_run_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "runs")
    frame = lambda run, n: spark.range(n).select(F.lit(run).alias("run_manifest_id"), "id")
    schema = "run_manifest_id string, id bigint"
    stores.write_table(frame("a", 3).unionByName(frame("b", 2)), path)
    stores.write_table(frame("b", 5), path)
    counts = {r.run_manifest_id: r["count"] for r in stores.read_table(spark, path, schema).groupBy("run_manifest_id").count().collect()}
    assert counts == {"a": 3, "b": 5}


def test_journal_append_and_single_documents(spark, tmp_path):
    path = str(tmp_path / "journal")
    for start in (0, 3):
        stores.append_journal(spark.range(start, start + 3), path)
    assert stores.read_table(spark, path, "id bigint").count() == 6
    runs = spark.createDataFrame([("a",), ("b",)], "run_manifest_id string")
    store = spark.createDataFrame([("a", 1)], "run_manifest_id string, v int")
    found = {r.run_manifest_id: r.document for r in stores.documents(runs, store).collect()}
    assert found["a"].v == 1 and found["b"] is None


def png(width, height, colour=2):
    return bytes.fromhex("89504E470D0A1A0A0000000D49484452") + width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, colour, 0, 0, 0])


def test_corpus_scan_and_sealing(spark, tmp_path):
    root = tmp_path / "corpus"
    for name, body in {
        "D-COMP/a.png": png(30, 40), "D-COMP/deep/b.PNG": png(5, 6, 6), "plain.jpg": b"x", "note.txt": b"y", "misc/D-GEO/c.tif": b"z",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    files = corpus.scan_corpus(spark, str(root))
    items = {r.dataset_item_id: r.f for r in files.select("dataset_item_id", corpus.seed_family(F.col("dataset_item_id")).alias("f")).collect()}
    assert items == {"D-COMP/a.png": "D-COMP", "D-COMP/deep/b.PNG": "D-COMP", "plain.jpg": None, "misc/D-GEO/c.tif": None}
    only = spark.createDataFrame([("plain.jpg",), ("gone.png",)], "dataset_item_id string")
    found = corpus.scan_corpus(spark, str(root), only=only)
    assert [r.dataset_item_id for r in found.collect()] == ["plain.jpg"]
    assert [r.dataset_item_id for r in corpus.missing_items(only, found).collect()] == ["gone.png"]
    settings = {"dataset_id": "d", "dataset_version": "1", "language": "en"}
    pages = {r.dataset_item_id: r for r in corpus.source_pages(files, settings).collect()}
    assert (pages["D-COMP/a.png"].width_px, pages["D-COMP/a.png"].height_px, pages["D-COMP/a.png"].color_mode) == (30, 40, "RGB")
    assert pages["D-COMP/deep/b.PNG"].color_mode == "RGBA" and pages["plain.jpg"].width_px is None
    assert pages["misc/D-GEO/c.tif"].media_type == "image/tiff" and pages["plain.jpg"].byte_size == 1
    again = {r.dataset_item_id: r.source_page_id for r in corpus.source_pages(files.repartition(3), settings).collect()}
    assert again == {k: r.source_page_id for k, r in pages.items()}


def test_item_ids_and_roots(spark):
    df = spark.createDataFrame([("a/b_1.png",), ("a b",), ("x?y",), ("é",)], "dataset_item_id string")
    safe, unsafe = corpus.split_unsafe(df)
    assert [r[0] for r in safe.collect()] == ["a/b_1.png"] and unsafe.count() == 3
    corpus.check_output_root("/data/in", "/data/in-out")
    corpus.check_output_root("s3://one/in", "s3://two/in/x")
    for bad in ("/data/in", "/data/in/", "file:/data/in/out"):
        with pytest.raises(ValueError):
            corpus.check_output_root("/data/in", bad)


def test_a_run_without_rows_replaces_its_old_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "run_manifest_id string, n int")
    runs = spark.createDataFrame([("a",)], "run_manifest_id string")
    stores.write_table(rows, path, runs=runs)
    stores.write_table(rows.limit(0), path, runs=runs)
    assert [r.n for r in stores.read_table(spark, path, rows.schema).collect()] == [3]
    assert stores.live(spark.read.parquet(path)).count() == 1


def test_money_inside_arrays_and_maps_is_text(spark, tmp_path):
    schema = "id string, parts array<struct<cost:decimal(18,6)>>, by map<string,decimal(18,6)>"
    rows = spark.createDataFrame([("a", [(Decimal("0.5"),), (None,)], {"x": Decimal("1.25")})], schema)
    stores.write_jsonl(rows, str(tmp_path / "j"))
    assert '{"cost":"0.5"}' in spark.read.text(str(tmp_path / "j")).head().value
    assert stores.read_jsonl(spark, str(tmp_path / "j"), schema).collect() == rows.collect()


def jpeg(width, height, parts=3, between=b"", frame=0xC2):
    return b"\xff\xd8" + between + bytes([0xFF, frame, 0, 17, 8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([parts]) + b"rest"


def tiff(order, tags, before=b""):
    number = lambda n, size: n.to_bytes(size, order)
    entries = b"".join(number(t, 2) + number(3 if v < 65536 else 4, 2) + number(1, 4) + (number(v, 2) + b"\0\0" if v < 65536 else number(v, 4)) for t, v in tags.items())
    mark = b"II*\0" if order == "little" else b"MM\0*"
    return mark + number(8 + len(before), 4) + before + number(len(tags), 2) + entries + number(0, 4) + b"pixels"


def test_sizes_of_photos(spark):
    long = b"\xff\xe1\xff\xff" + b"\xff\xc0" * 32766 + b"\0"  # a full segment that holds what looks like a frame
    table = b"\xff\xc4\x00\x04ab"
    grey = {256: 70000, 257: 3, 258: 16, 262: 1, 277: 1}
    cases = {
        "jpeg": (jpeg(640, 480), (640, 480, "RGB")), "fill": (jpeg(5, 6, 1, b"\xff\xff\xff\xd0" + table), (5, 6, "L")),
        "far": (jpeg(7, 8, 4, long * 3), (7, 8, "CMYK")), "cut": (jpeg(1, 2)[:8], None), "scan": (b"\xff\xd8\xff\xda\0\4ab" + jpeg(1, 2), None),
        "broken": (b"\xff\xd8\xff\xe0\0\0\0\0", None), "start": (b"\xff\xd8\xff", None),
        "little": (tiff("little", grey), (70000, 3, "I;16")), "end": (tiff("big", {**grey, 258: 1}, b"p" * 100_000), (70000, 3, "1")),
        "colour": (tiff("big", {256: 9, 257: 8, 262: 2, 277: 3}), (9, 8, "RGB")), "palette": (tiff("little", {256: 9, 257: 8, 258: 8, 262: 3}), (9, 8, "P")),
        "no size": (tiff("little", {262: 2}), None), "outside": (b"II*\0\xff\xff\xff\xff", None), "short": (b"MM\0*", None),
        "png": (png(3, 4), (3, 4, "RGB")), "text": (b"text", None), "empty": (b"", None), "none": (None, None),
    }
    rows = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, (c, _) in cases.items()], "k string, c binary")
    found = {r.k: r.s and tuple(r.s) for r in rows.select("k", corpus.image_size(F.col("c")).alias("s")).collect()}
    assert found == {k: v for k, (_, v) in cases.items()}
