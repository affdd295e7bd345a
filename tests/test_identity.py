import hashlib
import json
import re
import time
from decimal import Decimal

from pyspark.sql import functions as F

from concordis.functions import identity as ident
from concordis.schemas import ATTEMPT_EVENTS, RECORD_TYPES


def canon(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_json_string_matches_the_standard_writer(spark):
    texts = ["plain", 'q"b\\s\n\t\x0b\x0e\x1f\x7f', "\\u000B é /", "\\\\u000b\x0b\x1e", "", "\n", "\U0001f600", "a b"]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", ident.json_string(F.col("v")).alias("j"))
    for r in rows.collect():
        assert r.j == json.dumps(r.v, ensure_ascii=False)


def test_json_string_of_long_lines_costs_one_pass(spark):
    # A pass of each escape's pattern over the whole text took eleven times as long as the JSON and its hash alone.
    text = F.concat(F.col("id"), F.repeat(F.lit('one "line" of words\n'), F.lit(50_000)))

    def timed(json_text):
        digest = lambda n: spark.range(n).select(F.sha2(json_text, 256)).collect()
        digest(1)
        start = time.monotonic()
        return digest(32), time.monotonic() - start

    found, took = timed(ident.json_string(text))
    assert found[1][0] == sha(canon("1" + 'one "line" of words\n' * 50_000))
    assert took < 6 * timed(F.to_json(F.struct(text)))[1]


def test_canonical_json_of_nested_values(spark):
    row = {
        "z": "t\n", "n": None, "i": 7, "b": True, "money": Decimal("0.005000"), "d": 5.0,
        "l": ["x", None], "s": {"q": 1, "a": "é"}, "m": {"k2": "v", "k1": "w"},
    }
    df = spark.createDataFrame(
        [("t\n", None, 7, True, Decimal("0.005"), 5.0, ["x", None], (1, "é"), {"k2": "v", "k1": "w"})],
        "z string, n string, i int, b boolean, money decimal(18,6), d double, l array<string>, s struct<q:int,a:string>, m map<string,string>",
    )
    found = df.select(ident.canonical_json(df, df.columns)).head()[0]
    assert found == canon({**row, "money": "0.005"})


def test_ids_equal_a_direct_hash(spark):
    df = spark.createDataFrame([("intent-1", 2)], "i string, n int")
    row = df.select(
        ident.attempt_id(F.col("i"), F.col("n")).alias("a"),
        ident.dispatch_pair_id(F.lit("r"), F.lit("v"), F.lit("m")).alias("p"),
        ident.dispatch_refused_event_id(F.col("i"), F.lit("why")).alias("x"),
    ).head()
    assert row.a == "attempt_sha256:" + sha(canon({"dispatch_intent_id": "intent-1", "attempt_number": 2}))
    assert row.p == "dispatch_pair_sha256:" + sha(
        canon({"run_manifest_id": "r", "page_input_variant_id": "v", "roster_member_config_id": "m"})
    )
    assert row.x == "dispatch_refused_event_sha256:" + sha(canon({"dispatch_intent_id": "intent-1", "reason": "why"}))


def pages(spark, **changes):
    base = {
        "source_page_id": None, "schema_version": "v2", "dataset_id": "d", "dataset_version": "1", "dataset_item_id": "a/b.png",
        "source_uri": "file:/a", "source_sha256": "0" * 64, "media_type": "image/png", "byte_size": 10, "width_px": 1,
        "height_px": 2, "color_mode": "RGB", "bit_depth": None, "orientation_metadata": None, "source_genre": None, "license_id": None,
    }
    base.update(changes)
    return spark.createDataFrame([tuple(base.values())], RECORD_TYPES["source_page"].schema)


def test_location_changes_the_record_hash_but_not_the_id(spark):
    one, two = pages(spark), pages(spark, source_uri="file:/elsewhere")
    ids = [ident.seal(p, "source_page").head().source_page_id for p in (one, two)]
    assert ids[0] == ids[1]
    hashes = [s.select(ident.record_sha256(s)).head()[0] for s in (ident.seal(one, "source_page"), ident.seal(two, "source_page"))]
    assert hashes[0] != hashes[1]
    assert ident.seal(pages(spark, dataset_version="2"), "source_page").head().source_page_id != ids[0]


def test_every_record_type_declares_its_identity(spark):
    counts = {name: (len(r.schema.names), len(r.identity_columns)) for name, r in RECORD_TYPES.items()}
    assert counts["source_page"] == (16, 5)
    assert counts["evaluation_unit"] == (9, 5)
    assert counts["decode_provenance"] == (9, 8)
    assert counts["page_input_variant"] == (16, 13)
    assert counts["roster_member_config"] == (12, 11)
    assert counts["run_manifest"] == (28, 26)
    assert counts["dispatch_intent"] == (8, 6)
    assert counts["ground_truth_assertion"] == (10, 8)
    assert counts["ground_truth_event"] == (11, 9)
    assert counts["effective_gt_snapshot"] == (7, 6)
    assert counts["page_model_result"] == (16, 14)
    assert counts["consensus_result"] == (12, 9)
    assert counts["fused_hypothesis"] == (9, 6)
    assert counts["benchmark_observation"] == (49, 47)
    assert counts["baseline_transcription"] == (7, 6)
    assert counts["detector_evidence"] == (11, 9)
    assert counts["failure_assessment"] == (14, 12)
    assert counts["calibration_selection"] == (17, 16)
    assert counts["raw_provider_envelope"] == (4, 2)
    assert counts["approval_authorization"] == (9, 6)
    assert counts["dataset_split"] == (8, 7)
    spark.createDataFrame([], ATTEMPT_EVENTS)


def test_reimport_adds_nothing(spark):
    sealed = ident.seal(pages(spark), "source_page")
    assert ident.only_new(sealed.unionByName(sealed), sealed.limit(0), "source_page_id").count() == 1
    assert ident.only_new(sealed, sealed, "source_page_id").count() == 0


def test_value_rules(spark):
    df = spark.createDataFrame(
        [(("reported", 1.0), ("transcription", "x")), (("reported", None), ("transcription", None)),
         (("unknown", 2.0), ("parse_failure", "x")), (("unknown", None), ("parse_failure", None))],
        "f struct<availability:string,value:double>, p struct<kind:string,text:string>",
    )
    found = df.select(ident.field_value_violation(F.col("f")), ident.parsed_output_violation(F.col("p"))).collect()
    assert [tuple(r) for r in found] == [(False, False), (True, True), (True, True), (False, False)]


def test_numbers_round_by_their_binary_value(spark):
    # 0.0001220703125 is a true tie at 12 decimals; 3/40960 lies beside one; 0.00625 lies above one at four.
    values = [131072.2, 0.99999999999999, 1 / 8192, 3 / 8192, 3 / 40960, 0.00625, 0.03125, 0.1, 0.0, 5.0, 1 / 3]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for r in rows.select("v", ident.number_text(F.col("v")).alias("n"), ident.decimal_text(F.col("v"), "0.0000").alias("four")).collect():
        assert r.n == re.sub(r"(\.\d+?)0*$", r"\1", f"{r.v:.12f}")
        assert r.four == f"{r.v:.4f}"
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (-0.0,), (None,)], "v double")
    assert [r.n for r in odd.select(ident.number_text(F.col("v")).alias("n")).collect()] == [None, None, "0.0", None]
