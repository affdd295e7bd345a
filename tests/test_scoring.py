import math

from pyspark.sql import functions as F

from concordis.functions.text import hyperparameters_sha256
from concordis.operators import scoring
from concordis.operators.scoring import SCORES, compute_scores
from concordis.plans import fixtures


def scores(spark, rows):
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "evaluation_unit_id int, gt_availability string, gt_text string, hypothesis_text string"
    )
    return {r.evaluation_unit_id: r for r in compute_scores(df, ("evaluation_unit_id",)).collect()}


def test_blank_and_missing_references(spark):
    found = scores(spark, [
        ("available", "", ""), ("available", "", "xyz"), ("excluded_fully_illegible", None, "some text"), ("unavailable", None, "anything"),
        ("conflicted", None, None), ("available", "abc", None), ("available", "kitten", "sitting"), ("available", "a b  c", "a x b c d"),
        ("available", "é\r\nx", "é\nx"), ("available", "<ILLEGIBLE> a", "b a"), ("available", None, "x y"),
    ])
    assert (found[0].cer, found[0].wer, found[0].reference_length_chars) == (0.0, 0.0, 0)
    assert (found[1].cer, found[1].char_insertions, found[1].wer) == (3.0, 3, 1.0)
    for i in (2, 3, 4):
        assert all(found[i][c] is None for c in SCORES if c != "hypothesis_text_sha256")
    assert found[2].hypothesis_text_sha256 and found[3].hypothesis_text_sha256 and found[4].hypothesis_text_sha256 is None
    assert (found[5].cer, found[5].char_deletions, found[5].hypothesis_text_sha256) == (1.0, 3, None)
    assert (found[6].char_substitutions, found[6].char_insertions, found[6].char_deletions) == (2, 1, 0)
    assert math.isclose(found[6].cer, 3 / 6) and found[6].wer == 1.0
    assert (found[7].reference_length_words, found[7].word_insertions, found[7].word_substitutions) == (3, 2, 0)
    assert found[8].cer == 0.0 and found[8].reference_length_chars == 3
    assert (found[9].reference_length_chars, found[9].char_substitutions) == (3, 1)
    assert found[10].cer == 3.0 and found[10].wer == 2.0


def test_settings_digest_is_null_only_when_empty(spark):
    df = spark.createDataFrame([({},), ({"b": "1", "a": "it's"},)], "m map<string,string>")
    found = [r[0] for r in df.select(hyperparameters_sha256(F.col("m"))).collect()]
    assert found[0] is None and len(found[1]) == 64


def test_subjects_without_their_inputs_are_found(spark):
    results = spark.createDataFrame(
        [("r", "u1", "v", "m1", "a"), ("r", "u1", "v", "m2", "b"), ("r", "u2", "v", "m1", "c"), ("s", "u1", "v", "m1", "d")],
        "run_manifest_id string, evaluation_unit_id string, page_input_variant_id string, roster_member_config_id string, subject string",
    )
    context = spark.createDataFrame(
        [("r", "u1", "v", 1)], "run_manifest_id string, evaluation_unit_id string, page_input_variant_id string, other int"
    )
    roster = spark.createDataFrame([("m1",), ("m1",)], "roster_member_config_id string")
    found = {(r.run_manifest_id, r.subject, r.code, r.severity) for r in scoring.dropped_subjects(results, context, roster).collect()}
    assert found == {
        ("r", "b", "observation_without_roster_member", "fail"), ("r", "c", "observation_without_context", "fail"),
        ("s", "d", "observation_without_context", "fail"),
    }
    assert {r.subject for r in scoring.dropped_subjects(results, context).collect()} == {"c", "d"}


def test_results_of_documents_move_no_text(spark, tmp_path):
    rows = [(1, "the one", "fr", "s", 7), (2, "two", "en", "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    results = fixtures.doc_results(spark, str(tmp_path))
    assert "Join" not in results._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.page_input_variant_id, r.position, r.terminal_outcome, r.parsed_text) for r in results.where("position > 0").collect()) == [
        ("variant-1", 1, "indeterminate", None), ("variant-1", 2, "success", "tlie one"), ("variant-2", 1, "success", "two"), ("variant-2", 2, "success", "two")
    ]
