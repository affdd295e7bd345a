import pytest
from pyspark.sql import functions as F

from concordis.functions import text as txt
from concordis.functions.edits import edit_counts, edit_distance, text_edit_counts
from concordis.operators import scoring

SEPARATORS = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
    0x202F, 0x205F, 0x3000,
]


def one(spark, value, *exprs):
    row = spark.createDataFrame([(value,)], "t string").select(*exprs).head()
    return row[0] if len(exprs) == 1 else tuple(row)


@pytest.mark.parametrize(
    "raw,expected",
    [("a\r\nb\rc", "a\nb\nc"), ("éx", "éx"), ("éx", "éx"), ("Cat, Dog.", "Cat, Dog."), ("가", "가"), ("", ""), (None, None)],
)
def test_text_policy(spark, raw, expected):
    assert one(spark, raw, txt.normalize_text(F.col("t"))) == expected


def test_char_tokens(spark):
    text = "a<ILLEGIBLE><ILLEGIBLE>b<ILLEGIBL>\n\U0001f600"
    tokens, count = one(spark, text, txt.char_tokens(F.col("t")), txt.char_count(F.col("t")))
    assert tokens == ["a", "<ILLEGIBLE>", "<ILLEGIBLE>", "b", *"<ILLEGIBL>", "\n", "\U0001f600"]
    assert count == len(tokens)
    assert one(spark, "", txt.char_tokens(F.col("t"))) == []


def test_every_word_separator(spark):
    assert len(SEPARATORS) == 29
    for chunk in (SEPARATORS[:15], SEPARATORS[15:]):
        text = "w".join(chr(c) for c in chunk)
        assert one(spark, f" {text} ", txt.word_tokens(F.col("t"))) == ["w"] * (len(chunk) - 1)
    assert one(spark, "  \n ", txt.word_tokens(F.col("t"))) == []
    assert one(spark, "a​b", txt.word_tokens(F.col("t"))) == ["a​b"]


def test_bands(spark):
    df = spark.createDataFrame([(0.2,), (0.6,), (0.4,), (None,)], "ce double")
    found = [r[0] for r in df.select(txt.confidence_band(F.col("ce"), (0.2, 0.6))).collect()]
    assert found == ["high_confidence", "low_confidence", "medium_confidence", None]
    for bad in ((0.6, 0.6), (0.7, 0.6), (-0.1, 0.6), (0.2, 1.1)):
        with pytest.raises(ValueError):
            txt.confidence_band(F.col("ce"), bad)


def test_exposure(spark):
    d = lambda v: F.lit(v).cast("decimal(18,6)")
    total = txt.maximum_exposure(F.lit(1000), d("0.0001"), F.lit(500), d("0.0002"), d("0.01"))
    assert str(one(spark, "x", total)) == "0.210000"


def test_edit_functions(spark):
    rows = [("kitten", "sitting", 3, (2, 1, 0)), ("ab", "ba", 2, (2, 0, 0)), ("", "xyz", 3, (0, 3, 0)), ("", "", 0, (0, 0, 0)),
            ("x", "", 1, (0, 0, 1)), ("the <ILLEGIBLE> cat", "the x cat", 1, (1, 0, 0))]
    df = spark.createDataFrame([(a, b) for a, b, _, _ in rows], "a string, b string").coalesce(1)
    found = df.select(edit_distance("a", "b").alias("d"), edit_counts("a", "b").alias("c")).collect()
    for (_, _, distance, counts), r in zip(rows, found):
        assert r.d == distance and tuple(r.c)[:3] == counts


def test_words_of_texts_are_counted_as_lists_of_words_are(spark):
    rows = [
        ("one two three", "one three  three four"), ("a b　c\x1cd\x85e", "a b x d"), ("<ILLEGIBLE> by the sea", "at the <ILLEGIBLE>"),
        ("", " \t"), ("same", "same"), (None, "x"), ("x", None), ("z​y", "z y"), (" ", "w\x0b"),
    ]
    df = spark.createDataFrame(rows, "a string, b string")
    found = df.select(
        text_edit_counts("a", "b").alias("both"), edit_counts("a", "b").alias("chars"), edit_counts(txt.word_tokens(F.col("a")), txt.word_tokens(F.col("b"))).alias("words")
    ).collect()
    assert [(r.both.chars, r.both.words) for r in found] == [(r.chars, r.words) for r in found]
    assert found[5].words is None and found[0].words.substitutions == 1


def test_words_part_where_python_parts_them():
    assert all(("a" + chr(c) + "b").split() == ["a", "b"] for c in SEPARATORS)
    assert sum(not chr(c).split() for c in range(0x110000)) == len(SEPARATORS)


def test_scores_send_no_list_of_words_to_python(spark):
    pairs = spark.createDataFrame([("u", "s", "available", "one two", "one too")], "u string, s string, gt_availability string, gt_text string, hypothesis_text string")
    plan = scoring.compute_scores(pairs, ("u", "s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text_edit_counts(") == 1 and " edit_counts(" not in plan
