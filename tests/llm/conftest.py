import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
#: Names that the operators use inside, as further columns of the input.
CLASHING = ("fp", "key", "body", "bucket", "page", "row_no", "size", "slot", "text_hash", "kept", "component_id", "range_no", "line", "site", "place", "words")


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text[, lang, source]) as a documents table with clashing extra columns."""

    def make(rows, clashing=True):
        full = [(r[0], r[1], *(list(r[2:]) + ["en", "s"][len(r) - 2 :]), None if r[1] is None else len(r[1])) for r in rows]
        schema, extra = DOCUMENTS, ()
        if clashing:
            schema = T.StructType([*DOCUMENTS.fields, *[T.StructField(c, T.StringType()) for c in CLASHING]])
            extra = ("x",) * len(CLASHING)
        return spark.createDataFrame([(*r, *extra) for r in full], schema)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty, blank, very long, tied and repeated texts; ids include null and a repeated one."""
    long = "lorem ipsum dolor sit amet. " * 20_000
    return [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a"), (2, "THE quick brown fox jumps over the lazy dog.", "en", "b"),
        (3, None, None, None), (4, "", "en", "a"), (5, " \t\n\x0b", "en", "a"), (6, long, "en", "b"), (7, long, "de", None),
        (8, "one", "en", "a"), (8, "one", "en", "a"), (9, "Été été Ärger \U0001f600", "fr", "c"), (None, "nameless", None, "c"), (10, "one", "en", "z"),
    ]
