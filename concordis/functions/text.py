"""Text policy, tokens and digests as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marker for unreadable text, and the 29 code points that part words.
ILLEGIBLE_MARKER = "<ILLEGIBLE>"
WORD_SEPARATORS = (
    r"[\x{09}\x{0A}\x{0B}\x{0C}\x{0D}\x{1C}\x{1D}\x{1E}\x{1F}\x{20}\x{85}\x{A0}\x{1680}"
    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
# No code point below U+0300 changes under NFC on its own.
_MAY_COMPOSE = r"[^\x{0}-\x{2FF}]"


@F.arrow_udf(T.StringType())
def _compose(texts: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string()
    )


def normalize_text(text: Column) -> Column:
    """Line ends to LF, then NFC.  Only text that NFC could change visits Python."""
    lines = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    composed = _compose(F.when(lines.rlike(_MAY_COMPOSE), lines))
    return F.coalesce(composed, lines)


def char_tokens(text: Column) -> Column:
    """One token per code point; the unreadable-text marker is one token."""
    return F.regexp_extract_all(text, F.lit(f"(?s){ILLEGIBLE_MARKER}|."), F.lit(0))


def char_count(text: Column) -> Column:
    """``size(char_tokens(text))`` without building the tokens."""
    marker_chars = F.length(text) - F.length(F.replace(text, F.lit(ILLEGIBLE_MARKER), F.lit("")))
    size = len(ILLEGIBLE_MARKER)
    return F.length(text) - (marker_chars / size).cast("int") * (size - 1)


def word_tokens(text: Column) -> Column:
    return F.filter(F.split(text, WORD_SEPARATORS), lambda word: word != "")


def text_sha256(text: Column) -> Column:
    """Digest of text already under the text policy; NULL gives NULL."""
    return F.sha2(text, 256)


def hyperparameters_sha256(settings: Column) -> Column:
    """Digest of sorted settings as a list of pairs in single quotes; NULL when empty."""
    quoted = lambda s: F.concat(F.lit("'"), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    pairs = F.transform(
        F.array_sort(F.map_entries(settings)),
        lambda e: F.concat(F.lit("("), quoted(e["key"]), F.lit(", "), quoted(e["value"]), F.lit(")")),
    )
    return F.when(
        F.size(settings) > 0, F.sha2(F.concat(F.lit("["), F.array_join(pairs, ", "), F.lit("]")), 256)
    )


def error_rate(edits: Column, reference_length: Column, hypothesis_length: Column) -> Column:
    """Edits per reference token; a blank reference counts the hypothesis tokens instead."""
    return F.when(reference_length == 0, hypothesis_length.cast("double")).otherwise(
        edits.cast("double") / reference_length
    )


DEFAULT_BANDS = (0.10, 0.30)


def confidence_band(entropy: Column, bands: tuple[float, float] = DEFAULT_BANDS) -> Column:
    low, high = bands
    if not (0.0 <= low <= 1.0 and 0.0 <= high <= 1.0):
        raise ValueError(f"band limits must lie in [0, 1], got {bands!r}")
    if low >= high:
        raise ValueError(f"the lower band limit must be below the upper one, got {bands!r}")
    return (
        F.when(entropy <= low, "high_confidence")
        .when(entropy >= high, "low_confidence")
        .when(entropy.isNotNull(), "medium_confidence")
    )


def maximum_exposure(input_units: Column, input_price: Column, output_units: Column, output_price: Column, fixed: Column) -> Column:
    """Upper bound of one call's cost; all terms exact decimals."""
    units = T.DecimalType(18, 0)
    return (
        input_units.cast(units) * input_price + output_units.cast(units) * output_price + fixed
    ).cast(T.DecimalType(18, 6))
