"""Canonical JSON, content-hashed ids and record hashes as column expressions.

The JSON has sorted keys, no whitespace and no escapes beyond those JSON requires, so
an id of a record made of text, integers, booleans and nested values is stable across
engines.  Money enters as a string without trailing zeros.  Doubles enter rounded to
12 decimals, because sums in a cluster arrive in no fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordis.schemas import RECORD_TYPES

_PLAIN_TEXT = r"\A[^\x00-\x1F\"\\]*\z"
# Control characters whose escape has a hexadecimal letter: the writer must use lower case.
_LETTER_ESCAPES = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")
_LETTER_ESCAPED = r"[\x0B\x0E\x0F\x1A-\x1F]"


def json_string(value: Column) -> Column:
    """A JSON string literal; NULL gives NULL."""
    quoted = F.to_json(F.struct(value.alias("v")))
    escaped = F.rtrim(F.substring(quoted, 6, 2147483647), F.lit("}"))
    # Each of these walks the whole text, so only texts with such a character take them.
    lowered = escaped
    for code in _LETTER_ESCAPES:
        lowered = F.regexp_replace(
            lowered, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}"
        )
    return (
        F.when(value.rlike(_PLAIN_TEXT), F.concat(F.lit('"'), value, F.lit('"')))
        .when(value.rlike(_LETTER_ESCAPED), lowered)
        .when(value.isNotNull(), escaped)
    )


def money_text(value: Column) -> Column:
    """An exact decimal as text, without trailing zeros."""
    return F.regexp_replace(value.cast(T.DecimalType(28, 6)).cast("string"), r"\.?0+$", "")


def decimal_text(value: Column, pattern: str) -> Column:
    """A double in decimals by a pattern, rounded by its binary value; only a true tie goes to the even digit.

    Rounding the shortest decimal form instead takes 0.00625, which lies above that, for a tie.
    """
    size = F.when(F.abs(value) < F.lit(float("inf")), F.abs(value))
    shown = lambda number: F.call_function("format_number", number, F.lit(pattern))
    # The digits behind the point are those of the rest alone: the shortest form of the whole stops before them.
    whole = F.floor(size)
    rest = shown(size - whole)
    carried = F.concat((whole + F.when(F.startswith(rest, F.lit("1")), 1).otherwise(0)).cast("string"), F.substring(rest, 2, 99))
    text = F.concat(F.when(value < 0, "-").otherwise(""), F.when(size < 1e15, carried).otherwise(shown(size)))
    return F.regexp_replace(text, r"^-(0\.0*)$", "$1")


def number_text(value: Column) -> Column:
    """A double rounded to 12 decimals, with at least one decimal."""
    return decimal_text(value.cast("double"), "0.0" + "#" * 11)


def canonical_value(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        body = json_string(value)
    elif isinstance(data_type, T.DecimalType):
        body = F.concat(F.lit('"'), money_text(value), F.lit('"'))
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        body = number_text(value)
    elif isinstance(data_type, T.ArrayType):
        items = F.transform(value, lambda item: canonical_value(item, data_type.elementType))
        body = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    elif isinstance(data_type, T.MapType):
        entries = F.transform(
            F.array_sort(F.map_entries(value)),
            lambda e: F.concat(json_string(e["key"]), F.lit(":"), canonical_value(e["value"], data_type.valueType)),
        )
        body = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    elif isinstance(data_type, T.StructType):
        body = F.when(
            value.isNotNull(), canonical_object({f.name: (value[f.name], f.dataType) for f in data_type.fields})
        )
    elif isinstance(data_type, T.VariantType):
        body = F.to_json(value)
    else:
        body = value.cast("string")
    return F.coalesce(body, F.lit("null"))


def canonical_object(members: dict[str, tuple[Column, T.DataType]]) -> Column:
    pieces: list[Column] = []
    for name in sorted(members):
        column, data_type = members[name]
        lead = "{" if not pieces else ","
        pieces += [F.lit(f'{lead}"{name}":'), canonical_value(column, data_type)]
    return F.concat(*pieces, F.lit("}")) if pieces else F.lit("{}")


def canonical_json(df: DataFrame, columns) -> Column:
    """Canonical JSON of the named columns of ``df``."""
    return canonical_object({name: (F.col(name), df.schema[name].dataType) for name in columns})


def content_id(record_type: str, preimage: Column) -> Column:
    return F.concat(F.lit(f"{record_type}_sha256:"), F.sha2(preimage, 256))


def semantic_id(df: DataFrame, record_type: str) -> Column:
    return content_id(record_type, canonical_json(df, RECORD_TYPES[record_type].identity_columns))


def record_sha256(df: DataFrame, columns=None) -> Column:
    """Hash of the whole record: every column but the hash itself."""
    names = [name for name in (columns or df.columns) if name != "record_sha256"]
    return F.sha2(canonical_json(df, names), 256)


def seal(df: DataFrame, record_type: str) -> DataFrame:
    """Set the record's id column to its semantic id and order the declared columns."""
    record = RECORD_TYPES[record_type]
    sealed = df.withColumn(record.id_column, semantic_id(df, record_type))
    declared = record.schema.names
    return sealed.select(*declared, *[c for c in sealed.columns if c not in declared])


def _id_of(record_type: str, **members) -> Column:
    return content_id(record_type, canonical_object(members))


_TEXT, _INT = T.StringType(), T.IntegerType()


def dispatch_pair_id(run_manifest_id: Column, page_input_variant_id: Column, roster_member_config_id: Column) -> Column:
    return _id_of(
        "dispatch_pair",
        run_manifest_id=(run_manifest_id, _TEXT),
        page_input_variant_id=(page_input_variant_id, _TEXT),
        roster_member_config_id=(roster_member_config_id, _TEXT),
    )


def attempt_id(dispatch_intent_id: Column, attempt_number: Column) -> Column:
    return _id_of(
        "attempt", dispatch_intent_id=(dispatch_intent_id, _TEXT), attempt_number=(attempt_number, _INT)
    )


def attempt_event_id(attempt: Column, event_type: Column, payload: dict[str, tuple[Column, T.DataType]]) -> Column:
    """Id of one attempt event; ``payload`` holds its columns without timestamps."""
    preimage = F.concat(
        F.lit('{"attempt_id":'), json_string(attempt), F.lit(',"event_type":'), json_string(event_type),
        F.lit(',"payload":'), canonical_object(payload), F.lit("}"),
    )
    return content_id("attempt_event", preimage)


def dispatch_refused_event_id(dispatch_intent_id: Column, reason: Column) -> Column:
    return _id_of(
        "dispatch_refused_event", dispatch_intent_id=(dispatch_intent_id, _TEXT), reason=(reason, _TEXT)
    )


def only_new(candidates: DataFrame, stored: DataFrame, id_column: str) -> DataFrame:
    """Rows of a repeated import that the store does not hold yet, one per id."""
    return candidates.dropDuplicates([id_column]).join(stored.select(id_column), id_column, "left_anti")


def field_value_violation(value: Column) -> Column:
    """True where an availability-tagged value breaks: present exactly when reported."""
    return ~((value["availability"].eqNullSafe(F.lit("reported"))) == value["value"].isNotNull())


def parsed_output_violation(parsed: Column) -> Column:
    """True where a parsed output breaks: text present exactly for a transcription."""
    return ~((parsed["kind"].eqNullSafe(F.lit("transcription"))) == parsed["text"].isNotNull())
