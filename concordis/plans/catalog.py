"""Registered queries, one per operator, with the equivalent SQL where it exists."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordis.functions import identity as ident
from concordis.functions import text as txt
from concordis.functions.edits import edit_counts, edit_distance
from concordis.operators import alignment as al
from concordis.operators import artifacts, budget, ground_truth, integrity, journal, manifest, report, result_store, scoring
from concordis.plans import evaluation
from concordis.plans import fixtures as fx
from concordis.plans import sql
from concordis.session import spread, work_folder
from concordis.sources import corpus, stores
from concordis.streaming import journal_follow

QUERIES: dict[str, Callable[..., DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def money(column: str):
    return ident.money_text(F.col(column))


def sql_money(value: str) -> str:
    return f"regexp_replace(({value})::DECIMAL(28,6)::VARCHAR, '\\.?0+$', '')"


UNIT = ("run_manifest_id", "evaluation_unit_id")

# -- sources and sinks ---------------------------------------------------------------


@query("s1_jsonl_scan", "SELECT conv_id, turn, role, text FROM conversations")
def s1(spark, sf):
    rows = fx.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    path = work_folder(spark, "jsonl")
    stores.write_jsonl(rows, path)
    absent = stores.read_jsonl(spark, path + "-absent", rows.schema)
    return stores.read_jsonl(spark, path, rows.schema).unionByName(absent)


@query(
    "s2_store_write",
    sql.with_(sql.JOURNAL) + f"SELECT intent AS dispatch_intent_id, number AS attempt_number, attempt_id, {sql_money('cost')} AS cost_usd FROM att",
)
def s2(spark, sf):
    rows = journal.attempts(fx.journal_events(spark, sf)).select(
        "dispatch_intent_id", "attempt_number", "attempt_id", "cost_usd", F.lit("run-journal").alias("run_manifest_id")
    )
    path = work_folder(spark, "store")
    stores.write_table(rows, path, violation=F.col("attempt_number") < 1)
    back = stores.read_table(spark, path, rows.schema)
    return back.select("dispatch_intent_id", "attempt_number", "attempt_id", money("cost_usd").alias("cost_usd"))


@query(
    "s3_single_documents",
    sql.with_(sql.STORED) + "SELECT DISTINCT t.run_manifest_id, m.run_manifest_id IS NOT NULL AS present "
    "FROM turns t LEFT JOIN man m USING (run_manifest_id)",
)
def s3(spark, sf):
    manifests = fx.stored_manifests(spark, sf).withColumn("schema_version", F.lit("v2"))
    return stores.documents(fx.turns(spark, sf), manifests).select(
        "run_manifest_id", F.col("document").isNotNull().alias("present")
    )


@query(
    "s4_journal_append",
    sql.with_(sql.JOURNAL) + "SELECT seq AS journal_seq, attempt_id FROM starts UNION ALL SELECT seq, attempt_id FROM finishes",
)
def s4(spark, sf):
    events = fx.journal_events(spark, sf).select("journal_seq", "event_type", "attempt_id")
    path = work_folder(spark, "journal")
    for kind in ("attempt_started", "attempt_finished"):
        stores.append_journal(events.where(F.col("event_type") == kind), path)
    return stores.read_table(spark, path, events.schema).select("journal_seq", "attempt_id")


_SUFFIXES = (".png", ".JPG", ".Tiff", ".txt", "")


@query(
    "s5_corpus_scan",
    "SELECT regexp_replace(url, '^https?://', '') || '-' || page_id || ['.png', '.JPG', '.Tiff'][(page_id % 5 + 1)::INT] AS dataset_item_id, length(html)::BIGINT AS length "
    "FROM pages WHERE page_id % 5 < 3 AND page_id % 2 = 0",
)
def s5(spark, sf):
    """Listed paths of all pages, of which three suffixes in five are accepted and every second item is asked for."""
    pages = fx.table(spark, sf, "pages")
    suffix = F.get(F.array(*[F.lit(x) for x in _SUFFIXES]), F.pmod("page_id", F.lit(5)).cast("int"))
    item = F.concat(F.regexp_replace("url", "^https?://", ""), F.lit("-"), F.col("page_id").cast("string"), suffix)
    listed = pages.select(F.concat(F.lit("file:///corpus/in/"), item).alias("path"), F.length("html").cast("long").alias("length"))
    wanted = pages.where(F.pmod("page_id", F.lit(2)) == 0).select(item.alias("dataset_item_id"))
    return corpus.accepted(listed, "file:/corpus/in", only=wanted).select("dataset_item_id", "length")


_FILES = (
    "files AS (SELECT page_id, CASE WHEN contains(url, 'blog.') THEN 'D-NEWS-AD' WHEN contains(url, '//m.') THEN 'D-GEO' ELSE 'misc' END "
    "|| '/' || regexp_replace(url, '^https?://', '') || '.png' AS dataset_item_id, "
    "unhex('89504E470D0A1A0A0000000D49484452' || lpad(to_hex(page_id + 100), 8, '0') || lpad(to_hex(length(html)), 8, '0') || '0802000000') "
    "|| encode(html) AS content, length(html) AS n FROM pages)"
)


@query(
    "s6_file_digest",
    sql.with_(_FILES) + "SELECT dataset_item_id, sha256(content) AS source_sha256, octet_length(content)::BIGINT AS byte_size FROM files",
)
def s6(spark, sf):
    return fx.corpus_files(spark, sf).select(
        "dataset_item_id", corpus.file_digest(F.col("content")).alias("source_sha256"), F.col("length").alias("byte_size")
    )


@query(
    "s7_seed_family",
    sql.with_(_FILES) + "SELECT dataset_item_id, CASE WHEN split_part(dataset_item_id, '/', 1) IN ('D-GEO', 'D-NEWS-AD') "
    "THEN split_part(dataset_item_id, '/', 1) END AS seed_family FROM files",
)
def s7(spark, sf):
    return fx.corpus_files(spark, sf).select(
        "dataset_item_id", corpus.seed_family(F.col("dataset_item_id")).alias("seed_family")
    )


@query(
    "s8_item_id_rejects",
    sql.with_(_FILES) + "SELECT dataset_item_id FROM files WHERE regexp_matches(dataset_item_id, '[^A-Za-z0-9._/-]')",
)
def s8(spark, sf):
    return corpus.split_unsafe(fx.corpus_files(spark, sf))[1].select("dataset_item_id")


_VARIED = sql.with_(sql.DOCS, sql.varied("docs", "doc_id % 4"), sql.artifact_ctes())


@query(
    "s9_alignment_artifact",
    _VARIED + "SELECT run_manifest_id, evaluation_unit_id, column_count, departure_count, alignment_artifact_sha256 FROM art",
)
def s9(spark, sf):
    made = artifacts.build(al.align(fx.varied_documents(spark, sf)))
    return made.headers.select(*UNIT, "column_count", "departure_count", "alignment_artifact_sha256")


# -- identity ------------------------------------------------------------------------

_ASSERTION_JSON = sql.obj(
    author_actor_id=sql.js("'annotator-1'"), evaluation_unit_id=sql.js("evaluation_unit_id"), guideline_id=sql.js("guideline_id"),
    role=sql.js("'gold_full'"), source=sql.js("'human'"), source_artifact_sha256="'null'", target_state=sql.js("target_state"), text=sql.js("text"),
)


@query("i1_canonical_json", sql.with_(sql.GROUND_TRUTH) + f"SELECT assertion_id, {_ASSERTION_JSON} AS canonical FROM gt")
def i1(spark, sf):
    rows = fx.assertions(spark, sf)
    columns = ident.RECORD_TYPES["ground_truth_assertion"].identity_columns
    return rows.select("assertion_id", ident.canonical_json(rows, columns).alias("canonical"))


@query(
    "i2_semantic_id",
    sql.with_(sql.GROUND_TRUTH) + f"SELECT assertion_id, {sql.cid('ground_truth_assertion', _ASSERTION_JSON)} AS semantic_id FROM gt",
)
def i2(spark, sf):
    rows = fx.assertions(spark, sf)
    return rows.select("assertion_id", ident.semantic_id(rows, "ground_truth_assertion").alias("semantic_id"))


_LEDGER_JSON = sql.obj(
    amount_usd=sql.jmoney("amt"), kind=sql.js("kind"), ledger=sql.js("ledger"), reservation_id=sql.js("rid"), seq=sql.jn("seq")
)


@query("i3_record_hash", sql.with_(sql.LEDGER) + f"SELECT seq, ledger, sha256({_LEDGER_JSON}) AS record_sha256 FROM ev")
def i3(spark, sf):
    rows = fx.ledger_events(spark, sf)
    return rows.select("seq", "ledger", ident.record_sha256(rows).alias("record_sha256"))


@query(
    "i4_seal",
    sql.with_(sql.GROUND_TRUTH) + f"SELECT {sql.cid('ground_truth_assertion', _ASSERTION_JSON)} AS assertion_id, evaluation_unit_id, guideline_id FROM gt",
)
def i4(spark, sf):
    return ident.seal(fx.assertions(spark, sf), "ground_truth_assertion").select("assertion_id", "evaluation_unit_id", "guideline_id")


def _member_json(position: str, hyper: str) -> str:
    return sql.obj(
        adapter_id=sql.js("'adapter'"), adapter_version=sql.js("'1.0.0'"), billing_account_id=sql.js("'account-1'"),
        exact_model_id=sql.js(f"'reader-' || {position}"), hyperparameters=hyper, position=sql.jn(position),
        prompt_sha256=sql.js("repeat('1', 64)"), prompt_template_id=sql.js("'prompt-1'"), provider=sql.js("'stub'"),
        registry_entry_id=sql.js(f"'registry-' || {position}"), router="'null'",
    )


_SETTINGS = "'{\"mode\":\"exact\",\"top_p\":\"0.9\"}'"
_ROSTER_JSON = " || ',' || ".join(_member_json(str(p), _SETTINGS if p == 1 else "'{}'") for p in range(3))
_FIXED = {
    "schema_version": "v2", "dataset_id": "documents", "dataset_version": "v1", "corpus_evidence_kind": "natural",
    "dataset_split_id": "split-1", "split_role": "diagnostic", "config_snapshot_sha256": "2" * 64, "taxonomy_registry_id": "taxonomy_v1",
    "assessment_policy_id": "assessment_v1", "alignment_policy_id": "alignment_v1", "eligibility_policy_id": "eligibility_v1",
    "fusion_policy_id": "fusion_v1", "metric_policy_id": "metric_v1", "anomaly_policy_id": "anomaly_v1", "analysis_policy_id": "analysis_v1",
    "contamination_register_id": "contamination_v1", "pricing_registry_snapshot_id": "pricing_v1", "model_registry_snapshot_id": "models_v1",
}
_MANIFEST_JSON = sql.obj(
    **{k: sql.js(f"'{v}'") for k, v in _FIXED.items()},
    calibration_selection_id="'null'", model_corpus_match="'false'", model_corpus_match_policy_id="'null'", human_override_ids="'[]'",
    budget_policy="'{\"run_ceiling_usd\":\"1.00\"}'", roster=f"'[' || {_ROSTER_JSON} || ']'",
    evaluation_unit_ids="'[\"' || ud || '\"]'", page_input_variant_ids="'[\"' || vd || '\"]'",
)
_MANIFEST_SQL = sql.with_(sql.DOCS) + (
    f"SELECT run_key, {sql.cid('run_manifest', _MANIFEST_JSON)} AS run_manifest_id FROM (SELECT run_manifest_id AS run_key, "
    f"{sql.set_digest('evaluation_unit_id')} AS ud, {sql.set_digest(chr(39) + 'variant-' + chr(39) + ' || doc_id')} AS vd FROM docs GROUP BY 1)"
)


def _manifests(spark, sf):
    roster = fx.roster(spark, sf).withColumnRenamed("run_manifest_id", "run_key")
    units = fx.doc_variants(spark, sf).withColumnRenamed("run_manifest_id", "run_key")
    settings = units.select("run_key").distinct().withColumns(
        {
            **{k: F.lit(v) for k, v in _FIXED.items()},
            "created_at": F.lit(fx.CREATED_AT),
            "calibration_selection_id": F.lit(None).cast("string"),
            "budget_policy": F.create_map(F.lit("run_ceiling_usd"), F.lit("1.00")),
            "model_corpus_match": F.lit(False),
            "model_corpus_match_policy_id": F.lit(None).cast("string"),
            "human_override_ids": F.array().cast("array<string>"),
        }
    )
    return manifest.run_manifests(settings, units, roster)


@query("i5_nested_identity", _MANIFEST_SQL)
def i5(spark, sf):
    return _manifests(spark, sf).select("run_key", "run_manifest_id")


_FINISHED_ID = sql.cid(
    "attempt_event",
    f"'{{\"attempt_id\":' || {sql.js('attempt_id')} || ',\"event_type\":\"attempt_finished\",\"payload\":' || {sql.obj(outcome=sql.js('outcome'))} || '}}'",
)
_PAIR_ID = sql.cid(
    "dispatch_pair",
    sql.obj(page_input_variant_id=sql.js("'variant-' || intent"), roster_member_config_id=sql.js("'member-0'"), run_manifest_id=sql.js("'run-journal'")),
)


@query(
    "i6_event_ids",
    sql.with_(sql.JOURNAL) + f"SELECT attempt_id AS subject, {_FINISHED_ID} AS id FROM finishes UNION ALL "
    f"SELECT intent, {_PAIR_ID} FROM intents UNION ALL SELECT intent, "
    + sql.cid("dispatch_refused_event", sql.obj(dispatch_intent_id=sql.js("intent"), reason=sql.js("'no headroom'")))
    + " FROM idle WHERE role = 'system'",
)
def i6(spark, sf):
    events = fx.journal_events(spark, sf)
    kind = F.col("event_type")
    finished = events.where(kind == "attempt_finished").select(
        F.col("attempt_id").alias("subject"),
        ident.attempt_event_id(F.col("attempt_id"), kind, {"outcome": (F.col("outcome"), T.StringType())}).alias("id"),
    )
    pairs = fx.journal_intents(spark, sf).select(
        F.col("dispatch_intent_id").alias("subject"),
        ident.dispatch_pair_id(
            F.lit("run-journal"), F.concat(F.lit("variant-"), "dispatch_intent_id"), F.lit("member-0")
        ).alias("id"),
    )
    refused = events.where(kind == "dispatch_refused").select(
        F.col("dispatch_intent_id").alias("subject"),
        ident.dispatch_refused_event_id(F.col("dispatch_intent_id"), F.col("reason")).alias("id"),
    )
    return finished.unionByName(pairs).unionByName(refused)


@query(
    "i7_reimport",
    sql.with_(sql.GROUND_TRUTH, f"sealed AS (SELECT {sql.cid('ground_truth_assertion', _ASSERTION_JSON)} AS assertion_id, evaluation_unit_id, version FROM gt)")
    + "SELECT DISTINCT assertion_id, evaluation_unit_id FROM sealed WHERE assertion_id NOT IN (SELECT assertion_id FROM sealed WHERE version = 'a')",
)
def i7(spark, sf):
    # Everything arrives twice and the first versions are stored already, so a second
    # version of the same content is not new either.
    rows = fx.assertions(spark, sf)
    # Three readers: a table of the ids, so that the texts are hashed once.
    sealed = stores.stored(ident.seal(rows, "ground_truth_assertion").select("assertion_id", "evaluation_unit_id", "version"))
    stored = sealed.where(F.col("version") == "a")
    return ident.only_new(sealed.unionByName(sealed), stored, "assertion_id").select("assertion_id", "evaluation_unit_id")


@query(
    "k1_field_value_rule",
    "SELECT event_id, (event_type = 'error') <> (value >= 10) AS violated FROM events",
)
def k1(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        "event_id",
        F.struct(
            F.when(F.col("event_type") == "error", "reported").otherwise("unknown").alias("availability"),
            F.when(F.col("value") >= 10, F.col("value")).alias("value"),
        ).alias("field"),
    )
    return rows.select("event_id", ident.field_value_violation(F.col("field")).alias("violated"))


@query(
    "k2_parsed_output_rule",
    "SELECT conv_id, turn, (role = 'user') <> (length(text) >= 300) AS violated FROM conversations",
)
def k2(spark, sf):
    parsed = F.struct(
        F.when(F.col("role") == "user", "transcription").otherwise("parse_failure").alias("kind"),
        F.when(F.length("text") >= 300, F.col("text")).alias("text"),
    )
    rows = fx.table(spark, sf, "conversations").select("conv_id", "turn", parsed.alias("parsed"))
    return rows.select("conv_id", "turn", ident.parsed_output_violation(F.col("parsed")).alias("violated"))


# -- scalar text ---------------------------------------------------------------------

# Line ends become CR pairs and accents are split off, so the text policy has work to do.
_ROUGH_SQL = "replace(replace(text, 'é', 'e' || chr(769)), chr(10), chr(13) || chr(10))"


def _rough():
    split = F.replace("text", F.lit("é"), F.lit("é"))
    return F.replace(split, F.lit("\n"), F.lit("\r\n"))


@query(
    "t1_text_policy",
    f"SELECT doc_id, nfc_normalize(replace(replace({_ROUGH_SQL}, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text FROM documents",
)
def t1(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", txt.normalize_text(_rough()).alias("text"))


@query(
    "t2_char_tokens",
    "SELECT doc_id, len(t)::INT AS tokens, md5(array_to_string(t, '|')) AS digest, len(list_filter(t, lambda x: length(x) > 1))::INT AS markers "
    "FROM (SELECT doc_id, regexp_extract_all(replace(text, 'th', '<ILLEGIBLE>'), '(?s)<ILLEGIBLE>|.') AS t FROM documents)",
)
def t2(spark, sf):
    tokens = txt.char_tokens(fx.replaced("text", "th", "<ILLEGIBLE>"))
    return fx.table(spark, sf, "documents").select("doc_id", tokens.alias("t")).select(
        "doc_id", F.size("t").alias("tokens"), F.md5(F.array_join("t", "|")).alias("digest"),
        F.size(F.filter("t", lambda x: F.length(x) > 1)).alias("markers"),
    )


@query(
    "t3_word_tokens",
    f"SELECT doc_id, len(w)::INT AS words, md5(array_to_string(w, '|')) AS digest FROM (SELECT doc_id, {sql.words('text')} AS w FROM documents)",
)
def t3(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", txt.word_tokens(F.col("text")).alias("w")).select(
        "doc_id", F.size("w").alias("words"), F.md5(F.array_join("w", "|")).alias("digest")
    )


@query("t4_text_digest", "SELECT doc_id, sha256(nfc_normalize(text)) AS text_sha256 FROM documents")
def t4(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", txt.text_sha256(txt.normalize_text(F.col("text"))).alias("text_sha256")
    )


@query(
    "t5_settings_digest",
    "SELECT event_id, CASE WHEN event_type <> 'view' THEN sha256('[(''k'', ''' || json_extract_string(props, '$.k') || '''), (''kind'', ''' || event_type || ''')]') END AS digest FROM events",
)
def t5(spark, sf):
    settings = F.when(
        F.col("event_type") != "view",
        F.create_map(F.lit("kind"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k")),
    ).otherwise(F.create_map().cast("map<string,string>"))
    return fx.table(spark, sf, "events").select("event_id", txt.hyperparameters_sha256(settings).alias("digest"))


@query(
    "t6_confidence_band",
    "SELECT event_id, CASE WHEN value / 100 <= 0.1 THEN 'high_confidence' WHEN value / 100 >= 0.3 THEN 'low_confidence' ELSE 'medium_confidence' END AS band FROM events",
)
def t6(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", txt.confidence_band(F.col("value") / 100).alias("band"))


_PRICE = "l_extendedprice::DECIMAL(18,2)"


@query(
    "t7_maximum_exposure",
    f"SELECT l_orderkey, l_linenumber, {sql_money(f'l_quantity::DECIMAL(18,0) * {_PRICE} + l_linenumber::DECIMAL(18,0) * l_tax::DECIMAL(18,2) + l_discount::DECIMAL(18,2)')} AS exposure_usd FROM lineitem",
)
def t7(spark, sf):
    d = lambda c: F.col(c).cast("decimal(18,2)")
    exposure = txt.maximum_exposure(F.col("l_quantity"), d("l_extendedprice"), F.col("l_linenumber"), d("l_tax"), d("l_discount"))
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", ident.money_text(exposure).alias("exposure_usd")
    )


# -- edit distance, alignment, consensus, fusion -------------------------------------

_TURN_HYPS = sql.with_(sql.TURNS, sql.misread("turns"))


@query(
    "e1_edit_distance",
    _TURN_HYPS + f"SELECT h.run_manifest_id, h.evaluation_unit_id, h.position, levenshtein({sql.single_bytes('t.text')}, {sql.single_bytes('h.text')})::INT AS distance "
    "FROM hyps h JOIN turns t USING (evaluation_unit_id)",
)
def e1(spark, sf):
    units = fx.turns(spark, sf)
    pairs = fx.misread(units).join(units.select("evaluation_unit_id", F.col("text").alias("ref_text")), "evaluation_unit_id")
    return pairs.select(*UNIT, "position", edit_distance("ref_text", "text").alias("distance"))


@query(
    "e2_edit_counts",
    sql.with_(sql.DOCS, sql.misread("docs")) + (
        "SELECT h.run_manifest_id, h.evaluation_unit_id, h.position, CASE h.position WHEN 0 THEN th WHEN 2 THEN ou ELSE 0 END::INT AS substitutions, "
        "CASE h.position WHEN 0 THEN th ELSE 0 END::INT AS insertions, CASE h.position WHEN 1 THEN n_on ELSE 0 END::INT AS deletions FROM hyps h JOIN "
        "(SELECT evaluation_unit_id, (length(text) - length(replace(text, 'th', ''))) // 2 AS th, "
        f"(length(text) - length(replace(text, 'on', ''))) // 2 AS n_on, {sql.occurrences('text', 'ou')} AS ou FROM docs) d USING (evaluation_unit_id)"
    ),
)
def e2(spark, sf):
    units = fx.documents(spark, sf)
    pairs = spread(
        fx.misread(units).join(units.select("evaluation_unit_id", F.col("text").alias("ref_text")), "evaluation_unit_id"),
        "evaluation_unit_id", "position",
    )
    return pairs.withColumn("c", edit_counts("ref_text", "text")).select(
        *UNIT, "position", "c.substitutions", "c.insertions", "c.deletions"
    )


@query(
    "e3_error_rate",
    "SELECT conv_id, turn, CASE WHEN n = 0 THEN turn::DOUBLE ELSE round((turn * 2)::DOUBLE / n, 9) END AS rate FROM "
    "(SELECT conv_id, turn, CASE WHEN role = 'system' THEN 0 ELSE length(text) END AS n FROM conversations)",
)
def e3(spark, sf):
    length = F.when(F.col("role") == "system", 0).otherwise(F.length("text"))
    rate = txt.error_rate(F.col("turn") * 2, length, F.col("turn"))
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", F.round(rate, 9).alias("rate"))


@query(
    "e4_pair_alignment",
    sql.with_(sql.TURNS) + "SELECT run_manifest_id, evaluation_unit_id, other, md5(c) AS centre_digest, md5(o) AS other_digest FROM ("
    "SELECT *, replace(text, 'th', chr(1)) AS m FROM turns) x, LATERAL (SELECT 1 AS other, "
    "replace(m, chr(1), 't-h') AS c, replace(m, chr(1), 'tli') AS o) y",
)
def e4(spark, sf):
    # Two members: the text, and the text with every "th" read as "tli".
    units = fx.turns(spark, sf)
    a = al.align(fx._hypotheses(units, F.col("text"), fx.replaced("text", "th", "tli")))
    shown = lambda c: F.md5(F.array_join(F.transform(c, lambda s: F.coalesce(s, F.lit("-"))), ""))
    return al.pair_alignments(a).select(
        *UNIT, F.col("hyp_index").cast("int").alias("other"),
        shown("centre_symbols").alias("centre_digest"), shown("other_symbols").alias("other_digest"),
    )


_SINGLE = "mapped AS (SELECT run_manifest_id, evaluation_unit_id, position, " + sql.single_bytes("text") + " AS text FROM hyps)"
_DIST = (
    "dist AS (SELECT a.run_manifest_id, a.evaluation_unit_id, a.position AS i, b.position AS j, levenshtein(a.text, b.text)::BIGINT AS d "
    "FROM mapped a JOIN mapped b ON a.evaluation_unit_id = b.evaluation_unit_id AND a.position < b.position)"
)
_SUMS = (
    "sums AS (SELECT run_manifest_id, evaluation_unit_id, p, sum(d)::BIGINT AS s FROM (SELECT *, i AS p FROM dist UNION ALL SELECT *, j FROM dist) GROUP BY ALL)"
)


@query(
    "e5_pair_distances",
    sql.with_(sql.TURNS, sql.misread("turns"), _SINGLE, _DIST)
    + "SELECT run_manifest_id, evaluation_unit_id, sum(d)::BIGINT AS total, max(d)::BIGINT AS widest FROM dist GROUP BY ALL",
)
def e5(spark, sf):
    texts = al.distinct_texts(al.ranked_members(fx.misread(fx.turns(spark, sf))))
    # Texts that coincide have distance 0 and no pair, so units without pairs are added back.
    found = al.pair_distances(texts).groupBy(*UNIT).agg(
        F.sum(F.col("distance").cast("bigint") * F.col("left_copies") * F.col("right_copies")).alias("total"),
        F.max("distance").cast("bigint").alias("widest"),
    )
    zero = F.lit(0).cast("bigint")
    return fx.turns(spark, sf).select(*UNIT).join(found, list(UNIT), "left").select(
        *UNIT, F.coalesce("total", zero).alias("total"), F.coalesce("widest", zero).alias("widest")
    )


@query(
    "e6_centre",
    sql.with_(sql.TURNS, sql.misread("turns"), _SINGLE, _DIST, _SUMS)
    + "SELECT run_manifest_id, evaluation_unit_id, p::INT AS centre_index FROM sums QUALIFY row_number() OVER (PARTITION BY evaluation_unit_id ORDER BY s, p) = 1",
)
def e6(spark, sf):
    return al.align(fx.misread(fx.turns(spark, sf))).centres.select(*UNIT, F.col("centre_index").cast("int").alias("centre_index"))


@query(
    "e7_insertion_slots",
    sql.with_(sql.TURNS) + "SELECT run_manifest_id, evaluation_unit_id, (2 * k - 1 + list_sum(list_transform(p[1:k], lambda s: length(s)))::INT)::INT AS slot, 'l' AS symbol FROM "
    "(SELECT run_manifest_id, evaluation_unit_id, p, unnest(range(1, len(p))) AS k FROM (SELECT *, string_split(text, 'th') AS p FROM turns))",
)
def e7(spark, sf):
    units = fx.turns(spark, sf)
    a = al.align(fx._hypotheses(units, F.col("text"), fx.replaced("text", "th", "tli")))
    return al.insertion_runs(a).select(*UNIT, "slot", "symbol")


_DOC_SUBST = sql.with_(sql.DOCS, sql.substituted("docs"))


@query(
    "e8_aligned_rows",
    _DOC_SUBST + "SELECT run_manifest_id, evaluation_unit_id, position AS hyp_index, length(text)::INT AS columns, md5(text) AS row_digest FROM hyps",
)
def e8(spark, sf):
    a = al.align(fx.substituted(fx.documents(spark, sf)))
    return al.aligned_texts(a).select(*UNIT, F.col("hyp_index").cast("int").alias("hyp_index"), "columns", F.md5("row_text").alias("row_digest"))


_SHARE = "((ln(3) - 2 * ln(2) / 3) / ln(3))"


@query(
    "e9_consensus_entropy",
    sql.with_(sql.DOCS) + "SELECT run_manifest_id, evaluation_unit_id, length(text)::BIGINT AS column_count, "
    f"{sql.occurrences('text', 'ain')}::BIGINT AS disputed_columns, round({sql.occurrences('text', 'ain')} * {_SHARE} / length(text), 9) AS consensus_entropy FROM docs",
)
def e9(spark, sf):
    a = al.align(fx.substituted(fx.documents(spark, sf)))
    return al.consensus_entropy(a).select(
        *UNIT, "column_count", "disputed_columns", F.round("consensus_entropy", 9).alias("consensus_entropy")
    )


@query("e10_fused_text", sql.with_(sql.DOCS) + "SELECT run_manifest_id, evaluation_unit_id, translate(text, 'a', '@') AS fused_text FROM docs")
def e10(spark, sf):
    return al.fused_texts(al.align(fx.substituted(fx.documents(spark, sf)))).select(*UNIT, "fused_text")


@query(
    "e11_fusion_columns",
    sql.with_(sql.TURNS, sql.substituted("turns")) + (
        ", sym AS (SELECT run_manifest_id, evaluation_unit_id, position, unnest(range(1, length(text) + 1)) AS i, text FROM hyps), "
        "cand AS (SELECT run_manifest_id, evaluation_unit_id, i - 1 AS col_idx, text[i] AS s, count(*) AS n, min(position) AS f, "
        "string_agg(position::VARCHAR, ',' ORDER BY position) AS who FROM sym GROUP BY ALL) "
        "SELECT run_manifest_id, evaluation_unit_id, col_idx::INT AS col_idx, string_agg(s || ':' || n || ':' || who, ' ' ORDER BY f) AS candidates, "
        "arg_min(s, (10 - n) * 10 + f) AS winner, count(*) > 1 AND max(n) = min(n) AS tie FROM cand GROUP BY ALL"
    ),
)
def e11(spark, sf):
    a = al.align(fx.substituted(fx.turns(spark, sf)))
    shown = F.transform(
        "candidates",
        lambda c: F.concat_ws(":", c["symbol"], c["votes"].cast("string"), F.array_join(F.transform(c["supporters"], lambda p: p.cast("string")), ",")),
    )
    return al.indexed_columns(al.all_fusion_columns(a)).select(
        *UNIT, "col_idx", F.array_join(shown, " ").alias("candidates"), F.col("winning_symbol").alias("winner"), "tie"
    )


_GAP = "\ue004"


def _varied_rows() -> str:
    g, (p, q), (r, s) = _GAP, fx.INSERTED, fx.REPLACING
    after = lambda text, tail: f"replace({text}, 'o', 'o{tail}')"
    put = lambda old, new: f"replace(text, '{old}', '{new}')"
    lines = (
        [after("text", g + g), after("text", p + g), after("text", p + q), after(put("a", g), g + g)],
        ["text", put("e", r), put("e", s)], ["text", put("a", g)],
        [after("text", g), *[after("text", p)] * 3, after(put("a", g), g)],
    )
    return (
        "SELECT run_manifest_id, evaluation_unit_id, (p - 1)::INT AS hyp_index, length(line)::INT AS columns, md5(line) AS row_digest FROM "
        "(SELECT *, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS p FROM (SELECT *, CASE doc_id % 4 "
        + " ".join(f"WHEN {k} THEN [{', '.join(members)}]" for k, members in enumerate(lines)) + " END AS lines FROM docs))"
    )


@query("e8_varied_rows", sql.with_(sql.DOCS) + _varied_rows())
def e8_varied(spark, sf):
    a = al.align(fx.varied_documents(spark, sf))
    return al.aligned_texts(a, _GAP).select(*UNIT, F.col("hyp_index").cast("int").alias("hyp_index"), "columns", F.md5("row_text").alias("row_digest"))


@query(
    "e9_varied_entropy",
    _VARIED + "SELECT run_manifest_id, evaluation_unit_id, k AS hypothesis_count, centre_index, column_count, disputed::BIGINT AS disputed_columns, round(ce, 9) AS consensus_entropy FROM art",
)
def e9_varied(spark, sf):
    a = al.align(fx.varied_documents(spark, sf))
    return al.consensus_entropy(a).select(
        *UNIT, "hypothesis_count", F.col("centre_index").cast("int").alias("centre_index"), "column_count", "disputed_columns",
        F.round("consensus_entropy", 9).alias("consensus_entropy"),
    )


@query(
    "e10_varied_fusion",
    _VARIED + "SELECT run_manifest_id, evaluation_unit_id, tied::BIGINT AS tied_columns, sha256(fused) AS fused_sha256 FROM art",
)
def e10_varied(spark, sf):
    a = al.align(fx.varied_documents(spark, sf))
    return al.fused_texts(a).select(*UNIT, "tied_columns", F.sha2("fused_text", 256).alias("fused_sha256"))


@query(
    "e11_varied_columns",
    sql.with_(sql.TURNS, sql.varied("turns", "(conv_id + turn) % 4"))
    + ", votes AS (SELECT run_manifest_id, evaluation_unit_id, slot, lane, symbol, list_sort(flatten(list(string_split(ranks, ',')::INT[]))) AS who FROM entries GROUP BY ALL), "
    "left_over AS (SELECT v.*, centre_index, k, CASE WHEN lane = 2147483647 THEN regexp_extract_all(centre, '(?s).')[slot + 1] END AS stays FROM "
    "(SELECT run_manifest_id, evaluation_unit_id, slot, lane, flatten(list(who)) AS gone FROM votes GROUP BY ALL) v JOIN cent c USING (run_manifest_id, evaluation_unit_id)), "
    "cand AS (SELECT * FROM votes UNION ALL SELECT run_manifest_id, evaluation_unit_id, slot, lane, stays, list_filter(range(k)::INT[], lambda p: NOT list_contains(gone, p)) FROM left_over) "
    "SELECT run_manifest_id, evaluation_unit_id, slot::INT AS slot, lane::INT AS lane, string_agg(coalesce(symbol, '-') || ':' || array_to_string(who, ','), ' ' ORDER BY who[1]) AS candidates, "
    "arg_max(coalesce(symbol, '-'), len(who) * 10 - who[1]) AS winner, arg_max(symbol IS NOT NULL, len(who) * 10 - who[1]) AS emitted, "
    "count_if(len(who) = m) > 1 AS tie FROM (SELECT *, max(len(who)) OVER (PARTITION BY run_manifest_id, evaluation_unit_id, slot, lane) AS m FROM cand) GROUP BY ALL",
)
def e11_varied(spark, sf):
    gap = lambda s: F.coalesce(s, F.lit("-"))
    shown = F.transform(
        "candidates", lambda c: F.concat_ws(":", gap(c["symbol"]), F.array_join(F.transform(c["supporters"], lambda p: p.cast("string")), ","))
    )
    return al.fusion_columns(al.align(fx.varied_turns(spark, sf))).select(
        *UNIT, "slot", "lane", F.array_join(shown, " ").alias("candidates"), gap(F.col("winning_symbol")).alias("winner"), "emitted", "tie"
    )


_CONSENSUS_JSON = sql.obj(
    alignment_artifact_sha256=sql.js("alignment_artifact_sha256"), alignment_policy_id=sql.js("'alignment_v1'"),
    consensus_entropy=sql.jdouble("ce"), eligible_hypothesis_count=sql.jn("k"), evaluation_unit_id=sql.js("evaluation_unit_id"), quorum_size="'2'",
    eligible_page_model_result_ids=sql.jlist("list_transform(range(k), lambda p: 'result-' || evaluation_unit_id || '-' || p)"),
    run_manifest_id=sql.js("run_manifest_id"), text_policy_id=sql.js("'text_policy_v1'"),
)
_FUSED_JSON = sql.obj(
    alignment_artifact_sha256=sql.js("alignment_artifact_sha256"), consensus_result_id=sql.js("consensus_result_id"),
    evaluation_unit_id=sql.js("evaluation_unit_id"), fusion_policy_id=sql.js("'fusion_v1'"), run_manifest_id=sql.js("run_manifest_id"), text=sql.js("fused"),
)


@query(
    "e12_sealed_consensus",
    _VARIED.rstrip() + f", con AS (SELECT *, {sql.cid('consensus_result', _CONSENSUS_JSON)} AS consensus_result_id FROM art) "
    f"SELECT evaluation_unit_id, consensus_result_id, {sql.cid('fused_hypothesis', _FUSED_JSON)} AS fused_hypothesis_id FROM con",
)
def e12(spark, sf):
    a = al.materialized(al.align(fx.varied_documents(spark, sf)))
    headers = stores.stored(artifacts.build(a).headers)
    _, fused = al.consensus_records(a, headers, "artifacts", fx.CREATED_AT)
    return fused.select("evaluation_unit_id", "consensus_result_id", "fused_hypothesis_id")


# -- planning and budget -------------------------------------------------------------

_INTENT_JSON = sql.obj(
    evaluation_unit_id=sql.js("evaluation_unit_id"), ordinal=sql.jn("p"), page_input_variant_id=sql.js("'variant-' || doc_id"),
    planned_max_attempts="'4'", roster_member_config_id=sql.js("run_manifest_id || '-member-' || p"), run_manifest_id=sql.js("run_manifest_id"),
)


@query(
    "p1_dispatch_intents",
    sql.with_(sql.DOCS) + f"SELECT evaluation_unit_id, p::INT AS ordinal, {sql.cid('dispatch_intent', _INTENT_JSON)} AS dispatch_intent_id, "
    + sql.cid(
        "dispatch_pair",
        sql.obj(
            page_input_variant_id=sql.js("'variant-' || doc_id"), roster_member_config_id=sql.js("run_manifest_id || '-member-' || p"),
            run_manifest_id=sql.js("run_manifest_id"),
        ),
    )
    + " AS dispatch_pair_id FROM (SELECT *, unnest([0, 1, 2]) AS p FROM docs)",
)
def p1(spark, sf):
    return manifest.dispatch_intents(fx.doc_variants(spark, sf), fx.doc_members(spark, sf)).select(
        "evaluation_unit_id", "ordinal", "dispatch_intent_id", "dispatch_pair_id"
    )


_SPLIT_JSON = sql.obj(
    algorithm_id=sql.js("'fixed'"), algorithm_version=sql.js("'1.0.0'"), assignments="'[[\"' || dg || '\"]]'", dataset_id=sql.js("'documents'"),
    dataset_version=sql.js("'v1'"), hash_rule=sql.js("'diagnostic'"), seed=sql.js("'none'"),
)


@query(
    "p2_sealed_plan",
    sql.with_(sql.DOCS)
    + f"SELECT run_manifest_id || '/' || p AS subject, CASE p WHEN 1 THEN {sql.cid('roster_member_config', _member_json('p', _SETTINGS))} "
    f"ELSE {sql.cid('roster_member_config', _member_json('p', chr(39) + '{}' + chr(39)))} END AS id FROM (SELECT DISTINCT run_manifest_id, unnest([0, 1, 2]) AS p FROM docs) "
    f"UNION ALL SELECT run_manifest_id, {sql.cid('dataset_split', _SPLIT_JSON)} FROM (SELECT run_manifest_id, {sql.set_digest('evaluation_unit_id || chr(9) || ' + chr(39) + 'diagnostic' + chr(39))} AS dg FROM docs GROUP BY 1)",
)
def p2(spark, sf):
    members = manifest.roster_members(fx.roster(spark, sf)).select(
        F.concat("run_manifest_id", F.lit("/"), "position").alias("subject"), F.col("roster_member_config_id").alias("id")
    )
    units = fx.documents(spark, sf).withColumn("role", F.lit("diagnostic"))
    fixed = {
        "dataset_id": "documents", "dataset_version": "v1", "algorithm_id": "fixed", "algorithm_version": "1.0.0",
        "hash_rule": "diagnostic", "seed": "none",
    }
    settings = units.select("run_manifest_id").distinct().withColumns({k: F.lit(v) for k, v in fixed.items()})
    splits = manifest.dataset_splits(units, ("run_manifest_id",), settings).select(
        F.col("run_manifest_id").alias("subject"), F.col("dataset_split_id").alias("id")
    )
    return members.unionByName(splits)


_PAGE_JSON = sql.obj(
    dataset_id=sql.js("'pages'"), dataset_item_id=sql.js("dataset_item_id"), dataset_version=sql.js("'v1'"),
    schema_version=sql.js("'v2'"), source_sha256=sql.js("sha256(content)"),
)
_UNIT_JSON = sql.obj(
    layout_complexity=sql.js("'linear'"), reading_order_policy_id=sql.js("'reading_order_v1'"), schema_version=sql.js("'v2'"),
    selector="'null'", source_page_id=sql.js("source_page_id"),
)
_DECODE_JSON = sql.obj(
    decoder_id=sql.js("'source'"), decoder_version=sql.js("'1'"), original_bit_depth="'8'", original_color_mode=sql.js("'RGB'"),
    original_media_type=sql.js("'image/png'"), original_orientation_metadata="'null'", output_encoding=sql.js("'png'"), source_page_id=sql.js("source_page_id"),
)
_VARIANT_JSON = sql.obj(
    artifact_sha256=sql.js("digest"), byte_size=sql.jn("bytes"), decode_provenance_id=sql.js(sql.cid("decode_provenance", _DECODE_JSON)),
    evaluation_unit_id=sql.js("unit"), height_px=sql.jn("n"), media_type=sql.js("'image/png'"), perturbation_provenance="'null'",
    preprocess_policy_id=sql.js("'preprocess_v1'"), schema_version=sql.js("'v2'"), source_page_id=sql.js("source_page_id"),
    transform_chain="'[]'", variant_kind=sql.js("'natural_baseline'"), width_px=sql.jn("page_id + 100"),
)


@query(
    "p3_sealed_pages",
    sql.with_(
        _FILES, f"pg AS (SELECT *, octet_length(content) AS bytes, sha256(content) AS digest, {sql.cid('source_page', _PAGE_JSON)} AS source_page_id FROM files)",
        f"un AS (SELECT *, {sql.cid('evaluation_unit', _UNIT_JSON)} AS unit FROM pg)",
    )
    + f"SELECT source_page_id, unit AS evaluation_unit_id, {sql.cid('page_input_variant', _VARIANT_JSON)} AS page_input_variant_id, (page_id + 100)::INT AS width_px, n::INT AS height_px FROM un",
)
def p3(spark, sf):
    settings = {"dataset_id": "pages", "dataset_version": "v1", "language": "en"}
    pages = corpus.source_pages(fx.corpus_files(spark, sf), settings)
    units = corpus.evaluation_units(pages, settings)
    variants = corpus.input_variants(pages, units, corpus.decode_provenances(pages, "source", "1"))
    return variants.select("source_page_id", "evaluation_unit_id", "page_input_variant_id", "width_px", "height_px")


@query(
    "p3_photo_sizes",
    "SELECT page_id, 'D-GEO/' || page_id || CASE WHEN page_id % 3 = 0 THEN '.JPG' ELSE '.tiff' END AS dataset_item_id, "
    "CASE WHEN page_id % 3 = 0 THEN 'image/jpeg' ELSE 'image/tiff' END AS media_type, (page_id % 60000 + 100)::INT AS width_px, "
    "(length(html) % 60000 + 1)::INT AS height_px, CASE WHEN page_id % 3 = 0 THEN 'RGB' ELSE 'L' END AS color_mode FROM pages",
)
def p3_photo_sizes(spark, sf):
    pages = corpus.source_pages(fx.photo_files(spark, sf), {"dataset_id": "pages", "dataset_version": "v1", "language": "en"})
    return pages.select("page_id", "dataset_item_id", "media_type", "width_px", "height_px", "color_mode")


@query(
    "p4_resume_worklist",
    sql.with_(
        sql.JOURNAL,
        "fx AS (SELECT attempt_id, max(seq) FILTER (outcome IN ('response_received', 'rate_limited')) AS tseq, "
        "arg_max(outcome, seq) FILTER (outcome IN ('response_received', 'rate_limited')) AS tout FROM finishes GROUP BY 1)",
        "st AS (SELECT intent, max(number) AS hi, bool_or(fx.attempt_id IS NULL) AS open, arg_max(tout, tseq) FILTER (tseq IS NOT NULL) AS tout "
        "FROM s1 LEFT JOIN fx USING (attempt_id) GROUP BY 1)",
        "de AS (SELECT intent, coalesce(hi, 0) AS hi, CASE WHEN open THEN 'held' WHEN tout = 'response_received' THEN 'done' "
        "WHEN hi >= 4 THEN 'exhausted' ELSE 'ready' END AS status FROM intents LEFT JOIN st USING (intent))",
    )
    + "SELECT intent AS dispatch_intent_id, status, hi::INT AS highest_attempt_number, CASE WHEN status = 'ready' THEN hi + 1 END::INT AS next_attempt_number FROM de",
)
def p4(spark, sf):
    return journal.resume_worklist(fx.journal_intents(spark, sf), fx.journal_events(spark, sf))


@query(
    "p5_batch_admission",
    sql.with_(
        sql.ORDERS,
        "ask AS (SELECT o_custkey, ledger, sum(amt) AS a FROM (SELECT *, unnest(['nation-' || c_nationkey, 'run', 'unlisted']) AS ledger FROM ord) GROUP BY ALL)",
    )
    + "SELECT 'batch-' || o_custkey AS batch_id, bool_and(coalesce(a <= ceiling, true)) AS admitted, count(*) FILTER (a > ceiling) AS short_ledgers "
    "FROM ask LEFT JOIN lg USING (ledger) GROUP BY 1",
)
def p5(spark, sf):
    return budget.admit_batches(
        fx.reserve_requests(spark, sf), fx.ledgers(spark, sf).withColumnRenamed("ceiling_usd", "headroom_usd")
    )


@query(
    "p5_sequence",
    "WITH RECURSIVE " + ", ".join((
        sql.ORDERS,
        "ask AS (SELECT o_custkey, ledger, ceiling, sum(amt) AS a, row_number() OVER (PARTITION BY ledger ORDER BY o_custkey) AS n FROM "
        "(SELECT *, 'nation-' || c_nationkey AS ledger FROM ord) JOIN lg USING (ledger) GROUP BY o_custkey, ledger, ceiling)",
        "walk AS (SELECT o_custkey, ledger, n, a <= ceiling AS admitted, CASE WHEN a <= ceiling THEN a ELSE 0 END AS held FROM ask WHERE n = 1 UNION ALL "
        "SELECT k.o_custkey, k.ledger, k.n, w.held + k.a <= k.ceiling, CASE WHEN w.held + k.a <= k.ceiling THEN w.held + k.a ELSE w.held END "
        "FROM walk w JOIN ask k ON k.ledger = w.ledger AND k.n = w.n + 1)",
    ))
    + " SELECT 'batch-' || o_custkey AS batch_id, admitted, CASE WHEN admitted THEN 0 ELSE 1 END::BIGINT AS short_ledgers FROM walk",
)
def p5_sequence(spark, sf):
    requests = fx.reserve_requests(spark, sf).withColumn("batch_seq", F.substring("batch_id", 7, 20).cast("long"))
    return budget.admit_in_sequence(requests, fx.ledgers(spark, sf).withColumnRenamed("ceiling_usd", "headroom_usd"))


@query(
    "p6_running_balances",
    sql.with_(sql.LEDGER)
    + f"SELECT seq, ledger, {sql_money('r')} AS reserved_usd, {sql_money('s')} AS settled_usd, {sql_money('ceiling - r - s')} AS headroom_usd FROM "
    "(SELECT seq, ledger, sum(dr) OVER w AS r, sum(ds) OVER w AS s FROM ch WINDOW w AS (PARTITION BY ledger ORDER BY seq)) LEFT JOIN lg USING (ledger)",
)
def p6(spark, sf):
    rows = budget.running_balances(fx.ledger_events(spark, sf), fx.ledgers(spark, sf))
    return rows.select("seq", "ledger", *[money(c).alias(c) for c in ("reserved_usd", "settled_usd", "headroom_usd")])


@query(
    "p6_current_balances",
    sql.with_(sql.LEDGER)
    + f"SELECT ledger, {sql_money('r')} AS reserved_usd, {sql_money('s')} AS settled_usd, {sql_money('ceiling - r - s')} AS headroom_usd FROM "
    "(SELECT lg.ledger, ceiling, coalesce(sum(dr), 0) AS r, coalesce(sum(ds), 0) AS s FROM lg LEFT JOIN ch USING (ledger) GROUP BY ALL)",
)
def p6_current(spark, sf):
    rows = budget.current_balances(fx.ledger_events(spark, sf), fx.ledgers(spark, sf))
    return rows.select("ledger", *[money(c).alias(c) for c in ("reserved_usd", "settled_usd", "headroom_usd")])


@query(
    "p7_budget_violations",
    sql.with_(sql.LEDGER) + f"SELECT seq, ledger, rid AS reservation_id, kind, verdict FROM jd WHERE verdict <> 'ok'",
)
def p7(spark, sf):
    return budget.violations(fx.ledger_events(spark, sf)).select("seq", "ledger", "reservation_id", "kind", "verdict")


# -- journal to results --------------------------------------------------------------


@query(
    "r1_attempts",
    sql.with_(sql.JOURNAL)
    + f"SELECT intent AS dispatch_intent_id, number AS attempt_number, attempt_id, finished, outcome AS finish_outcome, {sql_money('cost')} AS cost_usd, ms AS duration_ms FROM att",
)
def r1(spark, sf):
    return journal.attempts(fx.journal_events(spark, sf)).select(
        "dispatch_intent_id", "attempt_number", "attempt_id", "finished", "finish_outcome", money("cost_usd").alias("cost_usd"), "duration_ms"
    )


@query(
    "r2_first_success",
    sql.with_(sql.JOURNAL, sql.RESULTS) + "SELECT intent AS dispatch_intent_id, sel AS attempt_id, txt AS text FROM good",
)
def r2(spark, sf):
    return journal.first_successes(journal.attempts(fx.journal_events(spark, sf))).select("dispatch_intent_id", "attempt_id", "text")


@query(
    "r3_terminal_outcome",
    sql.with_(sql.JOURNAL, sql.RESULTS)
    + "SELECT intent AS dispatch_intent_id, outcome AS terminal_outcome, sel AS selected_attempt_id, txt AS parsed_text FROM fin "
    "WHERE outcome <> 'budget_refused' OR intent IN (SELECT intent FROM idle WHERE role = 'system')",
)
def r3(spark, sf):
    return journal.outcomes(fx.journal_events(spark, sf)).select(
        "dispatch_intent_id", "terminal_outcome", "selected_attempt_id", "parsed_text"
    )


@query(
    "r4_totals",
    sql.with_(sql.JOURNAL)
    + f"SELECT intent AS dispatch_intent_id, {sql_money('sum(cost)')} AS total_cost_usd, sum(ms::DECIMAL(18,6))::DOUBLE AS total_measured_duration_ms FROM att GROUP BY 1",
)
def r4(spark, sf):
    rows = journal.outcomes(fx.journal_events(spark, sf).where(F.col("event_type") != "dispatch_refused"))
    return rows.select("dispatch_intent_id", money("total_cost_usd").alias("total_cost_usd"), "total_measured_duration_ms")


_RESULT_JSON = sql.obj(
    attempt_ids=sql.jlist("ids"), dispatch_intent_id=sql.js("intent"), dispatch_pair_id=sql.js("'pair-' || tail"),
    eligibility=sql.js("CASE WHEN barred THEN 'ineligible' ELSE 'eligible' END"), evaluation_unit_id=sql.js("'unit-' || tail"),
    ineligibility_reasons=sql.jlist("CASE WHEN barred THEN [outcome] ELSE [] END"), page_input_variant_id=sql.js("'variant-' || tail"),
    parsed_text=sql.js("txt"), roster_member_config_id=sql.js("'member-0'"), run_manifest_id=sql.js("'run-journal'"),
    selected_attempt_id=sql.js("sel"), terminal_outcome=sql.js("outcome"), total_cost_usd=sql.jmoney("cost"), total_measured_duration_ms=sql.jdouble("ms"),
)


@query(
    "r5_eligibility",
    sql.with_(sql.JOURNAL, sql.RESULTS)
    + "SELECT intent AS dispatch_intent_id, CASE WHEN barred THEN 'ineligible' ELSE 'eligible' END AS eligibility, CASE WHEN barred THEN outcome ELSE '' END AS reasons FROM fin",
)
def r5(spark, sf):
    rows = journal.page_model_results(fx.journal_intents(spark, sf), fx.journal_events(spark, sf), fx.CREATED_AT)
    return rows.select("dispatch_intent_id", "eligibility", F.array_join("ineligibility_reasons", ",").alias("reasons"))


@query(
    "r6_page_model_results",
    sql.with_(sql.JOURNAL, sql.RESULTS)
    + f"SELECT {sql.cid('page_model_result', _RESULT_JSON)} AS page_model_result_id, intent AS dispatch_intent_id, outcome AS terminal_outcome, len(ids)::INT AS attempts "
    "FROM (SELECT *, substr(intent, 8) AS tail FROM fin)",
)
def r6(spark, sf):
    rows = journal.page_model_results(fx.journal_intents(spark, sf), fx.journal_events(spark, sf), fx.CREATED_AT)
    return rows.select("page_model_result_id", "dispatch_intent_id", "terminal_outcome", F.size("attempt_ids").alias("attempts"))


def _read_in_halves(spark, sf):
    """Results stored from the journal's first half and then from its tail."""
    events, folder = fx.journal_events(spark, sf), work_folder(spark, "journal")
    middle = events.agg(F.expr("(min(journal_seq) + max(journal_seq)) div 2")).head()[0] or 0
    results = result_store.ResultStore(spark, work_folder(spark, "results"))
    for part in (events.where(F.col("journal_seq") <= middle), events.where(F.col("journal_seq") > middle)):
        stores.append_journal(part, folder)
        results.advance(spark.read.schema(events.schema).parquet(folder))
    return results


@query("r6_incremental", ORACLES["r6_page_model_results"])
def r6_incremental(spark, sf):
    rows = _read_in_halves(spark, sf).page_model_results(fx.journal_intents(spark, sf), fx.CREATED_AT)
    return rows.select("page_model_result_id", "dispatch_intent_id", "terminal_outcome", F.size("attempt_ids").alias("attempts"))


@query("p4_incremental", ORACLES["p4_resume_worklist"])
def p4_incremental(spark, sf):
    return _read_in_halves(spark, sf).resume_worklist(fx.journal_intents(spark, sf))


# -- ground truth --------------------------------------------------------------------

_EVENT_ID_JSON = sql.obj(
    action=sql.js("a.action"), actor_id=sql.js("a.role"), approval_authorization_id="'null'", assertion_id=sql.js("a.aid"), event_source=sql.js("'human_workflow'"),
    prior_event_hash=sql.js("a.prior"), reason=sql.js("a.text"), sequence=sql.jn("a.n"), superseded_by_assertion_id="'null'",
)
_EVENT_JSON = sql.obj(
    action=sql.js("b.action"), actor_id=sql.js("b.role"), approval_authorization_id="'null'", assertion_id=sql.js("b.aid"), created_at=sql.js(f"'{fx.CREATED_AT}'"),
    event_id=sql.js("b.event_id"), event_source=sql.js("'human_workflow'"), prior_event_hash=sql.js("b.prior"), reason=sql.js("b.text"), sequence=sql.jn("b.n"),
    superseded_by_assertion_id="'null'",
)


def _chain_step(source: str) -> str:
    return (
        f"SELECT b.*, sha256({_EVENT_JSON}) AS own FROM (SELECT a.*, {sql.cid('ground_truth_event', _EVENT_ID_JSON)} AS event_id FROM ({source}) a) b"
    )


@query(
    "g1_event_chains",
    "WITH RECURSIVE act AS (SELECT 'assertion-' || conv_id AS aid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, role, text, "
    "CASE role WHEN 'user' THEN 'submit' WHEN 'assistant' THEN 'approve' ELSE 'reject' END AS action FROM conversations), "
    f"chain AS ({_chain_step('SELECT act.*, NULL::VARCHAR AS prior FROM act WHERE n = 0')} UNION ALL "
    f"{_chain_step('SELECT act.*, c.own AS prior FROM act JOIN chain c ON act.aid = c.aid AND act.n = c.n + 1')}) "
    "SELECT aid AS assertion_id, n AS sequence, event_id, prior AS prior_event_hash FROM chain",
)
def g1(spark, sf):
    return ground_truth.append_chains(fx.turn_actions(spark, sf)).select("assertion_id", "sequence", "event_id", "prior_event_hash")


@query("g1_append", ORACLES["g1_event_chains"])
def g1_append(spark, sf):
    """The same chains in two calls: each conversation's first two turns, then the rest."""
    actions = fx.turn_actions(spark, sf)
    chains = ground_truth.ChainStore(spark, work_folder(spark, "chains"))
    chains.append(actions.where(F.col("sequence") < 2))
    chains.append(actions.where(F.col("sequence") >= 2))
    return chains.events().select("assertion_id", "sequence", "event_id", "prior_event_hash")


@query(
    "g2_chain_check",
    "SELECT 'assertion-' || conv_id AS assertion_id, n + 1 AS sequence, 'prior_hash_mismatch' AS problem FROM "
    "(SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations) "
    "WHERE role = 'system' AND n + 1 < c",
)
def g2(spark, sf):
    # Timestamps of the system turns were altered after the chain was built.
    built = ground_truth.append_chains(fx.turn_actions(spark, sf))
    altered = built.withColumn("created_at", F.when(F.col("actor_id") == "system", "2027").otherwise(F.col("created_at")))
    return ground_truth.broken_links(altered).select("assertion_id", "sequence", "problem")


@query(
    "g3_self_approvals",
    sql.with_(sql.GROUND_TRUTH) + "SELECT assertion_id, event_id, actor_id FROM gtev WHERE action = 'approve' AND actor_id = 'annotator-1' AND event_source = 'human_workflow'",
)
def g3(spark, sf):
    return ground_truth.self_approvals(fx.gt_events(spark, sf))


@query(
    "g4_authorizations",
    sql.with_(sql.GROUND_TRUTH) + "SELECT assertion_id, event_id, CASE WHEN auth IS NULL THEN 'missing_authorization' ELSE 'forbidden_authorization' END AS problem "
    "FROM gtev WHERE (action = 'approve' AND event_source = 'dataset_import') <> (auth IS NOT NULL)",
)
def g4(spark, sf):
    return ground_truth.authorization_violations(fx.gt_events(spark, sf)).select("assertion_id", "event_id", "problem")


@query("g5_active_heads", sql.with_(sql.GROUND_TRUTH) + "SELECT assertion_id, evaluation_unit_id, guideline_id FROM heads")
def g5(spark, sf):
    return ground_truth.active_heads(fx.assertions(spark, sf), fx.gt_events(spark, sf)).select(
        "assertion_id", "evaluation_unit_id", "guideline_id"
    )


@query("g6_conflicts", sql.with_(sql.GROUND_TRUTH) + "SELECT evaluation_unit_id FROM confl")
def g6(spark, sf):
    return ground_truth.conflicted_units(ground_truth.active_heads(fx.assertions(spark, sf), fx.gt_events(spark, sf)))


@query("g7_unavailable", sql.with_(sql.GROUND_TRUTH) + "SELECT evaluation_unit_id FROM unav")
def g7(spark, sf):
    claims = fx.assertions(spark, sf)
    return ground_truth.unavailable_units(claims, ground_truth.active_heads(claims, fx.gt_events(spark, sf)))


_ENTRIES = (
    "entries AS (SELECT run_manifest_id, 'assertion' AS kind, assertion_id AS id FROM heads UNION ALL SELECT h.run_manifest_id, 'event', e.event_id FROM gtev e JOIN heads h USING (assertion_id) "
    "UNION ALL SELECT run_manifest_id, 'conflicted_unit', evaluation_unit_id FROM confl UNION ALL SELECT run_manifest_id, 'unavailable_unit', evaluation_unit_id FROM unav)"
)


@query("g8_snapshot_entries", sql.with_(sql.GROUND_TRUTH, _ENTRIES) + "SELECT run_manifest_id, kind, id FROM entries")
def g8_entries(spark, sf):
    return ground_truth.snapshot_entries(fx.assertions(spark, sf), fx.gt_events(spark, sf), ("run_manifest_id",))


def _set_field(kind: str) -> str:
    member = f"CASE WHEN kind = '{kind}' THEN id END"
    return f"CASE WHEN count({member}) > 0 THEN '[\"' || {sql.set_digest('(' + member + ')')} || '\"]' ELSE '[]' END"


_SNAPSHOT_JSON = sql.obj(
    assertion_ids="fa", authorization_ids="'[]'", conflicted_evaluation_unit_ids="fc", event_ids="fe",
    resolver_policy_version=sql.js("'gt_resolver_v1'"), unavailable_evaluation_unit_ids="fu",
)
_SNAPSHOTS = (
    f"snaps AS (SELECT run_manifest_id, {sql.cid('effective_gt_snapshot', _SNAPSHOT_JSON)} AS snapshot_id FROM (SELECT run_manifest_id, {_set_field('assertion')} AS fa, {_set_field('event')} AS fe, "
    f"{_set_field('conflicted_unit')} AS fc, {_set_field('unavailable_unit')} AS fu FROM entries GROUP BY 1))"
)


@query(
    "g8_snapshot_record",
    sql.with_(sql.GROUND_TRUTH, _ENTRIES, _SNAPSHOTS) + "SELECT run_manifest_id, snapshot_id AS effective_gt_snapshot_id FROM snaps",
)
def g8(spark, sf):
    entries = ground_truth.snapshot_entries(fx.assertions(spark, sf), fx.gt_events(spark, sf), ("run_manifest_id",))
    return ground_truth.snapshot_record(entries, ("run_manifest_id",)).select("run_manifest_id", "effective_gt_snapshot_id")


def _references(spark, sf):
    return ground_truth.gt_references(fx.documents(spark, sf), fx.assertions(spark, sf), fx.gt_events(spark, sf))


@query(
    "g9_references",
    sql.with_(sql.GROUND_TRUTH) + "SELECT evaluation_unit_id, gt_availability, gt_assertion_id, CASE WHEN gt_availability = 'available' THEN md5(doc_text) END AS text_digest FROM refs",
)
def g9(spark, sf):
    return _references(spark, sf).select(
        "evaluation_unit_id", "gt_availability", "gt_assertion_id", F.md5("gt_text").alias("text_digest")
    )


# -- scoring -------------------------------------------------------------------------

_LIVE = "gt_availability = 'available'"


def _when_live(value: str) -> str:
    return f"CASE WHEN {_LIVE} THEN {value} END"


@query(
    "c1_scores",
    sql.with_(sql.GROUND_TRUTH, sql.SCORES)
    + "SELECT evaluation_unit_id, position, gt_availability, "
    + ", ".join(
        f"{_when_live(v)} AS {n}"
        for n, v in {
            "cer": "round((cs + ci)::DOUBLE / cn, 9)", "wer": "round(ws::DOUBLE / wn, 9)", "reference_length_chars": "cn", "reference_length_words": "wn",
            "char_substitutions": "cs", "char_insertions": "ci", "char_deletions": "0::BIGINT", "word_substitutions": "ws", "word_insertions": "0::BIGINT",
            "word_deletions": "0::BIGINT",
        }.items()
    )
    + ", sha256(text) AS hypothesis_text_sha256 FROM sc",
)
def c1(spark, sf):
    pairs = fx.scored_texts(fx.documents(spark, sf)).withColumnRenamed("text", "hypothesis_text").join(_references(spark, sf), "evaluation_unit_id")
    scores = scoring.compute_scores(pairs, spread_by=("evaluation_unit_id", "position"))
    return scores.select(
        "evaluation_unit_id", "position", "gt_availability",
        *[F.round(c, 9).alias(c) if c in ("cer", "wer") else F.col(c) for c in scoring.SCORES],
    )


def _context(spark, sf):
    entries = ground_truth.snapshot_entries(fx.assertions(spark, sf), fx.gt_events(spark, sf), ("run_manifest_id",))
    return scoring.unit_context(
        fx.doc_manifests(spark, sf), fx.doc_units(spark, sf), fx.doc_pages(spark, sf), fx.doc_variants(spark, sf),
        _references(spark, sf), ground_truth.snapshot_record(entries, ("run_manifest_id",)),
    )


def _member_observations(spark, sf):
    return scoring.member_observations(fx.doc_results(spark, sf), fx.doc_members(spark, sf), _context(spark, sf), fx.CREATED_AT)


def _doc_consensus(spark, sf):
    """Consensus over the successful results of each document."""
    good = fx.doc_results(spark, sf).where(F.col("terminal_outcome") == "success").select(
        *UNIT, "page_model_result_id", "position", F.col("parsed_text").alias("text")
    )
    return al.align(good)


def _fused_observations(spark, sf, scored=False):
    """With ``scored`` the texts and the entropy are wanted; they are solved in one row and stored without the scripts."""
    a = _doc_consensus(spark, sf)
    both = stores.stored(al.fused_with_entropy(a)) if scored else None
    texts, entropy = (both, both) if scored else (al.fused_texts(a), al.consensus_entropy(a))
    fused = texts.select(
        *UNIT, F.concat(F.lit("fused-"), "evaluation_unit_id").alias("fused_hypothesis_id"), F.col("fused_text").alias("text")
    )
    consensus = entropy.select(*UNIT, "consensus_entropy", F.lit(al.QUORUM).alias("quorum_size"))
    return scoring.fused_observations(fused, consensus, fx.doc_results(spark, sf), _context(spark, sf), fx.CREATED_AT)


# A member whose text is missing scores as empty text: every reference token is deleted.
_OBS = (
    "ob AS (SELECT s.*, sn.snapshot_id, lang = 'fr' AND position = 1 AS gone, "
    "run_manifest_id || '-member-' || position AS member FROM sc s JOIN snaps sn USING (run_manifest_id))"
)
_V = {
    "cs": "CASE WHEN gone THEN 0 ELSE cs END", "ci": "CASE WHEN gone THEN 0 ELSE ci END", "cd": "CASE WHEN gone THEN cn ELSE 0 END",
    "ws": "CASE WHEN gone THEN 0 ELSE ws END", "wd": "CASE WHEN gone THEN wn ELSE 0 END",
    "cer": "CASE WHEN gone THEN 1.0 ELSE (cs + ci)::DOUBLE / cn END", "wer": "CASE WHEN gone THEN 1.0 ELSE ws::DOUBLE / wn END",
}
_MEMBER_SETTINGS = "CASE WHEN position = 1 THEN sha256('[(''mode'', ''exact''), (''top_p'', ''0.9'')]') END"
_MEMBER_JSON = sql.obj(
    run_manifest_id=sql.js("run_manifest_id"), dataset_id=sql.js("'documents'"), dataset_version=sql.js("'v1'"), corpus_evidence_kind=sql.js("'natural'"),
    split=sql.js("'diagnostic'"), evaluation_unit_id=sql.js("evaluation_unit_id"), source_page_id=sql.js("'page-' || doc_id"), source_sha256=sql.js("sha256(ref)"),
    page_input_variant_id=sql.js("'variant-' || doc_id"), input_variant_sha256=sql.js("sha256(source)"), subject_kind=sql.js("'page_model_result'"),
    subject_id=sql.js("page_model_result_id"), roster_member_config_id=sql.js("member"), exact_model_id=sql.js("'reader-' || position"), provider=sql.js("'stub'"),
    router="'null'", prompt_sha256=sql.js("repeat('1', 64)"), hyperparameters_sha256=sql.js(_MEMBER_SETTINGS), adapter_version=sql.js("'1.0.0'"),
    challenge_seed_family="'null'", failure_condition_codes="'[]'", evaluation_scope_status=sql.js("'in_scope_scored'"), layout_complexity=sql.js("'linear'"),
    language=sql.js("lang"), mixed_language="'false'", gt_snapshot_id=sql.js("snapshot_id"), gt_assertion_id=sql.js("gt_assertion_id"),
    gt_availability=sql.js("gt_availability"), metric_policy_id=sql.js("'metric_v1'"), hypothesis_text_sha256=sql.js("CASE WHEN NOT gone THEN sha256(text) END"),
    reference_length_chars=sql.jn(_when_live("cn")), reference_length_words=sql.jn(_when_live("wn")), char_substitutions=sql.jn(_when_live(_V["cs"])),
    char_insertions=sql.jn(_when_live(_V["ci"])), char_deletions=sql.jn(_when_live(_V["cd"])), word_substitutions=sql.jn(_when_live(_V["ws"])),
    word_insertions=sql.jn(_when_live("0")), word_deletions=sql.jn(_when_live(_V["wd"])), cer=sql.jdouble(_when_live(_V["cer"])), wer=sql.jdouble(_when_live(_V["wer"])),
    consensus_entropy="'null'", quorum_size="'null'", eligible_hypothesis_count="'null'", outcome=sql.js("CASE WHEN gone THEN 'indeterminate' ELSE 'success' END"),
    attributed_cost_usd=sql.jmoney("(n_chars * (position + 1))::DECIMAL(18,6) / 1000000"), attributed_latency_ms=sql.jdouble("n_chars * (position + 1) / 10.0"),
    resource_attribution=sql.js("'member_all_attempts'"),
)


@query(
    "c2_member_observations",
    sql.with_(sql.GROUND_TRUTH, _ENTRIES, _SNAPSHOTS, sql.SCORES, _OBS)
    + f"SELECT {sql.cid('benchmark_observation', _MEMBER_JSON)} AS benchmark_observation_id, page_model_result_id AS subject_id, gt_availability, "
    f"round({_when_live(_V['cer'])}, 9) AS cer, round({_when_live(_V['wer'])}, 9) AS wer, CASE WHEN gone THEN 'indeterminate' ELSE 'success' END AS outcome FROM ob",
)
def c2(spark, sf):
    return _member_observations(spark, sf).select(
        "benchmark_observation_id", "subject_id", "gt_availability", F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"), "outcome"
    )


def _observation_facts(rows):
    return rows.select(
        "subject_id", "subject_kind", "gt_snapshot_id", "gt_assertion_id", "eligible_hypothesis_count", "quorum_size",
        money("attributed_cost_usd").alias("cost_usd"), F.col("attributed_latency_ms").alias("latency_ms"), "resource_attribution", "outcome",
    )


_FUSED_FACTS = (
    "SELECT 'fused-' || evaluation_unit_id AS subject_id, 'fused_hypothesis' AS subject_kind, snapshot_id AS gt_snapshot_id, gt_assertion_id, "
    "count(*) FILTER (NOT gone)::INT AS eligible_hypothesis_count, 2 AS quorum_size, "
    f"{sql_money('sum(CASE WHEN gone THEN 0 ELSE (n_chars * (position + 1))::DECIMAL(18,6) / 1000000 END)')} AS cost_usd, "
    "sum(CASE WHEN gone THEN 0 ELSE (n_chars * (position + 1) / 10.0)::DECIMAL(18,6) END)::DOUBLE AS latency_ms, 'ensemble_acquisition' AS resource_attribution, 'success' AS outcome "
    "FROM ob GROUP BY evaluation_unit_id, snapshot_id, gt_assertion_id"
)
_MEMBER_FACTS = (
    "SELECT page_model_result_id AS subject_id, 'page_model_result' AS subject_kind, snapshot_id AS gt_snapshot_id, gt_assertion_id, NULL::INT AS eligible_hypothesis_count, NULL::INT AS quorum_size, "
    f"{sql_money('(n_chars * (position + 1))::DECIMAL(18,6) / 1000000')} AS cost_usd, n_chars * (position + 1) / 10.0 AS latency_ms, 'member_all_attempts' AS resource_attribution, "
    "CASE WHEN gone THEN 'indeterminate' ELSE 'success' END AS outcome FROM ob"
)


@query("c3_fused_observations", sql.with_(sql.GROUND_TRUTH, _ENTRIES, _SNAPSHOTS, sql.SCORES, _OBS) + _FUSED_FACTS)
def c3(spark, sf):
    return _observation_facts(_fused_observations(spark, sf))


@query("c3_fused_scores")
def c3_scores(spark, sf):
    return _fused_observations(spark, sf, scored=True).select("subject_id", "cer", "wer", "consensus_entropy")


_VARIED_CHARS = {
    "cer": "round((CASE WHEN kind = 3 THEN o ELSE 0 END)::DOUBLE / nullif(length(text), 0), 9)", "reference_length_chars": "length(text)::BIGINT",
    "char_insertions": "(CASE WHEN kind = 3 THEN o ELSE 0 END)::BIGINT",
    "wer": f"round((CASE WHEN kind = 3 THEN len(list_filter({sql.words('text')}, lambda w: contains(w, 'o'))) ELSE 0 END)::DOUBLE / nullif(len({sql.words('text')}), 0), 9)",
    "word_substitutions": f"(CASE WHEN kind = 3 THEN len(list_filter({sql.words('text')}, lambda w: contains(w, 'o'))) ELSE 0 END)::BIGINT",
}


@query(
    "c3_varied_scores",
    _VARIED + "SELECT evaluation_unit_id, " + ", ".join(f"{v} AS {n}" for n, v in _VARIED_CHARS.items())
    + ", sha256(fused) AS hypothesis_text_sha256, round(ce, 9) AS consensus_entropy FROM art",
)
def c3_varied(spark, sf):
    """Fused texts of members with insertions, deletions and ties, scored against the documents."""
    a = al.materialized(al.align(fx.varied_documents(spark, sf)))
    pairs = (
        al.fused_texts(a).select(*UNIT, F.col("fused_text").alias("hypothesis_text"))
        .join(al.consensus_entropy(a).select(*UNIT, "consensus_entropy"), list(UNIT))
        .join(fx.documents(spark, sf).select(*UNIT, F.col("text").alias("gt_text"), F.lit("available").alias("gt_availability")), list(UNIT))
    )
    rows = scoring.compute_scores(pairs, ("evaluation_unit_id",))
    return rows.select(
        "evaluation_unit_id", F.round("cer", 9).alias("cer"), "reference_length_chars", "char_insertions", F.round("wer", 9).alias("wer"),
        "word_substitutions", "hypothesis_text_sha256", F.round("consensus_entropy", 9).alias("consensus_entropy"),
    )


@query(
    "c4_observation_table",
    sql.with_(sql.GROUND_TRUTH, _ENTRIES, _SNAPSHOTS, sql.SCORES, _OBS) + f"{_MEMBER_FACTS} UNION ALL {_FUSED_FACTS}",
)
def c4(spark, sf):
    return _observation_facts(scoring.observations(_member_observations(spark, sf), _fused_observations(spark, sf)))


# -- integrity -----------------------------------------------------------------------


class Stored:
    """The stored run tables, each written once when first asked for, so that every check reads only its columns."""

    def __init__(self, spark, sf):
        self._at = (spark, sf)

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        rows = stores.stored(getattr(fx, f"stored_{name}")(*self._at))
        setattr(self, name, rows)
        return rows

    @property
    def runs(self):
        return fx.turns(*self._at).select(F.col("run_manifest_id").alias("stored_run"))

    def findings(self):
        return integrity.all_findings(
            self.runs, self.manifests, self.intents, self.attempts, self.results, self.consensus, self.observations
        )

    def gates(self):
        counts = integrity.finding_counts(self.findings())
        return integrity.gates(self.runs, self.manifests, self.intents, self.results, counts)

    def reports(self):
        """Reports as a stored table, since later steps read them more than once."""
        return stores.stored(integrity.reports(self.gates()))


_CHECKS: dict[str, tuple[str, Callable]] = {
    "v1_missing_manifest": ("missing_run_manifest", lambda s: integrity.missing_manifests(s.runs, s.manifests)),
    "v2_run_mismatch": ("run_manifest_id_mismatch", lambda s: integrity.mismatched_runs(s.intents, s.results, s.observations)),
    "v3_duplicate_intent": ("duplicate_dispatch_intent", lambda s: integrity.duplicate_intents(s.intents)),
    "v4_missing_result": ("missing_page_model_result", lambda s: integrity.result_cardinality(s.intents, s.results)),
    "v5_duplicate_result": ("duplicate_page_model_result", lambda s: integrity.result_cardinality(s.intents, s.results)),
    "v6_orphan_result": ("orphan_page_model_result", lambda s: integrity.result_cardinality(s.intents, s.results)),
    "v7_duplicate_attempt": ("duplicate_attempt_id", lambda s: integrity.duplicate_attempts(s.attempts)),
    "v8_attempt_mismatch": ("attempt_id_mismatch", lambda s: integrity.mismatched_attempts(s.attempts)),
    "v9_impossible_sequence": ("impossible_attempt_sequence", lambda s: integrity.impossible_sequences(s.attempts)),
    "v10_success_without_attempt": ("success_missing_selected_attempt", lambda s: integrity.required_fields(s.results)),
    "v11_unexpected_text": ("non_success_has_parsed_text", lambda s: integrity.required_fields(s.results)),
    "v12_unknown_result": ("observation_references_unknown_result", lambda s: integrity.unknown_results(s.observations, s.results)),
    "v13_missing_contributor": ("consensus_references_missing_result", lambda s: integrity.missing_contributors(s.consensus, s.results)),
    "v14_entropy_mismatch": ("ce_reproducibility_mismatch", lambda s: integrity.unreproducible_entropy(s.consensus, s.results, s.intents)),
    "v15_blank_reference": ("blank_reference_convention_violated", lambda s: integrity.blank_reference_violations(s.observations)),
}


def _register_check(name: str, code: str, check: Callable) -> None:
    @query(name, sql.with_(sql.STORED) + sql.finding(code))
    def run(spark, sf):
        return check(Stored(spark, sf)).where(F.col("code") == code)


for _name, (_code, _check) in _CHECKS.items():
    _register_check(_name, _code, _check)


@query("v16_gates", sql.with_(sql.STORED + sql.GATES) + "SELECT * FROM gate")
def v16(spark, sf):
    return Stored(spark, sf).gates().drop("finding_counts")


@query(
    "v17_reports",
    sql.with_(sql.STORED + sql.GATES)
    + "SELECT g.run_manifest_id, gate_status, coalesce(counts, '') AS findings, false AS anomaly_detectors_run FROM gate g LEFT JOIN "
    "(SELECT run_manifest_id, string_agg(code || '=' || n, ' ' ORDER BY code) AS counts FROM (SELECT run_manifest_id, code, count(*) AS n FROM fnd GROUP BY ALL) GROUP BY 1) USING (run_manifest_id)",
)
def v17(spark, sf):
    counts = F.transform("finding_counts", lambda c: F.concat(c["code"], F.lit("="), c["n"].cast("string")))
    return integrity.reports(Stored(spark, sf).gates()).select(
        "run_manifest_id", "gate_status", F.array_join(counts, " ").alias("findings"), "anomaly_detectors_run"
    )


# -- report --------------------------------------------------------------------------


@query(
    "n1_refused_runs",
    sql.with_(sql.STORED + sql.GATES)
    + "SELECT run_manifest_id, CASE WHEN run_manifest_id NOT IN (SELECT run_manifest_id FROM man) THEN 'missing_run_manifest' ELSE 'gate_status=fail' END AS reason "
    "FROM gate WHERE gate_status = 'fail'",
)
def n1(spark, sf):
    stored = Stored(spark, sf)
    return report.refused_runs(fx.turns(spark, sf), stored.manifests, stored.reports())


def _summaries(spark, sf):
    stored = Stored(spark, sf)
    return report.observation_summaries(stored.observations, stored.manifests, stored.reports())


@query(
    "n2_summaries",
    sql.with_(sql.STORED + sql.GATES + sql.SUMMARIES)
    + "SELECT run_manifest_id, subject_kind, subject_id, round(cer, 9) AS cer, round(wer, 9) AS wer, round(consensus_entropy, 9) AS consensus_entropy, confidence_band FROM ok",
)
def n2(spark, sf):
    return _summaries(spark, sf).select(
        "run_manifest_id", "subject_kind", "subject_id",
        *[F.round(c, 9).alias(c) for c in ("cer", "wer", "consensus_entropy")], "confidence_band",
    )


def _four(value: str) -> str:
    return f"lpad(coalesce(printf('%.4f', {value}), 'n/a'), 10, ' ')"


@query(
    "n3_report_lines",
    sql.with_(sql.STORED + sql.GATES + sql.SUMMARIES)
    + f"SELECT run_manifest_id, subject_id, rpad(subject_kind, 20, ' ') || {_four('cer')} || {_four('wer')} || {_four('consensus_entropy')} || '  ' || coalesce(confidence_band, 'n/a') AS line FROM ok "
    "UNION ALL SELECT DISTINCT run_manifest_id, NULL, unnest(['Run: ' || run_manifest_id, 'Postprocess gate: pass', '', "
    f"'{report.HEADER}']) FROM ok",
)
def n3(spark, sf):
    return report.report_lines(_summaries(spark, sf)).select("run_manifest_id", "subject_id", "line")


# -- whole runs ----------------------------------------------------------------------


def _evaluated(spark, sf):
    """Run and root of an evaluation of all documents, and what names its units."""
    inputs = fx.evaluation_inputs(spark, sf)
    named, root = inputs.pop("named"), work_folder(spark, "run")
    evaluation.evaluate(evaluation.RunInputs(**inputs), root, fx.CREATED_AT)
    return root, inputs["manifests"].select("run_manifest_id"), named


_MEMBER_EDITS = (
    "read AS (SELECT *, unnest(range(5)) AS p FROM art), done AS (SELECT *, p < k AS tried, "
    "CASE WHEN kind = 0 AND p = 1 OR kind = 3 AND p IN (1, 2, 3) THEN o WHEN kind = 0 AND p = 2 THEN 2 * o ELSE 0 END AS ci, "
    "CASE WHEN kind = 1 AND p IN (1, 2) THEN e ELSE 0 END AS cs, "
    "CASE WHEN p >= k THEN length(text) WHEN kind = 0 AND p = 3 OR kind = 2 AND p = 1 OR kind = 3 AND p = 4 THEN a ELSE 0 END AS cd FROM read)"
)


@query(
    "run_evaluate",
    _VARIED.rstrip() + f", {_MEMBER_EDITS} SELECT doc_id, 'page_model_result' AS subject_kind, p::INT AS ordinal, CASE WHEN tried THEN 'success' ELSE 'budget_refused' END AS outcome, "
    "round(CASE WHEN length(text) = 0 THEN 0 ELSE (cs + ci + cd)::DOUBLE / length(text) END, 9) AS cer, cs::BIGINT AS char_substitutions, ci::BIGINT AS char_insertions, cd::BIGINT AS char_deletions, "
    "NULL::DOUBLE AS consensus_entropy, NULL::INT AS eligible_hypothesis_count, CASE WHEN tried THEN '0.005' ELSE '0' END AS cost_usd, CASE WHEN tried THEN 5.0::DOUBLE ELSE 0 END AS latency_ms FROM done "
    "UNION ALL SELECT doc_id, 'fused_hypothesis', NULL, 'success', round(CASE WHEN kind = 3 AND length(text) > 0 THEN o::DOUBLE / length(text) ELSE 0 END, 9), 0, CASE WHEN kind = 3 THEN o ELSE 0 END, 0, "
    "round(ce, 9), k, regexp_replace((k * 0.005)::DECIMAL(18,6)::VARCHAR, '\\.?0+$', ''), k * 5.0 FROM art",
)
def run_evaluate(spark, sf):
    """Everything from sealed files to the stored observations, for one run over all documents."""
    root, _, named = _evaluated(spark, sf)
    read = lambda name, record: stores.read_table(spark, f"{root}/{name}", ident.RECORD_TYPES[record].schema)
    ordinals = (
        read("page_model_results", "page_model_result").select(F.col("page_model_result_id").alias("subject_id"), "dispatch_intent_id")
        .join(read("dispatch_intents", "dispatch_intent").select("dispatch_intent_id", F.col("ordinal").cast("int").alias("ordinal")), "dispatch_intent_id")
    )
    rows = read("benchmark_observations", "benchmark_observation").join(named, "evaluation_unit_id").join(ordinals.drop("dispatch_intent_id"), "subject_id", "left")
    return rows.select(
        "doc_id", "subject_kind", "ordinal", "outcome", F.round("cer", 9).alias("cer"), "char_substitutions", "char_insertions", "char_deletions",
        F.round("consensus_entropy", 9).alias("consensus_entropy"), F.when(F.col("subject_kind") == "fused_hypothesis", F.col("eligible_hypothesis_count")).alias("eligible_hypothesis_count"),
        money("attributed_cost_usd").alias("cost_usd"), F.col("attributed_latency_ms").alias("latency_ms"),
    )


@query(
    "run_analyze",
    _VARIED.rstrip() + f", {_MEMBER_EDITS}, shown AS (SELECT 'page_model_result' AS subject_kind, NULL::VARCHAR AS confidence_band, "
    "CASE WHEN length(text) = 0 THEN 0 ELSE (cs + ci + cd)::DOUBLE / length(text) END AS cer FROM done UNION ALL SELECT 'fused_hypothesis', "
    "CASE WHEN ce <= 0.1 THEN 'high_confidence' WHEN ce >= 0.3 THEN 'low_confidence' WHEN ce IS NOT NULL THEN 'medium_confidence' END, "
    "CASE WHEN kind = 3 AND length(text) > 0 THEN o::DOUBLE / length(text) ELSE 0 END FROM art) "
    "SELECT subject_kind, confidence_band, count(*) AS subjects, round(avg(cer), 6) AS mean_cer, 'pass' AS gate_status, 'complete' AS run_completion_status, "
    "(SELECT 5 * count(*) FROM documents) AS expected_pair_count, (SELECT 5 * count(*) FROM documents) AS observed_result_count FROM shown GROUP BY ALL",
)
def run_analyze(spark, sf):
    """The same run validated and analyzed: its gate, and its subjects by confidence band."""
    root, runs, _ = _evaluated(spark, sf)
    reports = evaluation.validate(spark, root, runs)
    summaries, _ = evaluation.analyze(spark, root, reports, runs)
    gate = reports.select("run_manifest_id", "gate_status", "run_completion_status", "expected_pair_count", "observed_result_count")
    return (
        summaries.join(gate, "run_manifest_id")
        .groupBy("subject_kind", "confidence_band", *gate.columns[1:])
        .agg(F.count(F.lit(1)).alias("subjects"), F.round(F.avg("cer"), 6).alias("mean_cer"))
    )


# -- streaming -----------------------------------------------------------------------


_MOST = "(SELECT max(CASE WHEN event_type IN ('signup', 'click') THEN ts ELSE ts + INTERVAL 90 SECOND END) FROM events) - INTERVAL 10 MINUTE"
_CLICKED = "(SELECT max(ts + INTERVAL 2 HOUR) FROM events WHERE event_type = 'click') - INTERVAL 10 MINUTE"


@query(
    "w1_journal_follow",
    f"WITH ev AS (SELECT event_id, event_type, ts + INTERVAL 1 HOUR <= {_MOST} AS given_up, ts + INTERVAL 1 HOUR <= greatest({_MOST}, coalesce({_CLICKED}, {_MOST})) AS given_up_later FROM events) "
    "SELECT event_id::VARCHAR AS attempt_id, CASE WHEN event_type <> 'signup' THEN event_type WHEN given_up_later THEN 'indeterminate' ELSE 'open' END AS state, "
    "CASE event_type WHEN 'signup' THEN CASE WHEN given_up_later THEN 2 ELSE 1 END WHEN 'click' THEN CASE WHEN given_up THEN 3 ELSE 2 END ELSE 1 END::INT AS changes, "
    "event_type = 'click' AND given_up AS corrected FROM ev",
)
def w1(spark, sf):
    """Every event is an attempt; sign-ups never finish, and clicks finish in a part of the journal that comes later."""
    rows = fx.table(spark, sf, "events").select(F.col("event_id").alias("attempt_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    late = F.col("event_type") == "click"
    wait = F.when(late, F.expr("interval 2 hours")).otherwise(F.expr("interval 90 seconds"))
    starts = rows.select("attempt_id", F.lit("attempt_started").alias("kind"), F.col("ts").alias("event_ts"), F.lit(None).cast("string").alias("outcome"))
    finishes = lambda which: rows.where(which).select(
        "attempt_id", F.lit("attempt_finished").alias("kind"), (F.col("ts") + wait).alias("event_ts"), F.col("event_type").alias("outcome")
    )
    folder, path, checkpoint = (work_folder(spark, f"follow-{n}") for n in ("journal", "changes", "checkpoint"))
    for part in (starts.unionByName(finishes(~late & (F.col("event_type") != "signup"))), finishes(late)):
        stores.append_journal(part, folder)
        stream = spark.readStream.schema(part.schema).parquet(folder)
        journal_follow.drain(journal_follow.follow_journal(stream), path, checkpoint)
    return journal_follow.latest_states(stores.read_table(spark, path, journal_follow.CHANGES))
