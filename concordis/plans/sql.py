"""Pieces of the equivalent SQL for the check engine."""

from __future__ import annotations

CREATED_AT = "2026-01-01T00:00:00Z"

DOCS = "docs AS (SELECT 'run-' || lang AS run_manifest_id, 'unit-' || doc_id AS evaluation_unit_id, * FROM documents)"
TURNS = (
    "turns AS (SELECT 'run-' || role AS run_manifest_id, 'unit-' || conv_id || '-' || turn AS evaluation_unit_id, * "
    "FROM conversations)"
)
# Accented letters as unused single bytes, since the check engine's edit distance counts bytes.
ACCENTED = "éóñèçêüäößíÉÈÑÓÇÄÊÜÖÍ"
_CODES = [c for c in range(1, 32) if c not in (9, 10, 13)][: len(ACCENTED)]


def single_bytes(text: str) -> str:
    return f"translate({text}, '{ACCENTED}', {' || '.join(f'chr({c})' for c in _CODES)})"


def stacked(name: str, source: str, *texts: str) -> str:
    """CTE with one row per unit and member text."""
    parts = [
        f"SELECT run_manifest_id, evaluation_unit_id, 'result-' || evaluation_unit_id || '-{p}' AS page_model_result_id, "
        f"{p} AS position, {t} AS text FROM {source}"
        for p, t in enumerate(texts)
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def misread(source: str) -> str:
    return stacked("hyps", source, "replace(text,'th','tli')", "replace(text,'on','o')", "translate(text,'ou','#~')")


def substituted(source: str) -> str:
    return stacked("hyps", source, "translate(text,'a','@')", "translate(text,'ai','@!')", "translate(text,'n','#')")


_P, _Q, _R, _S = "\ue000", "\ue001", "\ue002", "\ue003"


def varied(source: str, kind: str) -> str:
    """CTEs ``cent`` (a unit's kind, counts, centre, size, fused text and entropy) and ``entries`` (its departures)."""
    share = lambda k, *votes: f"((ln({k}) - ({' + '.join(f'{n} * ln({n})' for n in votes)}) / {k}) / ln({k}))"
    entry = lambda slot, lane, ranks, symbol: f"{{'slot': {slot}, 'lane': {lane}, 'ranks': '{ranks}', 'symbol': {symbol}}}"
    quoted = "'{}'".format
    gap, centre = "NULL::VARCHAR", "2147483647"
    at = lambda ranks, symbol: entry("pos", centre, ranks, symbol)
    return (
        f"vary AS (SELECT *, ({kind})::INT AS kind, {occurrences('text', 'o')} AS o, {occurrences('text', 'a')} AS a, {occurrences('text', 'e')} AS e, "
        f"replace(text, 'o', 'o{_P}') AS ins FROM {source}), "
        "cent AS (SELECT *, CASE WHEN kind = 3 AND o > 0 THEN ins ELSE text END AS centre, CASE WHEN kind = 3 AND o > 0 THEN 1 ELSE 0 END AS centre_index, "
        "[4, 3, 2, 5][kind + 1] AS k, CASE kind WHEN 0 THEN 2 * o ELSE 0 END AS inserted, CASE kind WHEN 3 THEN ins ELSE text END AS fused, "
        "CASE kind WHEN 0 THEN 2 * o + a WHEN 1 THEN e WHEN 2 THEN a ELSE o + a END AS disputed, CASE kind WHEN 0 THEN o WHEN 1 THEN e WHEN 2 THEN a ELSE 0 END AS tied, "
        f"CASE kind WHEN 0 THEN o * {share(4, 2, 2)} + (o + a) * {share(4, 3, 1)} WHEN 1 THEN e * {share(3, 1, 1, 1)} WHEN 2 THEN a * {share(2, 1, 1)} "
        f"ELSE o * {share(5, 3, 2)} + a * {share(5, 4, 1)} END / nullif(length(CASE WHEN kind = 3 THEN ins ELSE text END) + CASE kind WHEN 0 THEN 2 * o ELSE 0 END, 0) AS ce FROM vary), "
        "symbols AS (SELECT run_manifest_id, evaluation_unit_id, kind, a, unnest(list_zip(regexp_extract_all(centre, '(?s).'), range(length(centre)))) AS z FROM cent), "
        "entries AS (SELECT run_manifest_id, evaluation_unit_id, unnest(CASE "
        f"WHEN kind = 0 AND ch = 'o' THEN [{entry('pos + 1', 0, '1', quoted(_P))}, {entry('pos + 1', 0, '2', quoted(_P))}, {entry('pos + 1', 1, '2', quoted(_Q))}] "
        f"WHEN kind = 0 AND ch = 'a' THEN [{at('3', gap)}] WHEN kind = 1 AND ch = 'e' THEN [{at('1', quoted(_R))}, {at('2', quoted(_S))}] "
        f"WHEN kind = 2 AND ch = 'a' THEN [{at('1', gap)}] WHEN kind = 3 AND ch = 'a' THEN [{at('4', gap)}] "
        f"WHEN kind = 3 AND ch = '{_P}' THEN CASE WHEN a = 0 THEN [{at('0,4', gap)}] ELSE [{at('0', gap)}, {at('4', gap)}] END "
        "ELSE [] END, recursive := true) FROM (SELECT *, z[1] AS ch, z[2] AS pos FROM symbols))"
    )


def artifact_ctes() -> str:
    """CTE ``art``: every unit's artifact address, from ``cent`` and ``entries``."""
    return (
        "blocks AS (SELECT run_manifest_id, evaluation_unit_id, slot // 256 AS sb, 0 AS lb, count(*) AS n, sha256(string_agg('[' || slot || ',' || "
        f"CASE WHEN lane = 2147483647 THEN 'null' ELSE lane::VARCHAR END || ',[' || ranks || '],' || {js('symbol')} || ']', ',' ORDER BY slot, lane, ranks)) AS h FROM entries GROUP BY ALL), "
        "roots AS (SELECT evaluation_unit_id, sum(n)::BIGINT AS n, sha256(string_agg(sb || ':' || lb || ':' || h, ',' ORDER BY sb, lb)) AS root FROM blocks GROUP BY ALL), "
        "art AS (SELECT c.*, coalesce(r.n, 0)::BIGINT AS departure_count, (length(centre) + inserted)::BIGINT AS column_count, sha256('{\"center_index\":' || centre_index || "
        "',\"center_text_sha256\":\"' || sha256(centre) || '\",\"column_count\":' || (length(centre) + inserted) || ',\"contributor_result_ids\":[' || "
        "array_to_string(list_transform(range(k), lambda p: '\"result-' || evaluation_unit_id || '-' || p || '\"'), ',') || '],\"departure_count\":' || coalesce(r.n, 0)::BIGINT || "
        "',\"departures_sha256\":\"' || coalesce(root, sha256('')) || '\",\"hypothesis_count\":' || k || ',\"text_policy_id\":\"text_policy_v1\"}') AS alignment_artifact_sha256 "
        "FROM cent c LEFT JOIN roots r USING (evaluation_unit_id))"
    )


def scored(source: str) -> str:
    return stacked("hyps", source, "translate(text,'ou','#~')", "translate(text,'e','3')", "replace(text,'th','tli')")


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


# -- canonical JSON ------------------------------------------------------------------


def js(value: str) -> str:
    return f"coalesce(to_json(({value})::VARCHAR)::VARCHAR, 'null')"


def jn(value: str) -> str:
    return f"coalesce(({value})::VARCHAR, 'null')"


def jmoney(value: str) -> str:
    return f"coalesce('\"' || regexp_replace(({value})::DECIMAL(18,6)::VARCHAR, '\\.?0+$', '') || '\"', 'null')"


def jdouble(value: str) -> str:
    return f"coalesce(regexp_replace(printf('%.12f', ({value})::DOUBLE), '(\\.\\d+?)0*$', '\\1'), 'null')"


def jlist(value: str) -> str:
    return f"coalesce('[' || array_to_string(list_transform({value}, lambda x: to_json(x::VARCHAR)::VARCHAR), ',') || ']', 'null')"


def obj(**members: str) -> str:
    parts = []
    for i, name in enumerate(sorted(members)):
        parts.append(f"'{'{' if i == 0 else ','}\"{name}\":' || {members[name]}")
    return "(" + " || ".join(parts) + " || '}')"


def cid(record_type: str, preimage: str) -> str:
    return f"('{record_type}_sha256:' || sha256({preimage}))"


def attempt_id(intent: str, number: str) -> str:
    return cid("attempt", obj(attempt_number=jn(number), dispatch_intent_id=js(intent)))


def set_digest(ids: str) -> str:
    sums = ", ".join(
        f"coalesce(sum(('0x' || substr(sha256({ids}), {1 + 5 * i}, 5))::BIGINT), 0)::VARCHAR" for i in range(12)
    )
    return f"('set_sha256:' || sha256(concat_ws(',', count({ids})::VARCHAR, {sums})))"


# -- attempt journal -----------------------------------------------------------------

JOURNAL = (
    "base AS (SELECT event_id, ts, event_type AS kind, value, 'intent-' || user_id || '-' || ts::DATE AS intent, "
    "(hour(ts) // 6 + 1)::INT AS number FROM events), "
    f"keyed AS (SELECT *, {attempt_id('intent', 'number')} AS attempt_id FROM base), "
    "starts AS (SELECT event_id * 2 AS seq, intent, number, attempt_id, ts FROM keyed), "
    "finishes AS (SELECT event_id * 2 + 1 AS seq, attempt_id, ts + INTERVAL 90 SECOND AS fts, "
    "CASE kind WHEN 'purchase' THEN 'response_received' WHEN 'click' THEN 'rate_limited' "
    "WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'transport_error' END "
    "ELSE CASE event_id % 4 WHEN 0 THEN 'content_filtered' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'provider_rejected' "
    "ELSE 'response_received' END END AS outcome, "
    "CASE WHEN kind = 'purchase' THEN 'transcription' WHEN kind = 'error' AND event_id % 4 = 3 THEN "
    "CASE WHEN event_id % 8 = 3 THEN 'whole_unit_abstention' ELSE 'parse_failure' END END AS pkind, "
    "CASE WHEN kind = 'purchase' THEN 'text ' || event_id END AS ptext, "
    "(kind <> 'purchase' OR event_id % 5 <> 0) AS complete, "
    "CASE WHEN kind <> 'view' THEN (round(value * 100)::DECIMAL(18,6) / 10000)::DECIMAL(18,6) ELSE 0::DECIMAL(18,6) END AS cost, "
    "round(value * 10) AS ms FROM keyed WHERE kind <> 'signup'), "
    "s1 AS (SELECT intent, number, arg_max(attempt_id, seq) AS attempt_id FROM starts GROUP BY ALL), "
    "f1 AS (SELECT * FROM finishes QUALIFY row_number() OVER (PARTITION BY attempt_id ORDER BY seq DESC) = 1), "
    "att AS (SELECT s1.*, f1.seq IS NOT NULL AS finished, outcome, pkind, ptext, complete, "
    "coalesce(cost, 0)::DECIMAL(18,6) AS cost, coalesce(ms, 0.0) AS ms FROM s1 LEFT JOIN f1 USING (attempt_id)), "
    "idle AS (SELECT role, 'intent-unit-' || conv_id || '-' || turn AS intent FROM conversations), "
    "intents AS (SELECT DISTINCT intent FROM base UNION ALL SELECT intent FROM idle)"
)

RESULTS = (
    "good AS (SELECT intent, arg_min(attempt_id, number) AS sel, arg_min(ptext, number) AS txt FROM att "
    "WHERE outcome = 'response_received' AND pkind = 'transcription' AND complete GROUP BY 1), "
    "part AS (SELECT intent, arg_min(attempt_id, number) AS sel, arg_min(ptext, number) AS txt, arg_min(pkind, number) AS pk "
    "FROM att WHERE outcome = 'response_received' AND ((pkind = 'transcription' AND NOT complete) OR pkind = 'whole_unit_abstention') GROUP BY 1), "
    "flags AS (SELECT intent, count(*) AS n, bool_or(NOT finished) AS open, "
    "bool_or(coalesce(outcome = 'content_filtered', false)) AS cf, bool_or(coalesce(outcome = 'cancelled', false)) AS ca, "
    "bool_or(coalesce(outcome = 'provider_rejected', false)) AS pr, "
    "bool_and(coalesce(outcome IN ('rate_limited', 'transport_error', 'timeout'), false)) AS retry, "
    "sum(cost)::DECIMAL(18,6) AS cost, sum(ms::DECIMAL(18,6))::DOUBLE AS ms, list(attempt_id ORDER BY number) AS ids FROM att GROUP BY 1), "
    "res AS (SELECT i.intent, CASE WHEN g.intent IS NOT NULL THEN 'success' WHEN f.open THEN 'indeterminate' "
    "WHEN f.n IS NULL THEN 'budget_refused' WHEN cf THEN 'content_filtered' WHEN ca THEN 'cancelled' WHEN pr THEN 'unsupported_input' "
    "WHEN p.pk = 'transcription' THEN 'truncated' WHEN p.pk IS NOT NULL THEN p.pk WHEN retry THEN 'retry_exhausted' "
    "ELSE 'permanent_failure' END AS outcome, g.sel AS gsel, g.txt AS gtxt, p.sel AS psel, p.txt AS ptxt, "
    "coalesce(f.cost, 0)::DECIMAL(18,6) AS cost, coalesce(f.ms, 0.0) AS ms, coalesce(f.ids, []::VARCHAR[]) AS ids "
    "FROM intents i LEFT JOIN good g USING (intent) LEFT JOIN part p USING (intent) LEFT JOIN flags f USING (intent)), "
    "fin AS (SELECT intent, outcome, CASE outcome WHEN 'success' THEN gsel WHEN 'truncated' THEN psel END AS sel, "
    "CASE outcome WHEN 'success' THEN gtxt WHEN 'truncated' THEN ptxt END AS txt, cost, ms, ids, "
    "outcome IN ('indeterminate', 'budget_refused', 'content_filtered', 'cancelled', 'unsupported_input', 'retry_exhausted', "
    "'permanent_failure') AS barred FROM res)"
)

# -- ledgers -------------------------------------------------------------------------

ORDERS = (
    "ord AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus AS st, o_totalprice::DECIMAL(18,6) AS amt, c_nationkey "
    "FROM orders JOIN customer ON o_custkey = c_custkey), "
    "lg AS (SELECT 'nation-' || n_nationkey AS ledger, ((n_nationkey + 1) * 1000000)::DECIMAL(18,6) AS ceiling FROM nation "
    "UNION ALL SELECT 'run', NULL)"
)
LEDGER = ORDERS + (
    ", opened AS (SELECT *, unnest(['nation-' || c_nationkey, 'run']) AS ledger FROM ord), "
    "ev AS (SELECT k * 2 AS seq, ledger, 'reservation-' || k AS rid, 'reserve' AS kind, amt FROM opened UNION ALL "
    "SELECT (k + 50) * 2 + 1, ledger, 'reservation-' || k, CASE WHEN st = 'F' THEN 'release' ELSE 'reconcile' END, "
    "CASE WHEN st = 'F' THEN 0 ELSE (amt * CASE WHEN k % 97 = 0 THEN 1.2 ELSE 0.9 END)::DECIMAL(18,6) END FROM opened UNION ALL "
    "SELECT (k + 90) * 2 + 1000000001, ledger, CASE WHEN k % 97 = 0 THEN 'lost-' || k ELSE 'reservation-' || k END, "
    "'release', 0 FROM opened WHERE st = 'P'), "
    "rs AS (SELECT ledger, rid, amt AS ramt, seq AS rseq FROM ev WHERE kind = 'reserve'), "
    "cl AS (SELECT ev.*, ramt, rseq, rseq IS NOT NULL AND rseq < seq AS known, "
    "kind = 'release' OR amt <= ramt AS fits FROM ev LEFT JOIN rs USING (ledger, rid) WHERE kind <> 'reserve'), "
    "fc AS (SELECT ledger, rid, min(seq) AS cseq FROM cl WHERE known AND fits GROUP BY ALL), "
    "jd AS (SELECT cl.*, CASE WHEN NOT known THEN 'unknown_reservation' WHEN seq > cseq THEN 'already_closed' "
    "WHEN NOT fits THEN 'overcharge' ELSE 'ok' END AS verdict FROM cl LEFT JOIN fc USING (ledger, rid)), "
    "ch AS (SELECT seq, ledger, rid, kind, amt::DECIMAL(28,6) AS dr, 0::DECIMAL(28,6) AS ds FROM ev WHERE kind = 'reserve' UNION ALL "
    "SELECT seq, ledger, rid, kind, -ramt, CASE WHEN kind = 'reconcile' THEN amt ELSE 0 END FROM jd WHERE verdict = 'ok')"
)

# -- ground truth --------------------------------------------------------------------

GROUND_TRUTH = DOCS + (
    ", gt AS (SELECT v.version || '-' || d.doc_id AS assertion_id, d.run_manifest_id, d.evaluation_unit_id, "
    "CASE WHEN l.toxic = 1 AND v.version = 'a' THEN 'fully_illegible' ELSE 'transcribable' END AS target_state, d.text, "
    "CASE WHEN v.version = 'b' AND d.lang = 'fr' THEN 'g2' ELSE 'g1' END AS guideline_id, v.version, l.quality, d.source AS src "
    "FROM docs d LEFT JOIN labels l USING (doc_id), (VALUES ('a'), ('b')) v(version) "
    "WHERE v.version = 'a' OR d.lang IN ('es', 'fr')), "
    "gtev AS (SELECT assertion_id, s.sequence, s.action, assertion_id || '/' || s.sequence AS event_id, "
    "CASE WHEN s.action = 'approve' AND src <> 'src1' THEN 'annotator-2' ELSE 'annotator-1' END AS actor_id, "
    "CASE WHEN src IN ('src2', 'src3') THEN 'dataset_import' ELSE 'human_workflow' END AS event_source, "
    "CASE WHEN (s.action = 'approve' AND src = 'src2') OR src = 'src4' THEN 'authorization-1' END AS auth "
    "FROM gt, (VALUES (0::BIGINT, 'submit'), (1, 'approve'), (2, 'reject')) s(sequence, action) "
    "WHERE s.sequence < 2 OR (quality = 0 AND version = 'a')), "
    "heads AS (SELECT gt.* FROM gt JOIN (SELECT assertion_id, arg_max(action, sequence) AS act FROM gtev GROUP BY 1) x "
    "USING (assertion_id) WHERE x.act = 'approve'), "
    "confl AS (SELECT DISTINCT run_manifest_id, evaluation_unit_id FROM heads GROUP BY run_manifest_id, evaluation_unit_id, guideline_id HAVING count(*) > 1), "
    "unav AS (SELECT DISTINCT run_manifest_id, evaluation_unit_id FROM gt WHERE evaluation_unit_id NOT IN (SELECT evaluation_unit_id FROM heads)), "
    "pick AS (SELECT evaluation_unit_id, min(assertion_id) AS assertion_id FROM heads "
    "WHERE evaluation_unit_id NOT IN (SELECT evaluation_unit_id FROM confl) GROUP BY 1), "
    "refs AS (SELECT d.evaluation_unit_id, CASE WHEN c.evaluation_unit_id IS NOT NULL THEN 'conflicted' WHEN p.assertion_id IS NULL "
    "THEN 'unavailable' WHEN g.target_state = 'fully_illegible' THEN 'excluded_fully_illegible' ELSE 'available' END AS gt_availability, "
    "p.assertion_id AS gt_assertion_id, d.text AS doc_text FROM docs d LEFT JOIN confl c USING (evaluation_unit_id) "
    "LEFT JOIN pick p USING (evaluation_unit_id) LEFT JOIN gt g ON g.assertion_id = p.assertion_id)"
)

WORDS = r"list_filter(regexp_split_to_array({0}, '[ \t\n\x0B\x0C\r\x1C-\x1F\x85\xA0\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), lambda w: w <> '')"


def words(text: str) -> str:
    return WORDS.format(text)


def occurrences(text: str, chars: str) -> str:
    return f"(length({text}) - length(translate({text}, '{chars}', '')))"


# Edit counts of the scored members against the text they came from.  Each only turns
# symbols into others that are never turned themselves, so the counts are forced: every
# changed symbol costs one edit, and nothing cheaper removes it.
SCORES = scored("docs") + (
    ", sc AS (SELECT h.*, r.gt_availability, r.gt_assertion_id, d.doc_id, d.lang, d.n_chars, d.source, d.text AS ref, "
    f"CASE h.position WHEN 0 THEN {occurrences('d.text', 'ou')} WHEN 1 THEN {occurrences('d.text', 'e')} "
    "ELSE (length(d.text) - length(replace(d.text, 'th', ''))) // 2 END::BIGINT AS cs, "
    "CASE h.position WHEN 2 THEN (length(d.text) - length(replace(d.text, 'th', ''))) // 2 ELSE 0 END::BIGINT AS ci, "
    f"len(list_filter({words('d.text')}, lambda w: CASE h.position WHEN 0 THEN regexp_matches(w, '[ou]') "
    "WHEN 1 THEN contains(w, 'e') ELSE contains(w, 'th') END))::BIGINT AS ws, "
    f"len({words('d.text')})::BIGINT AS wn, length(d.text)::BIGINT AS cn "
    "FROM hyps h JOIN docs d USING (evaluation_unit_id) JOIN refs r USING (evaluation_unit_id))"
)

# -- stored runs ---------------------------------------------------------------------

STORED = TURNS + ", " + substituted("turns") + (
    ", mem AS (SELECT h.run_manifest_id AS stored_run, h.evaluation_unit_id AS unit, h.position, h.text, t.role, t.turn, t.conv_id, "
    "t.text AS ref, h.evaluation_unit_id || '-' || h.position AS tag, "
    "CASE WHEN t.role = 'user' THEN t.turn ELSE -1 END AS ft FROM hyps h JOIN turns t USING (evaluation_unit_id)), "
    "man AS (SELECT DISTINCT run_manifest_id FROM turns WHERE role <> 'system'), "
    "its AS (SELECT stored_run, 'intent-' || tag AS intent, 'pair-' || tag AS pair FROM mem UNION ALL "
    "SELECT stored_run, 'intent-' || tag, 'pair-' || tag FROM mem WHERE ft = 2 AND position = 0), "
    "rsb AS (SELECT *, 'result-' || tag AS rid, 'pair-' || tag AS pair FROM mem WHERE NOT (ft = 2 AND position = 1)), "
    "rs0 AS (SELECT * FROM rsb UNION ALL SELECT * FROM rsb WHERE ft = 2 AND position = 2 UNION ALL "
    "SELECT * REPLACE ('stray-' || tag AS rid, 'stray-' || tag AS pair) FROM rsb WHERE ft = 4 AND position = 0), "
    "rst AS (SELECT *, CASE WHEN ft = 6 AND position = 2 THEN 'run-elsewhere' ELSE stored_run END AS run_manifest_id, "
    "CASE WHEN ft = 0 AND position = 2 THEN 'indeterminate' WHEN ft = 4 AND position = 1 THEN 'truncated' ELSE 'success' END AS outcome, "
    "CASE WHEN ft = 0 AND position = 2 THEN NULL ELSE text END AS parsed, "
    "NOT (ft = 6 AND position = 0) AND NOT (ft = 0 AND position = 2) AS selected FROM rs0), "
    "stb AS (SELECT stored_run, 'intent-' || tag AS intent, CASE WHEN ft = 4 AND position = 2 THEN 2 ELSE 1 END AS number, tag, ft, position FROM mem), "
    f"st1 AS (SELECT *, {attempt_id('intent', 'number')} AS true_id FROM stb), "
    "sts AS (SELECT *, CASE WHEN ft = 4 AND position = 0 THEN 'attempt-' || tag ELSE true_id END AS attempt_id, 0 AS copy FROM st1 "
    "UNION ALL SELECT *, true_id, 1 FROM st1 WHERE ft = 6 AND position = 1), "
    "con AS (SELECT run_manifest_id AS stored_run, evaluation_unit_id AS unit, 'consensus-' || evaluation_unit_id AS cid, "
    f"{occurrences('text', 'ain')} * ((ln(3) - 2 * ln(2) / 3) / ln(3)) / length(text) AS ce, role = 'user' AND turn = 6 AS off FROM turns), "
    f"obs AS (SELECT *, 'observation-' || tag AS oid, CASE WHEN ft = 4 AND position = 2 THEN 'nowhere-' || tag ELSE 'result-' || tag END AS subject, "
    "ft = 2 AND position = 2 AS blank FROM mem)"
)

_FINDINGS = {
    "missing_run_manifest": "SELECT DISTINCT run_manifest_id AS r, run_manifest_id AS s FROM turns WHERE run_manifest_id NOT IN (SELECT run_manifest_id FROM man)",
    "run_manifest_id_mismatch": "SELECT stored_run AS r, 'page_model_results' AS s FROM rst WHERE run_manifest_id <> stored_run",
    "duplicate_dispatch_intent": "SELECT stored_run AS r, pair AS s FROM its GROUP BY ALL HAVING count(*) <> 1",
    "missing_page_model_result": "SELECT DISTINCT stored_run AS r, pair AS s FROM its WHERE NOT EXISTS (SELECT 1 FROM rst x WHERE x.stored_run = its.stored_run AND x.pair = its.pair)",
    "duplicate_page_model_result": "SELECT stored_run AS r, pair AS s FROM rst WHERE EXISTS (SELECT 1 FROM its x WHERE x.stored_run = rst.stored_run AND x.pair = rst.pair) GROUP BY ALL HAVING count(*) > 1",
    "orphan_page_model_result": "SELECT DISTINCT stored_run AS r, pair AS s FROM rst WHERE NOT EXISTS (SELECT 1 FROM its x WHERE x.stored_run = rst.stored_run AND x.pair = rst.pair)",
    "duplicate_attempt_id": "SELECT stored_run AS r, attempt_id AS s FROM sts QUALIFY row_number() OVER (PARTITION BY stored_run, attempt_id ORDER BY copy) > 1",
    "attempt_id_mismatch": "SELECT stored_run AS r, attempt_id AS s FROM sts WHERE attempt_id <> true_id",
    "impossible_attempt_sequence": "SELECT stored_run AS r, intent AS s FROM sts GROUP BY ALL HAVING list(number ORDER BY number) <> range(1, count(*) + 1)",
    "success_missing_selected_attempt": "SELECT stored_run AS r, rid AS s FROM rst WHERE outcome = 'success' AND NOT selected",
    "non_success_has_parsed_text": "SELECT stored_run AS r, rid AS s FROM rst WHERE outcome <> 'success' AND parsed IS NOT NULL",
    "observation_references_unknown_result": "SELECT stored_run AS r, oid AS s FROM obs WHERE NOT EXISTS (SELECT 1 FROM rst x WHERE x.stored_run = obs.stored_run AND x.rid = obs.subject)",
    "consensus_references_missing_result": (
        "SELECT c.stored_run AS r, c.cid AS s FROM con c JOIN (SELECT m.stored_run, m.unit, count(x.tag) AS n FROM mem m LEFT JOIN "
        "(SELECT DISTINCT stored_run, tag FROM rst WHERE rid = 'result-' || tag AND parsed IS NOT NULL) x USING (stored_run, tag) GROUP BY ALL) k USING (stored_run, unit) WHERE n < 3"
    ),
    "ce_reproducibility_mismatch": "SELECT stored_run AS r, cid AS s FROM con WHERE off",
    "blank_reference_convention_violated": "SELECT stored_run AS r, oid AS s FROM obs WHERE blank",
}


def finding(code: str, drop_unmanifested: bool = False) -> str:
    body = f"SELECT r AS run_manifest_id, '{code}' AS code, 'fail' AS severity, s AS subject FROM ({_FINDINGS[code]})"
    if drop_unmanifested and code != "missing_run_manifest":
        body += " WHERE r IN (SELECT run_manifest_id FROM man)"
    return body


ALL_FINDINGS = " UNION ALL ".join(finding(code, True) for code in _FINDINGS)
FINDING_CODES = tuple(_FINDINGS)
GATES = (
    f", fnd AS ({ALL_FINDINGS}), runs AS (SELECT DISTINCT run_manifest_id AS r FROM turns), "
    "gate AS (SELECT r AS run_manifest_id, CASE WHEN EXISTS (SELECT 1 FROM fnd WHERE fnd.run_manifest_id = r) THEN 'fail' ELSE 'pass' END AS gate_status, "
    "CASE WHEN r NOT IN (SELECT run_manifest_id FROM man) OR EXISTS (SELECT 1 FROM rst WHERE stored_run = r AND outcome = 'indeterminate') "
    "THEN 'incomplete' ELSE 'complete' END AS run_completion_status, "
    "CASE WHEN r IN (SELECT run_manifest_id FROM man) THEN (SELECT count(DISTINCT pair) FROM its WHERE stored_run = r) ELSE 0 END AS expected_pair_count, "
    "CASE WHEN r IN (SELECT run_manifest_id FROM man) THEN (SELECT count(*) FROM rst WHERE stored_run = r) ELSE 0 END AS observed_result_count, "
    "(SELECT count(*) FROM fnd WHERE fnd.run_manifest_id = r) AS finding_count FROM runs)"
)
SUMMARIES = (
    ", summ AS (SELECT stored_run AS run_manifest_id, 'page_model_result' AS subject_kind, subject AS subject_id, "
    "CASE WHEN blank THEN 1.0 ELSE w / length(text) END AS cer, w / length(text) / 2 AS wer, NULL::DOUBLE AS consensus_entropy "
    f"FROM (SELECT *, {occurrences('text', '@!#')}::DOUBLE AS w FROM obs) UNION ALL "
    "SELECT stored_run, 'fused_hypothesis', 'fused-' || unit, NULL, NULL, ce + CASE WHEN off THEN 1e-6 ELSE 0 END FROM con), "
    "ok AS (SELECT s.*, CASE WHEN consensus_entropy <= 0.1 THEN 'high_confidence' WHEN consensus_entropy >= 0.3 THEN 'low_confidence' "
    "WHEN consensus_entropy IS NOT NULL THEN 'medium_confidence' END AS confidence_band FROM summ s JOIN gate g USING (run_manifest_id) WHERE gate_status = 'pass')"
)
