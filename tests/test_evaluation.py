import math

import pytest
from pyspark.sql import functions as F

from concordis.functions.identity import attempt_id, seal
from concordis.operators import ground_truth, manifest, report
from concordis.plans import evaluation as ev
from concordis.schemas import ATTEMPT_EVENTS
from concordis.sources import corpus, stores

TEXTS = ["the quick brown fox", "the quick brown fax"]
AT = "2026-08-31T00:00:00Z"
SETTINGS = {"dataset_id": "d", "dataset_version": "1", "language": "en"}


def build_inputs(spark):
    header = bytes.fromhex("89504E470D0A1A0A0000000D4948445200000010000000200802000000")
    files = spark.createDataFrame(
        [(f"file:/c/D-COMP/{i}.png", f"D-COMP/{i}.png", header + bytes([i]), 30) for i in range(3)],
        "path string, dataset_item_id string, content binary, length bigint",
    )
    pages = corpus.source_pages(files, SETTINGS)
    units = corpus.evaluation_units(pages, SETTINGS)
    variants = corpus.input_variants(pages, units, corpus.decode_provenances(pages, "source", "1"))
    roster = manifest.roster_members(
        spark.range(2).select(
            F.lit("run").alias("run_key"), F.col("id").cast("int").alias("position"), F.lit("e").alias("registry_entry_id"),
            F.lit("stub-model-v1").alias("exact_model_id"), F.lit("stub").alias("provider"), F.lit(None).cast("string").alias("router"),
            F.lit("acct").alias("billing_account_id"), F.lit("stub").alias("adapter_id"), F.lit("1").alias("adapter_version"),
            F.concat(F.lit("prompt-"), "id").alias("prompt_template_id"), F.lit("1" * 64).alias("prompt_sha256"),
            F.create_map().cast("map<string,string>").alias("hyperparameters"),
        )
    )
    run_units = variants.select(F.lit("run").alias("run_key"), "evaluation_unit_id", "page_input_variant_id")
    text = lambda v: F.lit(v).cast("string")
    fixed = {
        c: text(c) for c in (
            "schema_version", "dataset_id", "dataset_version", "dataset_split_id", "config_snapshot_sha256", "taxonomy_registry_id",
            "assessment_policy_id", "alignment_policy_id", "eligibility_policy_id", "fusion_policy_id", "metric_policy_id", "anomaly_policy_id",
            "analysis_policy_id", "contamination_register_id", "pricing_registry_snapshot_id", "model_registry_snapshot_id",
        )
    }
    settings = spark.range(1).select(F.lit("run").alias("run_key")).withColumns(
        {
            **fixed, "created_at": text(AT), "corpus_evidence_kind": text("natural"), "split_role": text("diagnostic"),
            "calibration_selection_id": text(None), "budget_policy": F.create_map(F.lit("run_ceiling_usd"), F.lit("1.00")),
            "model_corpus_match": F.lit(False), "model_corpus_match_policy_id": text(None), "human_override_ids": F.array().cast("array<string>"),
        }
    )
    manifests = manifest.run_manifests(settings, run_units, roster)
    run_id = manifests.head().run_manifest_id
    in_run = lambda df: df.withColumn("run_manifest_id", F.lit(run_id))
    intents = manifest.dispatch_intents(in_run(variants), in_run(roster))
    first = F.lit(1)
    number = F.xxhash64("dispatch_intent_id")
    aid = attempt_id(F.col("dispatch_intent_id"), first)
    started = intents.select(
        "run_manifest_id", F.lit("attempt_started").alias("event_type"), "dispatch_intent_id", first.alias("attempt_number"),
        aid.alias("attempt_id"), number.alias("journal_seq"),
    )
    parsed = F.struct(
        F.lit("transcription").alias("kind"), F.when(F.col("ordinal") == 0, TEXTS[0]).otherwise(TEXTS[1]).alias("text"),
        F.lit("p").alias("parser_version"), F.lit(True).alias("complete"),
    )
    finished = intents.select(
        "run_manifest_id", F.lit("attempt_finished").alias("event_type"), aid.alias("attempt_id"), (number + 1).alias("journal_seq"),
        F.lit("response_received").alias("outcome"), parsed.alias("parsed_output"), F.lit(5.0).alias("measured_duration_ms"),
        F.struct(F.lit("reported").alias("availability"), F.lit("0.005").cast("decimal(18,6)").alias("value")).alias("actual_cost_usd"),
    )
    events = spark.createDataFrame([], ATTEMPT_EVENTS).withColumn("run_manifest_id", F.lit(None).cast("string"))
    events = events.unionByName(started, allowMissingColumns=True).unionByName(finished, allowMissingColumns=True)
    claims = seal(
        units.select(
            "evaluation_unit_id", F.lit("gold_full").alias("role"), F.lit("transcribable").alias("target_state"), F.lit(TEXTS[0]).alias("text"),
            F.lit("g").alias("guideline_id"), F.lit("s").alias("source"), F.lit("one").alias("author_actor_id"), F.lit(AT).alias("created_at"),
            text(None).alias("source_artifact_sha256"),
        ),
        "ground_truth_assertion",
    )
    actions = claims.select("assertion_id", F.posexplode(F.array(F.lit("submit"), F.lit("approve"))).alias("sequence", "action")).select(
        "assertion_id", "sequence", "action", F.when(F.col("action") == "submit", "one").otherwise("two").alias("actor_id"),
        F.lit("human_workflow").alias("event_source"), text(None).alias("approval_authorization_id"), text(None).alias("reason"),
        text(None).alias("superseded_by_assertion_id"), F.lit(AT).alias("created_at"),
    )
    return ev.RunInputs(
        manifests, pages, units, in_run(variants), in_run(roster), intents, events, in_run(claims), ground_truth.append_chains(actions)
    )


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("runs"))
    inputs = build_inputs(spark)
    ev.evaluate(inputs, root, AT)
    return root, spark.createDataFrame([(inputs.manifests.head().run_manifest_id,)], "run_manifest_id string")


def test_clean_run_passes_and_reports(spark, run, tmp_path):
    root, runs = run
    reports = ev.validate(spark, root, runs)
    gate = reports.head()
    assert (gate.gate_status, gate.run_completion_status, gate.expected_pair_count, gate.observed_result_count) == ("pass", "complete", 6, 6)
    summaries, refused = ev.analyze(spark, root, reports)
    rows = summaries.collect()
    assert refused.count() == 0 and len(rows) == 9
    fused = [r for r in rows if r.subject_kind == "fused_hypothesis"]
    assert all(math.isclose(r.consensus_entropy, 1 / 19) and r.confidence_band == "high_confidence" and r.cer == 0.0 for r in fused)
    assert sorted(round(r.cer, 6) for r in rows if r.subject_kind == "page_model_result") == [0.0] * 3 + [round(1 / 19, 6)] * 3
    lines = report.report_lines(summaries)
    report.write_reports(lines, str(tmp_path / "report"))
    text = [r.value for r in spark.read.text(str(tmp_path / "report")).select("value").collect()]
    assert sum("page_model_result" in t for t in text) == 6 and "fused_hypothesis        0.0000    0.0000    0.0526  high_confidence" in text


def test_observations_name_their_inputs(spark, run):
    root, _ = run
    obs = stores.live(spark.read.parquet(f"{root}/benchmark_observations"))
    fused = obs.where("subject_kind = 'fused_hypothesis'").head()
    assert fused.quorum_size == 2 and fused.eligible_hypothesis_count == 2 and fused.roster_member_config_id is None
    assert str(fused.attributed_cost_usd) == "0.010000" and fused.attributed_latency_ms == 10.0
    assert obs.select("benchmark_observation_id").distinct().count() == 9
    assert obs.where("gt_availability <> 'available'").count() == 0


FAULTS = {
    "missing_page_model_result": ("page_model_results", lambda df: df.limit(5)),
    "duplicate_page_model_result": ("page_model_results", lambda df: df.unionByName(df.limit(1))),
    "orphan_page_model_result": ("dispatch_intents", lambda df: df.limit(5)),
    "duplicate_dispatch_intent": ("dispatch_intents", lambda df: df.unionByName(df.limit(1))),
    "run_manifest_id_mismatch": ("benchmark_observations", lambda df: df.withColumn("run_manifest_id", F.lit("other"))),
    "attempt_id_mismatch": ("attempt_events", lambda df: df.withColumn("attempt_id", F.concat("attempt_id", F.lit("x")))),
    "impossible_attempt_sequence": ("attempt_events", lambda df: df.withColumn("attempt_number", F.col("attempt_number") + 1)),
    "success_missing_selected_attempt": ("page_model_results", lambda df: df.withColumn("selected_attempt_id", F.lit(None).cast("string"))),
    "non_success_has_parsed_text": ("page_model_results", lambda df: df.withColumn("terminal_outcome", F.lit("truncated"))),
    "observation_references_unknown_result": ("benchmark_observations", lambda df: df.withColumn("subject_id", F.lit("nowhere"))),
    "consensus_references_missing_result": ("page_model_results", lambda df: df.withColumn("parsed_text", F.lit(None).cast("string"))),
    "ce_reproducibility_mismatch": ("consensus_results", lambda df: df.withColumn("consensus_entropy", F.col("consensus_entropy") + 1e-9)),
    "blank_reference_convention_violated": (
        "benchmark_observations",
        lambda df: df.withColumns({"reference_length_chars": F.lit(0).cast("bigint"), "cer": F.lit(2.0), "char_insertions": F.lit(None).cast("bigint")}),
    ),
    "missing_run_manifest": ("run_manifests", lambda df: df.limit(0)),
}


def test_each_fault_is_found(spark, run):
    """One copy of the run per fault, all checked at once."""
    root, _ = run
    tables = ("run_manifests", "dispatch_intents", "attempt_events", "page_model_results", "consensus_results", "benchmark_observations")
    copies = {}
    for table in tables:
        stored = stores.live(spark.read.parquet(f"{root}/{table}"))
        for code, (damaged_table, damage) in FAULTS.items():
            copy = stored.withColumns({"stored_run": F.lit(code), "run_manifest_id": F.lit(code)})
            copy = damage(copy) if table == damaged_table else copy
            copies[table] = copies[table].unionByName(copy) if table in copies else copy
        copies[table] = stores.stored(copies[table].coalesce(2))
    runs = spark.createDataFrame([(code,) for code in FAULTS], "run_manifest_id string")
    gates = {r.run_manifest_id: r for r in ev.validate(spark, root, runs, copies).collect()}
    for code in FAULTS:
        assert gates[code].gate_status == "fail" and code in [c.code for c in gates[code].finding_counts], code
    blank = gates["missing_run_manifest"]
    assert blank.run_completion_status == "incomplete" and len(blank.finding_counts) == 1
    assert (blank.expected_pair_count, blank.observed_result_count) == (0, 0)


def test_refused_runs_say_why(spark, run):
    root, runs = run
    reports = ev.validate(spark, root, runs).withColumn("gate_status", F.lit("fail"))
    summaries, refused = ev.analyze(spark, root, reports)
    assert summaries.count() == 0 and refused.head().reason == "gate_status=fail"
    known = stores.live(spark.read.parquet(f"{root}/run_manifests"))
    no_report = report.refused_runs(runs, known, reports.limit(0)).head()
    assert no_report.reason == "missing_postprocess_report"
    assert report.refused_runs(runs, known.limit(0), reports).head().reason == "missing_run_manifest"
