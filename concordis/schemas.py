"""Record schemas and the rule that picks each record's identity columns.

A record's identity is every declared column except its own id and the columns named
in ``audit`` (locations, timestamps and values derived from the rest).  The names and
types below are fixed values: stored runs use them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = "DECIMAL(28,6)"


@dataclass(frozen=True)
class RecordType:
    name: str
    id_column: str
    ddl: str
    audit: tuple[str, ...] = field(default=())

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(f"{self.id_column} STRING, {self.ddl}")

    @property
    def identity_columns(self) -> tuple[str, ...]:
        skipped = {self.id_column, *self.audit}
        return tuple(name for name in self.schema.names if name not in skipped)


_TRANSFORMS = "ARRAY<STRUCT<step_id: STRING, algorithm_id: STRING, algorithm_version: STRING, parameters: MAP<STRING,STRING>>>"
_PERTURBATION = (
    "STRUCT<natural_source_page_id: STRING, natural_source_sha256: STRING, recipe_id: STRING, recipe_version: STRING, "
    "generator_id: STRING, generator_version: STRING, ordered_parameters: ARRAY<STRUCT<name: STRING, value: STRING>>, "
    "random_seed: STRING, severity: STRING, intended_family: STRING, intended_condition: STRING, "
    f"transform_chain: {_TRANSFORMS}>"
)
_POLICIES = "alignment_policy_id STRING, eligibility_policy_id STRING, fusion_policy_id STRING, metric_policy_id STRING, anomaly_policy_id STRING, analysis_policy_id STRING"

RECORD_TYPES: dict[str, RecordType] = {
    record.name: record
    for record in (
        RecordType(
            "source_page", "source_page_id",
            "schema_version STRING, dataset_id STRING, dataset_version STRING, dataset_item_id STRING, source_uri STRING, "
            "source_sha256 STRING, media_type STRING, byte_size BIGINT, width_px INT, height_px INT, color_mode STRING, "
            "bit_depth INT, orientation_metadata STRING, source_genre STRING, license_id STRING",
            audit=("source_uri", "media_type", "byte_size", "width_px", "height_px", "color_mode", "bit_depth",
                   "orientation_metadata", "source_genre", "license_id"),
        ),
        RecordType(
            "evaluation_unit", "evaluation_unit_id",
            "schema_version STRING, source_page_id STRING, selector MAP<STRING,STRING>, layout_complexity STRING, "
            "reading_order_policy_id STRING, language STRING, mixed_language BOOLEAN, evaluation_scope_status STRING",
            audit=("language", "mixed_language", "evaluation_scope_status"),
        ),
        RecordType(
            "decode_provenance", "decode_provenance_id",
            "source_page_id STRING, decoder_id STRING, decoder_version STRING, original_media_type STRING, "
            "original_bit_depth INT, original_color_mode STRING, original_orientation_metadata STRING, output_encoding STRING",
        ),
        RecordType(
            "page_input_variant", "page_input_variant_id",
            "schema_version STRING, evaluation_unit_id STRING, source_page_id STRING, variant_kind STRING, mitigation_kind STRING, "
            "artifact_uri STRING, artifact_sha256 STRING, media_type STRING, byte_size BIGINT, width_px INT, height_px INT, "
            f"decode_provenance_id STRING, transform_chain {_TRANSFORMS}, preprocess_policy_id STRING, "
            f"perturbation_provenance {_PERTURBATION}",
            audit=("artifact_uri", "mitigation_kind"),
        ),
        RecordType(
            "baseline_transcription", "baseline_transcription_id",
            "evaluation_unit_id STRING, baseline_kind STRING, text STRING, source STRING, source_artifact_sha256 STRING, "
            "import_provenance_id STRING",
        ),
        RecordType(
            "detector_evidence", "evidence_id",
            "evaluation_unit_id STRING, page_input_variant_id STRING, detector_id STRING, detector_version STRING, "
            "measurement_name STRING, value VARIANT, unit STRING, assessment_state STRING, artifact_uri STRING, artifact_sha256 STRING",
            audit=("artifact_uri",),
        ),
        RecordType(
            "failure_assessment", "failure_assessment_id",
            "evaluation_unit_id STRING, condition_code STRING, state STRING, severity STRING, confidence DOUBLE, provenance STRING, "
            "evidence_ids ARRAY<STRING>, policy_version STRING, actor STRING, reason STRING, supersedes_assessment_id STRING, "
            "created_at STRING, override_config_sha256 STRING",
            audit=("created_at",),
        ),
        RecordType(
            "roster_member_config", "roster_member_config_id",
            "registry_entry_id STRING, exact_model_id STRING, provider STRING, router STRING, billing_account_id STRING, "
            "adapter_id STRING, adapter_version STRING, prompt_template_id STRING, prompt_sha256 STRING, "
            "hyperparameters MAP<STRING,STRING>, position INT",
        ),
        RecordType(
            "run_manifest", "run_manifest_id",
            "schema_version STRING, created_at STRING, dataset_id STRING, dataset_version STRING, corpus_evidence_kind STRING, "
            "dataset_split_id STRING, split_role STRING, calibration_selection_id STRING, evaluation_unit_ids ARRAY<STRING>, "
            "page_input_variant_ids ARRAY<STRING>, roster ARRAY<STRUCT<registry_entry_id: STRING, exact_model_id: STRING, "
            "provider: STRING, router: STRING, billing_account_id: STRING, adapter_id: STRING, adapter_version: STRING, "
            "prompt_template_id: STRING, prompt_sha256: STRING, hyperparameters: MAP<STRING,STRING>, position: INT>>, "
            "config_snapshot_sha256 STRING, taxonomy_registry_id STRING, assessment_policy_id STRING, "
            f"{_POLICIES}, contamination_register_id STRING, pricing_registry_snapshot_id STRING, "
            "model_registry_snapshot_id STRING, budget_policy MAP<STRING,STRING>, model_corpus_match BOOLEAN, "
            "model_corpus_match_policy_id STRING, human_override_ids ARRAY<STRING>",
            audit=("created_at",),
        ),
        RecordType(
            "dataset_split", "dataset_split_id",
            "dataset_id STRING, dataset_version STRING, algorithm_id STRING, algorithm_version STRING, hash_rule STRING, "
            "seed STRING, assignments ARRAY<ARRAY<STRING>>",
        ),
        RecordType(
            "calibration_selection", "calibration_selection_id",
            "dataset_split_id STRING, calibration_run_manifest_id STRING, calibration_gt_snapshot_id STRING, "
            "calibration_observation_store_sha256 STRING, selected_comparator_roster_member_config_id STRING, "
            f"selection_metric STRING, selection_rule STRING, {_POLICIES}, bootstrap_algorithm_id STRING, "
            "bootstrap_seed STRING, bootstrap_replicates INT",
        ),
        RecordType(
            "dispatch_intent", "dispatch_intent_id",
            "run_manifest_id STRING, page_input_variant_id STRING, evaluation_unit_id STRING, roster_member_config_id STRING, "
            "dispatch_pair_id STRING, ordinal INT, planned_max_attempts INT",
            audit=("dispatch_pair_id",),
        ),
        RecordType(
            "raw_provider_envelope", "raw_provider_envelope_id",
            "sanitized_envelope_sha256 STRING, sanitization_policy_version STRING, artifact_uri STRING",
            audit=("artifact_uri",),
        ),
        RecordType(
            "approval_authorization", "approval_authorization_id",
            "dataset_id STRING, dataset_version STRING, authority_actor_id STRING, authorization_basis STRING, "
            "evidence_uri STRING, evidence_sha256 STRING, verified_by STRING, verified_at STRING",
            audit=("evidence_uri", "verified_at"),
        ),
        RecordType(
            "ground_truth_assertion", "assertion_id",
            "evaluation_unit_id STRING, role STRING, target_state STRING, text STRING, guideline_id STRING, source STRING, "
            "author_actor_id STRING, created_at STRING, source_artifact_sha256 STRING",
            audit=("created_at",),
        ),
        RecordType(
            "ground_truth_event", "event_id",
            "sequence BIGINT, prior_event_hash STRING, assertion_id STRING, action STRING, actor_id STRING, event_source STRING, "
            "approval_authorization_id STRING, reason STRING, superseded_by_assertion_id STRING, created_at STRING",
            audit=("created_at",),
        ),
        RecordType(
            "effective_gt_snapshot", "effective_gt_snapshot_id",
            "assertion_ids ARRAY<STRING>, event_ids ARRAY<STRING>, authorization_ids ARRAY<STRING>, "
            "conflicted_evaluation_unit_ids ARRAY<STRING>, unavailable_evaluation_unit_ids ARRAY<STRING>, "
            "resolver_policy_version STRING",
        ),
        RecordType(
            "page_model_result", "page_model_result_id",
            "dispatch_pair_id STRING, dispatch_intent_id STRING, run_manifest_id STRING, evaluation_unit_id STRING, "
            "page_input_variant_id STRING, roster_member_config_id STRING, selected_attempt_id STRING, attempt_ids ARRAY<STRING>, "
            "terminal_outcome STRING, parsed_text STRING, eligibility STRING, ineligibility_reasons ARRAY<STRING>, "
            f"total_cost_usd {MONEY}, total_measured_duration_ms DOUBLE, created_at STRING",
            audit=("created_at",),
        ),
        RecordType(
            "consensus_result", "consensus_result_id",
            "run_manifest_id STRING, evaluation_unit_id STRING, eligible_page_model_result_ids ARRAY<STRING>, quorum_size INT, "
            "eligible_hypothesis_count INT, consensus_entropy DOUBLE, alignment_artifact_sha256 STRING, "
            "alignment_artifact_uri STRING, text_policy_id STRING, alignment_policy_id STRING, created_at STRING",
            audit=("alignment_artifact_uri", "created_at"),
        ),
        RecordType(
            "fused_hypothesis", "fused_hypothesis_id",
            "run_manifest_id STRING, evaluation_unit_id STRING, consensus_result_id STRING, text STRING, fusion_policy_id STRING, "
            "alignment_artifact_sha256 STRING, alignment_artifact_uri STRING, created_at STRING",
            audit=("alignment_artifact_uri", "created_at"),
        ),
        RecordType(
            "benchmark_observation", "benchmark_observation_id",
            "run_manifest_id STRING, dataset_id STRING, dataset_version STRING, corpus_evidence_kind STRING, split STRING, "
            "evaluation_unit_id STRING, source_page_id STRING, source_sha256 STRING, page_input_variant_id STRING, "
            "input_variant_sha256 STRING, subject_kind STRING, subject_id STRING, roster_member_config_id STRING, "
            "exact_model_id STRING, provider STRING, router STRING, prompt_sha256 STRING, hyperparameters_sha256 STRING, "
            "adapter_version STRING, challenge_seed_family STRING, failure_condition_codes ARRAY<STRING>, "
            "evaluation_scope_status STRING, layout_complexity STRING, language STRING, mixed_language BOOLEAN, "
            "gt_snapshot_id STRING, gt_assertion_id STRING, gt_availability STRING, metric_policy_id STRING, "
            "hypothesis_text_sha256 STRING, reference_length_chars BIGINT, reference_length_words BIGINT, "
            "char_substitutions BIGINT, char_insertions BIGINT, char_deletions BIGINT, word_substitutions BIGINT, "
            "word_insertions BIGINT, word_deletions BIGINT, cer DOUBLE, wer DOUBLE, consensus_entropy DOUBLE, quorum_size INT, "
            f"eligible_hypothesis_count INT, outcome STRING, attributed_cost_usd {MONEY}, attributed_latency_ms DOUBLE, "
            "resource_attribution STRING, created_at STRING",
            audit=("created_at",),
        ),
    )
}

_REPORTED_MONEY = f"STRUCT<availability: STRING, value: {MONEY}>"
_REPORTED_COUNT = "STRUCT<availability: STRING, value: BIGINT>"
_REPORTED_MS = "STRUCT<availability: STRING, value: DOUBLE>"
_ENVELOPE = (
    "STRUCT<envelope_sha256: STRING, cas_uri: STRING, compressed_byte_size: BIGINT, uncompressed_byte_size: BIGINT, "
    "media_type: STRING, sanitization_policy_version: STRING, preview_utf8: STRING>"
)

# Schemas below are kept as text, since parsing one needs a running session.
# One row per journal event; columns of the other event kinds are NULL.
ATTEMPT_EVENTS = (
    "journal_seq BIGINT, event_type STRING, event_id STRING, dispatch_intent_id STRING, dispatch_pair_id STRING, "
    "attempt_id STRING, attempt_number INT, provider_idempotency_key STRING, reservation_ids ARRAY<STRING>, "
    f"maximum_exposure_usd {MONEY}, request_sha256 STRING, request_envelope {_ENVELOPE}, started_at STRING, "
    f"finished_at STRING, outcome STRING, http_status {_REPORTED_COUNT}, provider_finish_reason STRING, error_code STRING, "
    f"error_message_sanitized STRING, tokens_input {_REPORTED_COUNT}, tokens_output {_REPORTED_COUNT}, "
    f"tokens_thinking {_REPORTED_COUNT}, provider_duration_ms {_REPORTED_MS}, measured_duration_ms DOUBLE, "
    f"actual_cost_usd {_REPORTED_MONEY}, pricing_snapshot_id STRING, raw_envelope {_ENVELOPE}, "
    "parsed_output STRUCT<kind: STRING, text: STRING, parser_version: STRING, complete: BOOLEAN>, reason STRING, refused_at STRING"
)

LEDGER_EVENTS = (
    f"seq BIGINT, ledger STRING, reservation_id STRING, kind STRING, amount_usd {MONEY}"
)
LEDGERS = f"ledger STRING, ceiling_usd {MONEY}"
RESERVE_REQUESTS = (
    f"batch_id STRING, label STRING, amount_usd {MONEY}, ledger_names ARRAY<STRING>"
)
FINDINGS = "run_manifest_id STRING, code STRING, severity STRING, subject STRING"
HYPOTHESES = (
    "run_manifest_id STRING, evaluation_unit_id STRING, page_model_result_id STRING, position INT, text STRING"
)
VERIFIED_MODEL_REGISTRY = (
    "registry_entry_id STRING, roster_member_id STRING, provider STRING, billing_account_id STRING, router STRING, "
    "exact_model_id STRING, endpoint_or_sdk STRING, adapter_id STRING, adapter_version STRING, supports_image_input BOOLEAN, "
    "supported_media_types ARRAY<STRING>, max_image_bytes BIGINT, max_width_px INT, max_height_px INT, "
    "context_limit_tokens BIGINT, output_limit_tokens BIGINT, reports_token_usage BOOLEAN, reports_provider_duration BOOLEAN, "
    "rate_limit_policy MAP<STRING,STRING>, pricing_snapshot_id STRING, limits_source STRING, pricing_source STRING, "
    "verified_at STRING, credential_probe STRING"
)
