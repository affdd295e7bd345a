"""Run manifests, rosters, dataset splits and the dispatch intents planned from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordis.functions.identity import dispatch_pair_id, seal
from concordis.operators.digest import set_digest
from concordis.operators.journal import MAX_ATTEMPTS
from concordis.schemas import RECORD_TYPES


def roster_members(members: DataFrame) -> DataFrame:
    return seal(members, "roster_member_config")


def dataset_splits(assignments: DataFrame, keys: tuple[str, ...], settings: DataFrame) -> DataFrame:
    """One sealed split per key; its assignments enter as the digest of (unit, role) pairs."""
    pair = F.concat_ws("\t", "evaluation_unit_id", "role")
    pairs = assignments.select(*keys, pair.alias("pair")).distinct()
    digests = pairs.groupBy(*keys).agg(F.array(F.array(set_digest(F.col("pair")))).alias("assignments"))
    return seal(settings.join(digests, list(keys)), "dataset_split")


def run_manifests(settings: DataFrame, run_units: DataFrame, roster: DataFrame, run_key: str = "run_key") -> DataFrame:
    """One sealed manifest per run.

    ``roster`` (a few configured members per run) is nested in position order by identity
    columns.  ``run_units`` has no size bound, so its ids enter as set digests at every size.
    """
    member_columns = RECORD_TYPES["roster_member_config"].identity_columns
    # Settings are maps, which have no order of their own, so the sort names the position.
    by_position = lambda a, b: a["position"] - b["position"]
    ordered = F.array_sort(F.collect_list(F.struct(*member_columns)), by_position)
    nested = roster.groupBy(run_key).agg(ordered.alias("roster"))
    ids = {"evaluation_unit_ids": "evaluation_unit_id", "page_input_variant_ids": "page_input_variant_id"}
    as_set = lambda c: F.array(set_digest(F.col(c)))
    record = settings.join(nested, run_key)
    for name, c in ids.items():
        distinct = run_units.select(run_key, c).distinct()
        record = record.join(distinct.groupBy(run_key).agg(as_set(c).alias(name)), run_key)
    return seal(record, "run_manifest")


def dispatch_intents(variants: DataFrame, roster: DataFrame, planned_max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One sealed intent per input variant and roster member of the same run.

    Both sides carry ``run_manifest_id``.  The result is stored: later stages take the
    expected pairs from it and never from a product of their own.
    """
    planned = variants.select("run_manifest_id", "page_input_variant_id", "evaluation_unit_id").join(
        roster.select("run_manifest_id", "roster_member_config_id", F.col("position").alias("ordinal")), "run_manifest_id"
    )
    pair = dispatch_pair_id(
        F.col("run_manifest_id"), F.col("page_input_variant_id"), F.col("roster_member_config_id")
    )
    return seal(
        planned.withColumns({"dispatch_pair_id": pair, "planned_max_attempts": F.lit(planned_max_attempts)}),
        "dispatch_intent",
    )
