"""Append-only ground truth: hash-chained events, active heads and the effective snapshot."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from concordis.functions.identity import canonical_value, record_sha256, seal
from concordis.operators.digest import set_digest
from concordis.schemas import RECORD_TYPES
from concordis.sources.stores import read_table, stored

RESOLVER_POLICY_VERSION = "gt_resolver_v1"


def _member(df: DataFrame, *names: str) -> Column:
    """``"name":value`` pieces of canonical JSON, in the given order."""
    parts: list[Column] = []
    for name in names:
        parts += [F.lit(f'{"," if parts else ""}"{name}":'), canonical_value(F.col(name), df.schema[name].dataType)]
    return F.concat(*parts)


def append_chains(actions: DataFrame, order_by: str = "sequence", heads: DataFrame | None = None) -> DataFrame:
    """Number, link and seal the events of each assertion's journal.

    Each event holds the full-record hash of the one before it, so a chain is worked
    through in order.  Rows stream through a task sorted by chain; only the last hash is
    kept, never a whole chain.  ``heads`` (see ``chain_heads``) names where stored chains
    end; their new events go on from there.
    """
    record = RECORD_TYPES["ground_truth_event"]
    schema = record.schema
    pieces = {
        "_head": _member(actions, "action", "actor_id", "approval_authorization_id", "assertion_id"),
        "_made": _member(actions, "created_at"),
        "_from": _member(actions, "event_source"),
        "_why": _member(actions, "reason"),
        "_next": _member(actions, "superseded_by_assertion_id"),
    }
    carried = [c for c in schema.names if c not in ("event_id", "sequence", "prior_event_hash")]
    arrow_schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def link(batches):
        chain, number, prior = None, 0, None
        for batch in batches:
            columns = batch.to_pydict()
            ids, numbers, priors, kept = [], [], [], []
            for i, assertion in enumerate(columns["assertion_id"]):
                if assertion != chain:
                    chain, number, prior = assertion, 0, None
                if columns["_stored_hash"][i] is not None:
                    number, prior = columns["_stored_sequence"][i] + 1, columns["_stored_hash"][i]
                    continue
                head, made, source = columns["_head"][i], columns["_made"][i], columns["_from"][i]
                tail = (
                    f'{source},"prior_event_hash":{json.dumps(prior)},{columns["_why"][i]},'
                    f'"sequence":{number},{columns["_next"][i]}}}'
                )
                digest = hashlib.sha256(f"{{{head},{tail}".encode()).hexdigest()
                event_id = f"ground_truth_event_sha256:{digest}"
                ids.append(event_id)
                numbers.append(number)
                priors.append(prior)
                kept.append(i)
                prior = hashlib.sha256(f'{{{head},{made},"event_id":"{event_id}",{tail}'.encode()).hexdigest()
                number += 1
            made_columns = {c: [columns[c][i] for i in kept] for c in carried}
            made_columns |= {"event_id": ids, "sequence": numbers, "prior_event_hash": priors}
            yield pa.RecordBatch.from_pydict({f.name: made_columns[f.name] for f in arrow_schema}, schema=arrow_schema)

    prepared = actions.select(
        *carried, F.col(order_by).alias("_order"), *[c.alias(n) for n, c in pieces.items()],
        F.lit(None).cast("long").alias("_stored_sequence"), F.lit(None).cast("string").alias("_stored_hash"),
    )
    if heads is not None:
        touched = heads.join(actions.select("assertion_id").distinct(), "assertion_id", "left_semi")
        prepared = prepared.unionByName(
            touched.select(
                "assertion_id", F.col("sequence").cast("long").alias("_stored_sequence"), F.col("record_sha256").alias("_stored_hash")
            ),
            allowMissingColumns=True,
        )
    # A stored head sorts before the new events of its chain.
    placed = prepared.withColumn("_new", F.col("_stored_hash").isNull())
    return (
        placed.repartition("assertion_id").sortWithinPartitions("assertion_id", "_new", "_order").mapInArrow(link, schema)
    )


HEADS = "assertion_id string, sequence long, record_sha256 string"


def chain_heads(events: DataFrame) -> DataFrame:
    """Last sequence of each chain and the full-record hash of that event."""
    record = RECORD_TYPES["ground_truth_event"]
    hashed = events.select(
        "assertion_id", F.col("sequence").cast("long").alias("sequence"), record_sha256(events, record.schema.names).alias("record_sha256")
    )
    return latest_heads(hashed)


def latest_heads(heads: DataFrame) -> DataFrame:
    return heads.groupBy("assertion_id").agg(
        F.max("sequence").alias("sequence"), F.max_by("record_sha256", "sequence").alias("record_sha256")
    )


def refused_actions(actions: DataFrame, assertions: DataFrame) -> DataFrame:
    """``actions`` with a ``refusal``: NULL where the action may be appended.

    A human workflow needs another approver than the assertion's author; an imported approval
    needs an authorization, and nothing else may name one.
    """
    authors = assertions.select("assertion_id", "author_actor_id").distinct()
    approves = F.col("action") == "approve"
    imported = approves & (F.col("event_source") == "dataset_import")
    named = F.col("approval_authorization_id").isNotNull()
    refusal = (
        F.when(imported & ~named, "authorization_missing")
        .when(~imported & named, "authorization_forbidden")
        .when(approves & (F.col("event_source") == "human_workflow") & F.col("actor_id").eqNullSafe(F.col("author_actor_id")), "self_approval")
    )
    return actions.join(authors, "assertion_id", "left").withColumn("refusal", refusal).drop("author_actor_id")


class ChainStore:
    """Stored chains that grow by calls: an events table and a table of heads, both parted by call.

    A call writes its events first and their heads last.  A call counts once its heads are
    there, so one that was cut off in between is done again under the same number and replaces what it left.
    Neither earlier events nor earlier hashes are read again; only heads are.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.events_path, self.heads_path = (f"{root.rstrip('/')}/{n}" for n in ("gt_events", "gt_heads"))

    def _heads(self) -> DataFrame:
        return read_table(self.spark, self.heads_path, HEADS + ", call int")

    def _write(self, rows: DataFrame, path: str, call: int) -> None:
        marked = rows.withColumn("call", F.lit(call))
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("call").parquet(path)

    def heads(self) -> DataFrame:
        return latest_heads(self._heads())

    def append(self, actions: DataFrame, assertions: DataFrame | None = None, order_by: str = "sequence") -> DataFrame:
        """Append what may be appended; returns the refused actions, which no chain gets."""
        call = (self._heads().agg(F.max("call")).head()[0] or 0) + 1
        judged = stored(refused_actions(actions, assertions)) if assertions is not None else actions.withColumn("refusal", F.lit(None).cast("string"))
        events = append_chains(judged.where(F.col("refusal").isNull()).drop("refusal"), order_by, self.heads())
        self._write(events, self.events_path, call)
        written = read_table(self.spark, self.events_path, [*RECORD_TYPES["ground_truth_event"].schema.fields, T.StructField("call", T.IntegerType())])
        self._write(chain_heads(written.where(F.col("call") == call)), self.heads_path, call)
        return judged.where(F.col("refusal").isNotNull())

    def events(self) -> DataFrame:
        """Events of all finished calls."""
        last = self._heads().agg(F.max("call")).head()[0] or 0
        schema = RECORD_TYPES["ground_truth_event"].schema
        rows = read_table(self.spark, self.events_path, [*schema.fields, T.StructField("call", T.IntegerType())])
        return rows.where(F.col("call") <= last).select(*schema.names)


def broken_links(events: DataFrame) -> DataFrame:
    """Events whose place in their chain does not hold.

    The previous event is found by an equality join on (assertion, sequence), so a long
    chain spreads over tasks.
    """
    declared = RECORD_TYPES["ground_truth_event"].schema.names
    hashed = events.withColumn("own_hash", record_sha256(events, declared))
    link = ["assertion_id", "sequence"]
    previous = hashed.groupBy("assertion_id", (F.col("sequence") + 1).alias("sequence")).agg(
        F.min("own_hash").alias("expected_prior"), F.max("own_hash").alias("other_prior")
    )
    repeated = events.groupBy(*link).agg(F.count(F.lit(1)).alias("copies"))
    problem = (
        F.when(F.col("copies") > 1, "duplicate_sequence")
        .when((F.col("sequence") < 0) | ((F.col("sequence") > 0) & F.col("expected_prior").isNull()), "missing_predecessor")
        .when(
            ~F.col("prior_event_hash").eqNullSafe(F.col("expected_prior"))
            & ~F.col("prior_event_hash").eqNullSafe(F.col("other_prior")),
            "prior_hash_mismatch",
        )
    )
    return (
        events.join(repeated, link)
        .join(previous, link, "left")
        .withColumn("problem", problem)
        .where(F.col("problem").isNotNull())
        .select("assertion_id", "sequence", "event_id", "problem")
    )


def self_approvals(events: DataFrame) -> DataFrame:
    """Human approvals by the actor who submitted the same assertion."""
    submitters = events.where(F.col("action") == "submit").select("assertion_id", "actor_id")
    return (
        events.where((F.col("action") == "approve") & (F.col("event_source") == "human_workflow"))
        .join(submitters, ["assertion_id", "actor_id"], "left_semi")
        .select("assertion_id", "event_id", "actor_id")
    )


def authorization_violations(events: DataFrame) -> DataFrame:
    """Imported approvals need an authorization; every other event must have none."""
    needs = (F.col("action") == "approve") & (F.col("event_source") == "dataset_import")
    has = F.col("approval_authorization_id").isNotNull()
    return events.where(needs != has).select(
        "assertion_id", "event_id", "action", "event_source",
        F.when(needs, "missing_authorization").otherwise("forbidden_authorization").alias("problem"),
    )


def active_heads(assertions: DataFrame, events: DataFrame) -> DataFrame:
    """Assertions whose latest event is an approval; a tied sequence goes by event id."""
    latest = events.groupBy("assertion_id").agg(
        F.max_by("action", F.struct("sequence", "event_id")).alias("latest_action")
    )
    approved = latest.where(F.col("latest_action") == "approve").select("assertion_id")
    return assertions.join(approved, "assertion_id", "left_semi")


def conflicted_units(heads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Units with several active heads for one role and guideline; time never decides."""
    return (
        heads.groupBy(*by, "evaluation_unit_id", "role", "guideline_id")
        .agg(F.count(F.lit(1)).alias("heads"))
        .where(F.col("heads") > 1)
        .select(*by, "evaluation_unit_id")
        .distinct()
    )


def unavailable_units(assertions: DataFrame, heads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    unit = [*by, "evaluation_unit_id"]
    return assertions.select(*unit).distinct().join(heads, unit, "left_anti")


def snapshot_entries(assertions: DataFrame, events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Members of the effective snapshot, one row per (kind, id).

    ``by`` names assertion columns that part the journal into snapshots, such as the run.
    """
    heads = active_heads(assertions, events)
    used = events.select("assertion_id", "event_id").join(heads.select(*by, "assertion_id"), "assertion_id")
    entry = lambda df, kind, column: df.select(*by, F.lit(kind).alias("kind"), F.col(column).alias("id")).distinct()
    return (
        entry(heads, "assertion", "assertion_id")
        .unionByName(entry(used, "event", "event_id"))
        .unionByName(entry(conflicted_units(heads, by), "conflicted_unit", "evaluation_unit_id"))
        .unionByName(entry(unavailable_units(assertions, heads, by), "unavailable_unit", "evaluation_unit_id"))
    )


_SNAPSHOT_FIELDS = {
    "assertion_ids": "assertion",
    "event_ids": "event",
    "authorization_ids": "authorization",
    "conflicted_evaluation_unit_ids": "conflicted_unit",
    "unavailable_evaluation_unit_ids": "unavailable_unit",
}


def snapshot_record(entries: DataFrame, by: tuple[str, ...] = (), policy: str = RESOLVER_POLICY_VERSION) -> DataFrame:
    """The sealed snapshot.  Each id list is one set digest; its members are the entries."""

    def field(kind):
        member = F.when(F.col("kind") == kind, F.col("id"))
        return F.when(F.count(member) > 0, F.array(set_digest(member))).otherwise(F.array().cast("array<string>"))

    record = entries.groupBy(*by).agg(*[field(kind).alias(name) for name, kind in _SNAPSHOT_FIELDS.items()])
    return seal(record.withColumn("resolver_policy_version", F.lit(policy)), "effective_gt_snapshot")


def gt_references(units: DataFrame, assertions: DataFrame, events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The one usable reference of every unit, or why there is none.

    ``by`` names columns of units and assertions that part them, such as the run: runs over the
    same units then do not see each other's assertions.
    """
    heads = active_heads(assertions, events)
    unit = [*by, "evaluation_unit_id"]
    chosen = (
        heads.groupBy(*unit, "role", "guideline_id")
        .agg(F.countDistinct("assertion_id").alias("heads"), F.min("assertion_id").alias("assertion_id"))
        .groupBy(*unit)
        .agg(F.max("heads").alias("heads"), F.min("assertion_id").alias("assertion_id"))
    )
    usable = F.col("heads") == 1
    texts = assertions.select(*by, "assertion_id", "target_state", "text").dropDuplicates([*by, "assertion_id"])
    availability = (
        F.when(F.col("heads") > 1, "conflicted")
        .when(F.col("heads").isNull(), "unavailable")
        .when(F.col("target_state") == "fully_illegible", "excluded_fully_illegible")
        .otherwise("available")
    )
    return (
        units.select(*unit).distinct()
        .join(chosen, unit, "left")
        .withColumn("assertion_id", F.when(usable, F.col("assertion_id")))
        .join(texts, [*by, "assertion_id"], "left")
        .select(
            *unit, availability.alias("gt_availability"),
            F.when(availability == "available", F.coalesce("text", F.lit(""))).alias("gt_text"),
            F.col("assertion_id").alias("gt_assertion_id"),
        )
    )
