"""Conversation prefix trie, rolled up by centroid decomposition.

A node is a different sequence of first turns (role and text); the root is the empty one.  A turn's hash at its
position is cut into four parts of 32 bits that are summed along the conversation; depth and sums name the
node (128 bits), so prefixes need no texts and no walk along a conversation, however long it is.

Totals over subtrees come from a decomposition of the forest of parent edges.  A component's
centroid is its deepest node with over half of the component's weight below it (the weight of a node is its
number of members, and a subtree's weight follows from the lengths of its members' conversations).  What lies
below the centroid is added up, centroid included, and the sum goes to the centroid and to every node on the path
from it to the component's top.  Then the centroid goes: the subtrees of its children and what is left above
are components of at most half the weight.  Each pair of a node and one below it is
counted once, at the centroid that first parts them.  Paths are looked up in the conversation of a
node's smallest member, so a round is a few joins at any depth of the trie.  Components of at most ``SMALL``
weight go on the same way inside a task, many to a task.

Ids of the members that end at a node are numbered by ranges and joined to chunks first; a node's chunks
are hashed in order, one after the other, since SHA-256 is sequential.

Cases: rows without conv_id take no part; a null turn comes first; null role or text counts as empty; turns with one number go by
the MD5 of role and text; repeated rows are turns of their own; an empty table gives no rows, not even the root.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordis.llm.common import WORD, numbered, saved, table, whole
from concordis.session import spread

#: Weight up to which a component is finished inside a task.
SMALL = 256
CHUNK = 4096
PARTS = ("part_1", "part_2", "part_3", "part_4")
#: Conversations of one block share the beginning of its first one, up to this many turns less one.
BLOCK, SHARED = 20, 4


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0), mark (the hash of role and text) and words."""
    role, text = whole(F.col("role")), whole(F.col("text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.md5(role), text)).alias("mark"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    placed = numbered(turns, ("turn", "mark"), ("conv_id",))
    return saved(placed.select("conv_id", F.col("row_no").alias("at"), "mark", "words"), "turns")


def counted(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))


def rebuilt(turns: DataFrame, block: int = BLOCK, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths after each conversation took over the beginning of its block's first one.

    Of conversation c the first crc32(c) % ``shared`` turns are replaced by as many of c - c % ``block``.
    """
    lengths = counted(turns)
    replaced = F.crc32(F.col("conv_id").cast("string")) % shared
    asked = lengths.withColumn("first", F.col("conv_id") - F.col("conv_id") % block).withColumn("replaced", replaced)
    given = lengths.select(F.col("conv_id").alias("first"), F.col("length").alias("there"))
    plans = saved(
        asked.join(given, "first", "left")
        .withColumn("taken", F.least("replaced", F.coalesce("there", F.lit(0))))
        .select(
            "conv_id", "first", "replaced", "taken",
            (F.col("taken") + F.greatest(F.lit(0), F.col("length") - F.col("replaced"))).alias("length"),
        ),
        "plans",
    )
    own = turns.join(plans, "conv_id").where(F.col("at") >= F.col("replaced")).select(
        "conv_id", (F.col("at") - F.col("replaced") + F.col("taken")).alias("at"), "mark", "words", "length"
    )
    heads = turns.where(F.col("at") < shared - 1).withColumnRenamed("conv_id", "first")
    taken = heads.join(plans, "first").where(F.col("at") < F.col("taken")).select("conv_id", "at", "mark", "words", "length")
    return own.unionByName(taken), plans.select("conv_id", "length")


def _name(depth, sums) -> F.Column:
    return F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]))


def paths(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, length, depth, node, parent and words: the nodes that each conversation passes, root first; stored."""
    digest = F.md5(F.concat_ws(",", "mark", F.col("at").cast("string")))
    parts = {p: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i, p in enumerate(PARTS)}
    summed = numbered(turns.withColumns(parts), ("at",), ("conv_id",), PARTS)
    before = [F.col(f"{p}_before") for p in PARTS]
    depth = F.col("at") + 1
    below = summed.select(
        "conv_id", "length", depth.alias("depth"), _name(depth, [b + F.col(p) for b, p in zip(before, PARTS)]).alias("node"),
        _name(F.col("at"), before).alias("parent"), "words",
    )
    zero = F.lit(0).cast("long")
    top = lengths.select(
        "conv_id", "length", zero.alias("depth"), _name(zero, [zero] * len(PARTS)).alias("node"),
        F.lit(None).cast("string").alias("parent"), zero.alias("words"),
    )
    return saved(below.unionByName(top), "paths")


def roll(parents: list[int], weights: list[int], values: list[tuple[int, ...]]) -> list[list[int]]:
    """Totals over the subtrees of one tree, its nodes in order of depth; ``parents`` are positions, the top's is -1.

    ``weights`` are those of whole subtrees.
    """
    width = range(len(values[0]))
    weights, totals = list(weights), [[0 for _ in width] for _ in parents]
    waiting = [list(range(len(parents)))]
    while waiting:
        members = waiting.pop()
        top = members[0]
        centre = next(m for m in reversed(members) if 2 * weights[m] > weights[top])
        gone, below, above = list(values[centre]), {}, []
        branch: dict[int, int] = {}
        for m in members:
            if m == centre:
                continue
            at = m if parents[m] == centre else branch.get(parents[m])
            if at is None:
                above.append(m)
                continue
            branch[m] = at
            below.setdefault(at, []).append(m)
            for k in width:
                gone[k] += values[m][k]
        node, weight = centre, weights[centre]
        while True:
            for k in width:
                totals[node][k] += gone[k]
            if node == top:
                break
            node = parents[node]
            weights[node] -= weight
        waiting += [*below.values(), above] if above else below.values()
    return totals


def _rolled(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole components, in order of component and depth, each rolled up alone."""
    kept: list[dict] = []

    def component(rows: list[dict]) -> dict[str, list]:
        place = {r["node"]: i for i, r in enumerate(rows)}
        totals = roll([place.get(r["parent"], -1) for r in rows], [r["weight"] for r in rows], [tuple(r[n] for n in names) for r in rows])
        return {"node": list(place), **{n: [t[k] for t in totals] for k, n in enumerate(names)}}

    for batch in batches:
        done: dict[str, list] = {c: [] for c in ("node", *names)}
        for row in batch.to_pylist():
            if kept and kept[-1]["component"] != row["component"]:
                for c, v in component(kept).items():
                    done[c] += v
                kept = []
            kept.append(row)
        yield pa.RecordBatch.from_pydict(done, _rolled_schema(names))
    if kept:
        yield pa.RecordBatch.from_pydict(component(kept), _rolled_schema(names))


def _rolled_schema(names: list[str]) -> pa.Schema:
    return pa.schema([("node", pa.string()), *[(n, pa.int64()) for n in names]])


def rollup(nodes: DataFrame, path: DataFrame, names: list[str], small: int = SMALL) -> DataFrame:
    """Totals of the columns ``names`` over the subtree of each node, itself included.

    ``nodes``: node, parent (null at the root), depth, owner (a conversation through the node), weight (of the whole subtree, over
    all nodes at least 1) and ``names``.  ``path``: conv_id, depth, node and parent of at least all owners.
    """
    state = ["node", "parent", "depth", "owner", "weight", "component", *names]
    # Stored, or the planner would take the one component's name for a constant and drop the join key.
    open_, found, ready = saved(nodes.withColumn("component", F.lit("root")), "components"), [], []
    owners = nodes.select(F.col("owner").alias("conv_id")).distinct()
    path = saved(path.select("conv_id", "depth", "node", "parent").join(owners, "conv_id", "left_semi"), "owner_paths")
    while True:
        totals = open_.groupBy("component").agg(F.max("weight").alias("total"))
        sized = saved(open_.join(totals, "component"), "components")
        ready.append(sized.where(F.col("total") <= small).select(*state))
        large = sized.where(F.col("total") > small)
        if large.isEmpty():
            break
        centres = saved(
            large.where(2 * F.col("weight") > F.col("total")).groupBy("component")
            .agg(F.max(F.struct("depth", "node", "owner", "weight")).alias("c"))
            .select(
                "component", F.col("c.depth").alias("c_depth"), F.col("c.node").alias("c_node"),
                F.col("c.owner").alias("c_owner"), F.col("c.weight").alias("c_weight"),
            ),
            "centres",
        )
        upward = centres.join(path, (F.col("conv_id") == F.col("c_owner")) & (F.col("depth") < F.col("c_depth"))).select(
            "component", "node", F.lit(True).alias("above")
        )
        steps = path.select(
            F.col("conv_id").alias("owner"), F.col("depth").alias("step"), F.col("node").alias("branch"), F.col("parent").alias("branch_parent")
        )
        parted = saved(
            large.join(centres, "component")
            .withColumn("step", F.when(F.col("depth") > F.col("c_depth"), F.col("c_depth") + 1).otherwise(F.col("depth")))
            .join(steps, ["owner", "step"])
            .join(upward, ["component", "node"], "left")
            .withColumn("below", (F.col("depth") > F.col("c_depth")) & (F.col("branch_parent") == F.col("c_node")))
            .withColumn("centre", F.col("node") == F.col("c_node")),
            "parted",
        )
        sums = parted.where(F.col("below") | F.col("centre")).groupBy("component").agg(*[F.sum(n).alias(n) for n in names])
        found.append(
            saved(parted.where(F.coalesce("above", "centre")).select("component", "node").join(sums, "component").drop("component"), "sums")
        )
        open_ = (
            parted.where(~F.col("centre"))
            .withColumn("component", F.when(F.col("below"), F.col("branch")).otherwise(F.col("component")))
            .withColumn("weight", F.when(F.col("above"), F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")))
            .select(*state)
        )
    rest = ready[0]
    for more in ready[1:]:
        rest = rest.unionByName(more)
    schema = "node string, " + ", ".join(f"{n} long" for n in names)
    out = spread(rest, "component").sortWithinPartitions("component", "depth").mapInArrow(lambda batches: _rolled(batches, names), schema)
    for more in found:
        out = out.unionByName(more)
    return out.groupBy("node").agg(*[F.sum(n).alias(n) for n in names])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state = None, hashlib.sha256()
    schema = pa.schema([("node", pa.string()), ("ends_sha256", pa.string())])
    for batch in batches:
        done = []
        for name, text in zip(batch["node"].to_pylist(), batch["ids"].to_pylist()):
            if name != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        yield pa.RecordBatch.from_pydict({"node": [n for n, _ in done], "ends_sha256": [h for _, h in done]}, schema)
    if node is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [state.hexdigest()]}, schema)


def end_hashes(path: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """node, ends_sha256: of the ids of the conversations that end there, in order, joined by commas."""
    ends = path.where(F.col("depth") == F.col("length")).select("node", "conv_id")
    chunks = (
        numbered(ends, ("conv_id",), ("node",))
        .groupBy("node", F.floor(F.col("row_no") / chunk).alias("chunk_no"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    )
    return spread(chunks, "node").sortWithinPartitions("node", "chunk_no").mapInArrow(_hashed, "node string, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, small: int = SMALL, chunk: int = CHUNK) -> DataFrame:
    """All nodes of the trie over ``turns`` (conv_id, at, mark, words, length) of the conversations in ``lengths``."""
    path = paths(turns, lengths)
    nodes = saved(
        path.groupBy("node").agg(
            F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("owner"),
            F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
            F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
        ),
        "nodes",
    )
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    told = saved(
        nodes.join(children, "node", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        .withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
        .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")),
        "told",
    )
    totals = rollup(told, path, ["n_leaves", "saved_tokens"], small)
    above = nodes.select(F.col("node").alias("parent"), F.col("owner").alias("parent_conv_id"))
    return (
        told.drop("n_leaves", "saved_tokens")
        .join(totals, "node").join(end_hashes(path, chunk), "node", "left").join(above, "parent", "left")
        .select(
            F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, lengths = rebuilt(ordered(table(spark, sf_dir, "conversations")))
    return trie(turns, lengths)


OP12_SQL = """
WITH turns AS (
    SELECT conv_id, md5(concat(md5(coalesce(role, '')), coalesce(text, ''))) AS mark,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(md5(coalesce(role, '')), coalesce(text, '')))) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), lengths AS (
    SELECT conv_id, count(*) AS length FROM turns GROUP BY conv_id
), plans AS (
    SELECT a.conv_id, a.conv_id - a.conv_id % 20 AS first, coalesce(b.length, 0) AS there,
           xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(string_split(a.conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
               lambda crc, byte: list_reduce(
                   list_prepend(xor(crc, byte), range(8)),
                   lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
               )
           ), 4294967295::BIGINT) % 4 AS replaced
    FROM lengths a LEFT JOIN lengths b ON b.conv_id = a.conv_id - a.conv_id % 20
), rebuilt AS (
    SELECT t.conv_id, t.pos - p.replaced + least(p.replaced, p.there) AS pos, mark, words
    FROM turns t JOIN plans p ON t.conv_id = p.conv_id WHERE t.pos >= p.replaced
    UNION ALL
    SELECT p.conv_id, t.pos, mark, words FROM turns t JOIN plans p ON t.conv_id = p.first WHERE t.pos < p.replaced
), passed AS (
    SELECT conv_id, pos + 1 AS depth, words, list(mark) OVER (PARTITION BY conv_id ORDER BY pos) AS node FROM rebuilt
    UNION ALL
    SELECT conv_id, 0, 0, [] FROM lengths
), ends AS (
    SELECT arg_max(node, depth) AS node, conv_id FROM passed GROUP BY conv_id
), hashes AS (
    SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM ends GROUP BY node
), nodes AS (
    SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM passed GROUP BY node
), children AS (
    SELECT node[:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), told AS (
    SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.node = c.node
), below AS (
    SELECT a.node, count_if(b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved_tokens
    FROM told a JOIN told b ON b.depth >= a.depth AND b.node[:a.depth] = a.node GROUP BY a.node
)
SELECT t.conv_id, t.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, coalesce(h.ends_sha256, sha256('')) AS ends_sha256
FROM told t JOIN below b ON b.node = t.node LEFT JOIN hashes h ON h.node = t.node
LEFT JOIN nodes p ON t.depth > 0 AND p.node = t.node[:t.depth - 1]
"""
