"""Append-only audit log under a hash tree.

A chain of hashes is serial by nature, so the log is a tree: events of a case are numbered in the order in which they
came, and each node hashes the nodes of up to WIDTH neighbours below it. The nodes of a batch are found level by level
with one grouping each, whatever the size of a case; a batch rewrites only the last node of each level.

An event's place depends on the order alone, so one batch or many give the same tree. A changed, lost or moved event
shows in its own hash or in the node above it, and the root of a case, kept elsewhere, speaks for all of its events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .scan import ranked

# Text kept per value, items kept per list.
TEXT_KEPT = 400
LIST_KEPT = 20
# A node holds WIDTH nodes of the level below; the root is node 0 of level LEVELS, so a case may hold WIDTH ** LEVELS events.
WIDTH = 1024
LEVELS = 4

LOG_COLUMNS = ("case_id", "batch_id", "position", "id", "action", "payload", "event_hash")
NODE_COLUMNS = ("case_id", "batch_id", "level", "node", "events", "node_hash")


def compact_text(col: Column) -> Column:
    return F.when(F.length(col) > TEXT_KEPT, F.concat(F.substring(col, 1, TEXT_KEPT), F.lit("..."))).otherwise(col)


def compact_list(col: Column) -> Column:
    return F.transform(F.slice(col, 1, LIST_KEPT), compact_text)


def compact_map(col: Column) -> Column:
    return F.transform_values(col, lambda _k, v: compact_text(v))


def payload(plain: list[str], texts: list[str] = (), lists: list[str] = ()) -> Column:
    """The hashed part of an event: JSON of these columns, nulls kept, long texts and lists of texts compacted."""
    kept = [F.col(c) for c in plain] + [compact_text(F.col(c)).alias(c) for c in texts] + [compact_list(F.col(c)).alias(c) for c in lists]
    return F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})


def leaf_hash(case_id: Column, position: Column, body: Column) -> Column:
    """Hash of an event at its place; a null payload counts as an empty one, a null case as case -1."""
    parts = [F.lit("0"), F.coalesce(case_id, F.lit(-1)).cast("string"), position.cast("string"), F.coalesce(body, F.lit(""))]
    return F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256)


def node_hash(level: Column, children: Column) -> Column:
    return F.sha2(F.concat_ws("\n", level.cast("string"), F.array_join(children, "\n")).cast("binary"), 256)


def _at(position: Column, width: int, level: int) -> Column:
    return F.floor(position / F.lit(width**level)).cast("long") if level else position


def _grouped(children: DataFrame, width: int, *keys: str) -> DataFrame:
    """(keys, node, events, hashes): the nodes above `children`; a group has at most `width` rows."""
    node = F.floor(F.col("place") / width).cast("long")
    found = children.groupBy(*keys, node.alias("node")).agg(
        F.sum("events").alias("events"), F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("below")
    )
    return found.select(*keys, "node", "events", F.transform("below", lambda c: c["hash"]).alias("hashes"))


def append_audit(stored: tuple[DataFrame, DataFrame] | None, events: DataFrame, batch_id: int, width: int = WIDTH, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(log rows, nodes) that a batch adds to the `stored` log and nodes, the last node of each level in its new state.

    `events`: id, case_id, action, created_at, payload; ids and times may be null or repeat, equal rows are events of
    their own. Events are numbered behind the stored ones of their case by created_at, id, action and payload, events
    without a case as case -1. Of the stored tables only the open node of each level is read again. No events: no rows.
    """
    rows = events.select("id", F.coalesce("case_id", F.lit(-1)).cast("long").alias("case_id"), "action", "created_at", "payload")
    placed = ranked(rows, ["created_at", "id", "action", "payload"], ["case_id"], "position")
    cases = placed.select("case_id").distinct()
    if stored is None:
        base = cases.withColumn("base", F.lit(0).cast("long"))
    else:
        roots = stored[1].filter(F.col("level") == levels).groupBy("case_id").agg(F.max("events").alias("base"))
        base = materialise(cases.join(roots, "case_id", "left").withColumn("base", F.coalesce("base", F.lit(0)).cast("long")))
    position = F.col("base") + F.col("position") - 1
    full = F.raise_error(F.lit(f"a case of this tree holds at most {width**levels} events")).cast("long")
    at = placed.join(base, "case_id").withColumn("position", F.when(position < width**levels, position).otherwise(full).cast("long"))
    log = at.withColumn("batch_id", F.lit(batch_id).cast("long")).withColumn("event_hash", leaf_hash(F.col("case_id"), F.col("position"), F.col("payload")))
    log = log.select(*LOG_COLUMNS)

    new = log.select("case_id", F.col("position").alias("place"), F.lit(1).cast("long").alias("events"), F.col("event_hash").alias("hash"))
    made = []
    for level in range(1, levels + 1):
        if stored is not None:
            new = new.unionByName(_open_node(stored, base, width, level))
        nodes = _grouped(new, width, "case_id").select(
            "case_id", F.lit(batch_id).cast("long").alias("batch_id"), F.lit(level).alias("level"), "node", "events",
            node_hash(F.lit(level), F.col("hashes")).alias("node_hash"),
        )
        nodes = materialise(nodes) if level == 1 else nodes
        made.append(nodes)
        new = nodes.select("case_id", F.col("node").alias("place"), "events", F.col("node_hash").alias("hash"))
    every = made[0]
    for nodes in made[1:]:
        every = every.unionByName(nodes)
    return log, every


def _open_node(stored: tuple[DataFrame, DataFrame], base: DataFrame, width: int, level: int) -> DataFrame:
    """(case_id, place, events, hash): finished stored children of the node of `level` in which a batch's events begin.

    A child is stored once in its finished state, which its number of events tells.
    """
    if level == 1:
        below = stored[0].select("case_id", F.col("position").alias("place"), F.lit(1).cast("long").alias("events"), F.col("event_hash").alias("hash"))
    else:
        done = stored[1].filter((F.col("level") == level - 1) & (F.col("events") == width ** (level - 1)))
        below = done.select("case_id", F.col("node").alias("place"), "events", F.col("node_hash").alias("hash"))
    near = below.join(base, "case_id").filter(F.floor(F.col("place") / width) == _at(F.col("base"), width, level))
    return near.filter(F.col("place") < _at(F.col("base"), width, level - 1)).drop("base")


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes in their last state: a batch stores the last node of a level again."""
    state = F.max_by(F.struct("events", "node_hash"), "batch_id").alias("s")
    return nodes.groupBy("case_id", "level", "node").agg(state).select("case_id", "level", "node", "s.events", "s.node_hash")


def _children(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """(case_id, level, place, events, hash): events and nodes below the root, under the level of the node above them."""
    leaves = log.select("case_id", F.lit(1).alias("level"), F.col("position").alias("place"), F.lit(1).cast("long").alias("events"), F.col("event_hash").alias("hash"))
    inner = nodes.select("case_id", (F.col("level") + 1).alias("level"), F.col("node").alias("place"), "events", F.col("node_hash").alias("hash"))
    return leaves.unionByName(inner)


def broken_hashes(log: DataFrame) -> DataFrame:
    """Log rows whose stored hash is not the hash of their place and payload."""
    return log.filter(~F.col("event_hash").eqNullSafe(leaf_hash(F.col("case_id"), F.col("position"), F.col("payload"))))


def broken_nodes(log: DataFrame, nodes: DataFrame, width: int = WIDTH, levels: int = LEVELS) -> DataFrame:
    """(case_id, level, node): nodes that are not the hash of what is stored below them, or are missing above it.

    A lost, added or moved event shows at level 1, a lost or changed node one level above it. All levels are grouped at once.
    """
    now = latest_nodes(nodes)
    wanted = _grouped(_children(log, now).filter(F.col("level") <= levels), width, "case_id", "level").select(
        "case_id", "level", "node", node_hash(F.col("level"), F.col("hashes")).alias("wanted")
    )
    both = wanted.join(now.select("case_id", "level", "node", "node_hash"), ["case_id", "level", "node"], "full")
    return both.filter(~F.col("node_hash").eqNullSafe(F.col("wanted"))).select("case_id", "level", "node")


def proof_nodes(log: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int = WIDTH, levels: int = LEVELS) -> DataFrame:
    """(case_id, level, node, hashes): the hashes under each node above the wanted (case_id, position), every node once.

    The proofs of many events share their nodes; see `proven_by_nodes`.
    """
    return _below(log, nodes, _steps(wanted, width, levels).select("case_id", "level", "node").distinct(), width)


def _steps(wanted: DataFrame, width: int, levels: int) -> DataFrame:
    """(case_id, position, level, node, slot): the nodes above each wanted event and the place in them."""
    step = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), _at(F.col("position"), width, k).alias("node"), F.pmod(_at(F.col("position"), width, k - 1), F.lit(width)).alias("slot")) for k in range(1, levels + 1)]))
    return wanted.select("case_id", "position").distinct().select("case_id", "position", step.alias("s")).select("case_id", "position", "s.*")


def _below(log: DataFrame, nodes: DataFrame, sought: DataFrame, width: int) -> DataFrame:
    below = _children(log, latest_nodes(nodes)).withColumn("node", F.floor(F.col("place") / width).cast("long"))
    return _grouped(below.join(sought, ["case_id", "level", "node"], "left_semi"), width, "case_id", "level").drop("events")


def inclusion_proofs(log: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int = WIDTH, levels: int = LEVELS) -> DataFrame:
    """(case_id, position, level, slot, hashes): for each wanted (case_id, position) the hashes under each node above it.

    With the payload and the root alone they show that the event is in the log at its place; see `proven`. Each event has
    its own copy of the hashes, to be handed out; many events are proven at once by `proof_nodes`.
    """
    steps = _steps(wanted, width, levels)
    lists = _below(log, nodes, steps.select("case_id", "level", "node").distinct(), width)
    return steps.join(lists, ["case_id", "level", "node"]).select("case_id", "position", "level", "slot", "hashes")


def proven(events: DataFrame, proofs: DataFrame, roots: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(case_id, position, proven): whether the `proofs` lead from the events' payloads to the `roots` (case_id, root).

    `events`: case_id, position, payload. An event without proof or root is not proven.
    """
    paths = proofs.groupBy("case_id", "position").agg(F.array_sort(F.collect_list(F.struct("level", "slot", "hashes"))).alias("steps"))
    joined = events.select("case_id", "position", "payload").join(paths, ["case_id", "position"], "left").join(roots.select("case_id", "root"), "case_id", "left")
    start = leaf_hash(F.col("case_id"), F.col("position"), F.col("payload"))
    climb = lambda below, s: F.when(F.get(s["hashes"], s["slot"].cast("int")) == below, node_hash(s["level"], s["hashes"]))
    top = F.aggregate("steps", start, climb)
    whole = (F.size("steps") == levels) & (top == F.col("root"))
    return joined.select("case_id", "position", F.coalesce(whole, F.lit(False)).alias("proven"))


def proven_by_nodes(events: DataFrame, found: DataFrame, roots: DataFrame, width: int = WIDTH, levels: int = LEVELS) -> DataFrame:
    """As `proven`, by the `proof_nodes` of all events: each node is hashed once and checked against the node above it,
    each event against its node. Events carry no lists; a node meets at most `width` nodes below it.
    """
    lists = materialise(found.select("case_id", "level", "node", "hashes", node_hash(F.col("level"), F.col("hashes")).alias("own")))
    above = F.floor(F.col("node") / width).cast("long")
    top = lists.filter(F.col("level") == levels).join(roots.select("case_id", "root"), "case_id").filter("node = 0 AND own = root")
    sound = top.select("case_id", "node")
    for level in range(levels, 1, -1):
        parents = lists.filter(F.col("level") == level).join(sound, ["case_id", "node"], "left_semi").select("case_id", F.col("node").alias("_above"), "hashes")
        children = lists.filter(F.col("level") == level - 1).select("case_id", "node", "own", above.alias("_above"))
        linked = F.get("hashes", F.pmod(F.col("node"), F.lit(width)).cast("int")) == F.col("own")
        sound = children.join(parents, ["case_id", "_above"]).filter(linked).select("case_id", "node")
    kept = lists.filter(F.col("level") == 1).join(sound, ["case_id", "node"], "left_semi").select("case_id", "node", "hashes")
    asked = events.select("case_id", "position", _at(F.col("position"), width, 1).alias("node"), leaf_hash(F.col("case_id"), F.col("position"), F.col("payload")).alias("_leaf"))
    same = F.get("hashes", F.pmod(F.col("position"), F.lit(width)).cast("int")) == F.col("_leaf")
    return asked.join(kept, ["case_id", "node"], "left").select("case_id", "position", F.coalesce(same, F.lit(False)).alias("proven"))


def verify_links(log: DataFrame) -> DataFrame:
    """Per event of a single chain: `link` is genesis, linked or missing, and how many successors it has."""
    holders = log.groupBy(F.col("event_hash").alias("prev_hash")).agg(F.min("id").alias("prev_id"))
    follow = log.filter("prev_hash IS NOT NULL").groupBy(F.col("prev_hash").alias("event_hash")).agg(F.count("*").alias("successors"))
    sought = log.withColumn("_prev", F.coalesce("prev_hash", F.concat(F.lit("\u0000"), F.col("id").cast("string"))))
    joined = sought.join(holders.withColumnRenamed("prev_hash", "_prev"), "_prev", "left").join(follow, "event_hash", "left")
    link = F.when(F.col("prev_hash").isNull(), "genesis").when(F.col("prev_id") < F.col("id"), "linked").otherwise("missing")
    return joined.select("id", link.alias("link"), F.coalesce("successors", F.lit(0)).cast("long").alias("successors"))


def chain_verdict(links: DataFrame) -> DataFrame:
    """One row: events, broken links, forks, genesis rows, and whether the chain is intact."""
    sums = links.agg(
        F.count("*").alias("events"), F.count_if(F.col("link") == "missing").alias("missing"),
        F.count_if(F.col("successors") > 1).alias("forks"), F.count_if(F.col("link") == "genesis").alias("genesis"),
    )
    return sums.withColumn("intact", (F.col("missing") == 0) & (F.col("forks") == 0) & (F.col("genesis") == 1))
