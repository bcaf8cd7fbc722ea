"""Merkle manifest of a dataset by lag and lead windows.

Every row is a leaf: the SHA-256 of its fields, each as ``-`` (null) or UTF-8 byte count, ``:`` and value. The leaves of a group
ascend by their key, and per level every ``arity`` neighbours hash to a parent until one node, the group's subroot, is
left; the subroots, in the order of their groups, give the root the same way.

A group is cut into blocks of ``arity ** levels`` slots, and one window over a block climbs ``levels`` levels at once. A node lives on
the row of its first leaf, so at level l its siblings are lags and leads by multiples of ``arity ** l`` rows, masked by the
node's place in its run and by the number of rows of the group; first-child rows hash the parents. A row below a node takes the
siblings of the last first-child row before it. The nodes at the top of the blocks are the rows of the next tier, with as
many times fewer rows, until each group has one. Down again, a row of a tier takes the proof of its block's row from the tier above by
an equi-join on (group, block); no key has more than a block of rows, whatever share of the table a group holds.

Slots come from one sort by range over narrow rows (digests, no texts): a row's number in its partition, plus the counts of the
partitions before it. Nothing is collected but the size of the largest group.

Edge cases. Null field: ``-``. Null group: a group of its own, before all others; null key: before all others. Rows of one
key: by leaf; repeated rows: neighbours, each with a slot and a proof of its own. Empty texts: ``0:``. Group of one row: its leaf is its
subroot; one group: its subroot is the root. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import write_table

ARITY, LEVELS = 2, 10  # blocks of 1,024 rows
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else byte count, ``:``, value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with g (a number of the group), slot (place in the group's order, from 0) and run (rows of the group)."""
    keys = [*group, *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = write_table(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "ordered")
    spans = stored.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy(*group)
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(*[F.col(c).alias(f"of_{c}") for c in group], F.col("part").alias("of_part"), "first",
                         F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("run"), F.min("first").over(whole).alias("g"))
    same = F.col("part") == F.col("of_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return stored.join(spans, same).select(*rows.columns, "g", (F.col("before") + F.col("at") - F.col("first")).alias("slot"), "run")


def _climb(rows: DataFrame, arity: int, levels: int) -> DataFrame:
    """``rows`` (g, slot, run, node) with block, steps (siblings to the left and right of each level) and, on the
    first row of a block, top (its node)."""
    given = rows.columns
    rows = rows.select("*", F.floor(F.col("slot") / arity**levels).alias("block"), F.col("node").alias("node_0"))
    block = Window.partitionBy("g", "block").orderBy("slot")
    for level in range(levels):
        node, size, have = F.col(f"node_{level}"), arity**level, rows.columns
        place = F.floor(F.col("slot") / size) % arity
        before = [F.when(place >= k, F.lag(node, k * size).over(block)) for k in range(arity - 1, 0, -1)]
        after = [F.when((place + k < arity) & (F.col("slot") + k * size < F.col("run")), F.lead(node, k * size).over(block)) for k in range(1, arity)]
        rows = rows.select(*have, *[F.coalesce(x, F.lit("")).alias(f"before_{i}") for i, x in enumerate(before)],
                           *[F.coalesce(x, F.lit("")).alias(f"after_{i}") for i, x in enumerate(after)])
        left, right = (F.concat(*[f"{side}_{i}" for i in range(arity - 1)]) for side in ("before", "after"))
        goes_on = F.col("run") > size  # several nodes on this level
        step = F.when((F.col("slot") % size == 0) & goes_on, F.struct(left.alias("l"), right.alias("r")))
        parent = F.when(F.col("slot") % (size * arity) == 0, F.when(goes_on, digest(node, right)).otherwise(node))
        rows = rows.select(*have, step.alias(f"step_{level}"), parent.alias(f"node_{level + 1}"))
    upto = block.rowsBetween(Window.unboundedPreceding, 0)
    steps = F.array_compact(F.array(*[F.last(f"step_{i}", True).over(upto) for i in range(levels)]))
    return rows.select(*given, "block", steps.alias("steps"), F.col(f"node_{levels}").alias("top"))


def _tiers(nodes: DataFrame, arity: int, levels: int) -> list[tuple[DataFrame, int]]:
    """``nodes`` and the tiers above it, each with the levels it climbs; in the last one each group has one row, its root."""
    found, size = [], nodes.agg(F.max("run")).first()[0] or 0
    while size > 1:
        climbs = next((k for k in range(1, levels) if arity**k >= size), levels)
        found.append((nodes, climbs))
        tops = _climb(nodes, arity, climbs).filter(F.col("slot") % arity**climbs == 0)
        blocks = F.ceil(F.col("run") / arity**climbs)
        nodes = write_table(tops.select("g", F.col("block").alias("slot"), blocks.alias("run"), F.col("top").alias("node")), "tier")
        size = -(-size // arity**climbs)
    return [*found, (nodes, 0)]


def _down(tiers: list[tuple[DataFrame, int]], known: DataFrame, arity: int) -> DataFrame:
    """The rows of the lowest tier with the columns of ``known`` (g, steps, ...: a row per group), and steps from their own
    level up."""
    facts = [c for c in known.columns if c not in ("g", "steps")]
    above = known.withColumn("slot", F.lit(0).cast("long"))
    for rows, climbs in reversed(tiers[:-1]):
        above = above.select(F.col("g").alias("of_g"), F.col("slot").alias("of_slot"), F.col("steps").alias("rest"), *facts)
        here = _climb(rows, arity, climbs).join(above, (F.col("g") == F.col("of_g")) & (F.col("block") == F.col("of_slot")))
        above = here.select(*rows.columns, *facts, F.concat("steps", "rest").alias("steps"))
    if len(tiers) == 1:  # every group has one row
        above = tiers[0][0].join(known, "g")
    return above


def prove(leaves: DataFrame, group: str, order: str, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """``leaves`` (group, order, leaf and others) with subroot, root and steps: per level, up to the root, the siblings to the left
    and to the right (joined digests). Its columns must not be named like those of this module's tables."""
    nodes = write_table(numbered(leaves, [group], [order, "leaf"]).withColumn("node", F.col("leaf")), "leaves")
    tiers = _tiers(nodes, arity, levels)
    names = nodes.filter("slot = 0").select("g", F.col(group).alias("name"))
    subroots = tiers[-1][0].select("g", F.col("node").alias("leaf")).join(names, "g").withColumnRenamed("g", "of")
    above = _tiers(numbered(subroots, [], ["name"]).withColumn("node", F.col("leaf")), arity, levels)
    no_steps = F.expr("cast(array() as array<struct<l string, r string>>)")
    root = above[-1][0].select("g", F.col("node").alias("root"), no_steps.alias("steps"))
    groups = _down(above, root, arity)
    groups = groups.select(F.col("of").alias("g"), F.col("leaf").alias("subroot"), "root", "steps")
    return _down(tiers, write_table(groups, "subroots"), arity)


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings of a proof, from the leaf's to the last."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda node, s: digest(s["l"], node, s["r"]))


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, fields=FIELDS, key: str = "doc_id", group: str = "lang",
             arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """``(key, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every row. ``tampered``: fields as they are found
    later; a row's folded root comes from them and the siblings of the manifest."""
    leaf = digest(*[field(F.col(c)) for c in fields])
    later = {c: (tampered or {}).get(c, F.col(c)) for c in fields}
    changed = F.lit(False)
    for c, value in (tampered or {}).items():
        changed = changed | ~F.col(c).eqNullSafe(value)
    found = F.when(changed, digest(*[field(later[c]) for c in fields]))  # null: as before
    leaves = docs.select(F.col(key).alias("doc_key"), F.col(group).alias("doc_group"), leaf.alias("leaf"), found.alias("found"))
    out = prove(leaves, "doc_group", "doc_key", arity, levels)
    folded = fold(F.coalesce("found", "leaf"), F.col("steps"))
    out = out.select(F.col("doc_key").alias(key), "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
