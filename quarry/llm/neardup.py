"""Near-duplicates by a chosen-path set similarity join.

A document's set is its distinct word shingles. Documents of equal sets form a class. Each class has ``POSITIONS``
minwise tokens. In each of ``trees`` independent trees it goes down from the root: a node's hash chooses ``BRANCH``
positions, and the class goes to the children named by (node, position, its minwise token there). Two sets of
similarity s share a child of a common node with probability 1 - (1-s)^2, so at depth 3 a tree brings a pair of
similarity 0.8 together with probability 0.94, and four trees miss fewer than one in 50,000.

Nodes of at most ``SMALL`` classes are compared exhaustively: pairs whose two-bit minwise sketches agree in
``AGREE`` of 128 places (4 standard deviations below what similarity 0.8 gives) are confirmed on the full sets. Larger
nodes are handled without their square, as pairs within a component need no link. (1) The first member of such a node, its hub, is
compared with all others while they pass by; links give classes labels that only classes of one component share, and a table of
edges that join the same components takes in new links only. (2) Members that are neither linked with their hub nor of its label are the node's outsiders. A node without any is done.
Where outsiders are at most a quarter of a node, or it has at most ``MEDIUM`` members, they are compared with all its members, and the node
is done; its members are dealt to tasks ``BLOCK`` at a time, each with all outsiders. Here pairs are left out that can't be alike enough: the
bits in which the parities of two sets' hashes differ, by bucket, are at most the shingles in which the sets differ. (3) Other nodes branch
``STEP`` levels further, and what is still large after ``DEEPEST`` such steps goes on as in (2). No candidate is capped or dropped.

Edge cases. Fewer words than a shingle: the whole sequence is one. No words or null text: no set, linked with nothing.
Rows that share a doc_id are one document. Null doc_id: one document that orders before all others; its component_id
is null. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, write_table
from quarry.llm.components import components
from quarry.llm.hashing import mix
from quarry.llm.shingles import POSITIONS, set_digest, shingle_sets, signature

BRANCH, DEPTH, TREES, STEP, DEEPEST = 2, 3, 4, 2, 4
SMALL, MEDIUM, BLOCK, AGREE = 32, 4096, 4096, 92
ALIKE = f"bit_count(~((s0 ^ o_s0) | (s2 ^ o_s2))) + bit_count(~((s1 ^ o_s1) | (s3 ^ o_s3))) >= {AGREE}"
SKETCH = ["s0", "s1", "s2", "s3"]
PARITY = [f"p{i}" for i in range(16)]  # 1,024 buckets
DIFFER = " + ".join(f"bit_count({p} ^ o_{p})" for p in PARITY)
NODE_ROW = "node long, c long, k long, s0 long, s1 long, s2 long, s3 long"
BROADCAST_IDS = 1_000_000  # ids of documents to be confirmed that may be broadcast (8 MB); beyond: a shuffle join
NO_ID = -(2**63)


def _sketch(width: int):
    def run(batches):
        for batch in batches:
            n, d1, d2, sig = [], [], [], []
            for own in shingle_sets(batch.column("text"), width):
                a, b = set_digest(own)
                n.append(len(own))
                d1.append(a)
                d2.append(b)
                sig.append(signature(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(sig, pa.binary())], ["doc_id", "n", "d1", "d2", "sig"])

    return run


def children(nodes: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """The ``BRANCH`` children of each node (rows: classes) by the minwise tokens at the positions it chooses."""
    h, out, taken = mix(nodes), [], None
    for k in range(BRANCH):
        p = (h >> np.uint64(7 * k)) & np.uint64(POSITIONS - 1)
        if taken is not None:
            p = np.where(p == taken, (p + np.uint64(1)) & np.uint64(POSITIONS - 1), p)
        taken = p
        token = np.take_along_axis(sig, p.astype(np.int64), 1).astype(np.uint64)
        out.append(mix(h + token * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1)))
    return np.concatenate(out, 1)


def _rows(nodes: np.ndarray, ids: np.ndarray, labels: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
    """A row per node and class with its label and the two planes of its two-bit sketch."""
    planes = [np.packbits((sig >> np.uint32(k)) & np.uint32(1), axis=1).view(np.int64)[:, half] for k in (0, 1) for half in (0, 1)]
    per = nodes.shape[1]
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes.ravel().view(np.int64))] + [pa.array(np.repeat(x, per)) for x in (ids, labels, *planes)],
        ["node", "c", "k", *SKETCH])


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, POSITIONS)


def _roots(trees: int, depth: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, ids = _signatures(batch.column("sig")), batch.column("c").to_numpy(zero_copy_only=False)
            found = []
            for tree in range(trees):
                nodes = np.full((len(ids), 1), mix(np.array([tree + 1], np.uint64))[0], np.uint64)
                for _ in range(depth):
                    nodes = children(nodes, sig)
                found.append(nodes)
            yield _rows(np.concatenate(found, 1), ids, ids, sig)

    return run


def _branch(batches):
    for batch in batches:
        if batch.num_rows:
            sig = _signatures(batch.column("sig"))
            nodes = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)[:, None]
            for _ in range(STEP):
                nodes = children(nodes, sig)
            yield _rows(nodes, *[batch.column(x).to_numpy(zero_copy_only=False) for x in ("c", "k")], sig)


def _compare(batches):
    """Rows sorted by node -> candidate pairs (kind 0: x, y) of small nodes and of the hubs of larger ones, and the members of those
    (kind 1: node, class, sketch, hub). Holds one small node and a hub; rows of a larger node pass through."""
    carry, large, hub = None, None, None
    names = ["kind", "x", "y", *SKETCH, "hub"]

    def alike(rows, i, others, j):
        s, o = [r.view(np.uint64) for r in rows[3:]], [r.view(np.uint64) for r in others[3:]]
        same = lambda a, b: np.bitwise_count(~((s[a][i] ^ o[a][j]) | (s[b][i] ^ o[b][j]))).astype(np.int64)
        return (same(0, 2) + same(1, 3) >= AGREE) & (rows[2][i] != others[2][j])

    def pairs(rows):
        c, (i, j) = rows[1], np.triu_indices(len(rows[1]), 1)
        near = alike(rows, i, rows, j)
        i, j = i[near], j[near]
        return np.minimum(c[i], c[j]), np.maximum(c[i], c[j])

    def with_hub(rows):
        c = rows[1][alike(rows, slice(None), hub, slice(None))]
        return np.minimum(c, hub[1]), np.maximum(c, hub[1])

    def out(found, members):
        x = [p[0] for p in found] + [m[0] for m in members]
        y = [p[1] for p in found] + [m[1] for m in members]
        none = sum(len(p[0]) for p in found)
        if not x:
            return None
        cat = lambda a: np.concatenate(a) if a else np.empty(0, np.int64)
        sketch = [np.concatenate([np.zeros(none, np.int64), cat([m[k] for m in members])]) for k in range(3, 7)]
        kind = np.concatenate([np.zeros(none, np.int32), np.ones(len(sketch[0]) - none, np.int32)])
        hubs = np.concatenate([np.zeros(none, np.int64), cat([m[7] for m in members])])
        return pa.RecordBatch.from_arrays([pa.array(a) for a in (kind, cat(x), cat(y), *sketch, hubs)], names)

    for batch in batches:
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
        if carry is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(carry, rows)]
        if not len(rows[0]):
            continue
        edges = np.flatnonzero(np.diff(rows[0])) + 1
        starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [len(rows[0])]])
        found, members = [], []
        keep = (stops - starts > 1) | (rows[0][starts] == large if large is not None else False)
        keep[-1] = True
        carry = None
        for a, b in zip(starts[keep], stops[keep]):
            part = [r[a:b] for r in rows]
            if b - a > SMALL and part[0][0] != large:
                large, hub = part[0][0], [r[:1].copy() for r in part]
            if part[0][0] == large:
                found.append(with_hub(part))
                members.append([*part, np.full(b - a, hub[1][0])])
            elif b == len(rows[0]):
                carry = [r.copy() for r in part]
            else:
                found.append(pairs(part))
        if (batch_out := out(found, members)) is not None:
            yield batch_out
    if carry is not None and len(carry[0]) > 1 and (batch_out := out([pairs(carry)], [])) is not None:
        yield batch_out


def _set_rows(width: int):
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), width))
            at = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("c"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["c", "own"])

    return run


def _parities(batches):
    for batch in batches:
        lists = batch.column("own")
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        rows = [np.packbits((np.bincount(mix(flat[a:b]).astype(np.int64) & 1023, minlength=1024) & 1).astype(np.uint8)).view(np.int64)
                for a, b in zip(at[:-1], at[1:])]
        cols = np.array(rows, np.int64).reshape(-1, len(PARITY)).T
        yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(np.diff(at).astype(np.int64)), *[pa.array(c) for c in cols]],
                                         ["c", "n", *PARITY])


class _Join:
    """One run of the join: its tables and the links confirmed so far."""

    def __init__(self, docs: DataFrame, width: int, percent: int, trees: int, depth: int, deepest: int):
        self.docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.spark, self.width, self.percent, self.trees, self.depth, self.deepest = docs.sparkSession, width, percent, trees, depth, deepest
        self.links: list[DataFrame] = []
        self.edges: DataFrame | None = None  # joins what all links folded so far join
        self.labels: DataFrame | None = None

    def run(self) -> DataFrame:
        arrow_rows(self.spark, 256)
        sketch = write_table(self.docs.mapInArrow(_sketch(self.width), "doc_id long, n long, d1 long, d2 long, sig binary"), "sketches")
        same = ["n", "d1", "d2"]
        self.classes = write_table(sketch.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("c"), F.min_by("sig", "doc_id").alias("sig")), "classes")
        pairs, large = self._compare(self.classes.select("c", "sig").mapInArrow(_roots(self.trees, self.depth), NODE_ROW))
        self._confirm(pairs, self._sets(pairs.select(F.col("a").alias("c")).union(pairs.select("b"))))
        if large is not None:
            self._divide(large)
        out = sketch.select("doc_id", "n", "d1", "d2").join(self.classes.select(*same, "c"), same, "left")
        out = out.join(components(self._known()).select(F.col("u").alias("c"), F.col("v").alias("least")), "c", "left")
        shown = lambda x: F.nullif(x, F.lit(NO_ID))
        found = F.coalesce("least", "c", "doc_id")
        return out.select(shown(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"),
                          shown(found).alias("component_id"), (F.col("doc_id") == found).alias("kept"))

    def _known(self) -> DataFrame:
        """Edges that join what all confirmed links join: the folded ones and the links since."""
        known = self.edges
        for links in self.links:
            known = links if known is None else known.unionByName(links)
        return known

    def _fold(self) -> DataFrame:
        """The label table (u, v): v of u's component; classes not in it are labels themselves. After a few rounds a class may still have
        several edges up: it is labelled by one of them, and all of them are kept."""
        self.edges, self.links = components(self._known(), rounds=2), []
        self.labels = write_table(self.edges.groupBy("u").agg(F.min("v").alias("v")), "labels")
        return self.labels

    def _compare(self, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The candidate pairs (a, b) of nodes, and the members of large ones, if any."""
        arrow_rows(self.spark, 4096)
        dealt = rows.repartition("node").sortWithinPartitions("node", "c")
        got = write_table(dealt.mapInArrow(_compare, "kind int, x long, y long, s0 long, s1 long, s2 long, s3 long, hub long"), "nodes")
        pairs = got.filter("kind = 0 and x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        large = got.filter("kind = 1").select(F.col("x").alias("node"), F.col("y").alias("c"), *SKETCH, "hub")
        return write_table(pairs, "pairs"), None if large.isEmpty() else large

    def _sets(self, ids: DataFrame) -> DataFrame:
        """The full sets of the documents ``ids`` (c), stored."""
        ids = write_table(ids.distinct(), "ids")
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        arrow_rows(self.spark, 256)
        texts = self.docs.withColumnRenamed("doc_id", "c").join(ids, "c", "left_semi")
        return write_table(texts.mapInArrow(_set_rows(self.width), "c long, own array<long>"), "sets")

    def _confirm(self, pairs: DataFrame, sets: DataFrame) -> None:
        """Store and keep the links of the pairs whose full sets are alike enough."""
        left = sets.select(F.col("c").alias("a"), F.col("own").alias("x"))
        right = sets.select(F.col("c").alias("b"), F.col("own").alias("y"))
        both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
        alike = both.filter(100 * F.col("i") >= self.percent * (F.size("x") + F.size("y") - F.col("i")))
        self.links.append(write_table(alike.select(F.col("b").alias("u"), F.col("a").alias("v")), "links"))

    def _outsiders(self, large: DataFrame) -> DataFrame:
        """The members (node, c, sketch) that have no link with their hub and another label."""
        links = self.links[-1]
        linked = links.select(F.col("u").alias("c"), F.col("v").alias("hub")).unionByName(links.select(F.col("v").alias("c"), F.col("u").alias("hub")))
        outs = large.filter("c != hub").join(linked, ["c", "hub"], "left_anti")
        labels = self._fold()
        for end in ("c", "hub"):
            outs = outs.join(labels.select(F.col("u").alias(end), F.col("v").alias(f"k_{end}")), end, "left")
        return write_table(outs.filter(F.coalesce("k_c", "c") != F.coalesce("k_hub", "hub")).select("node", "c", *SKETCH), "outsiders")

    def _meet(self, members: DataFrame, outs: DataFrame, sizes: DataFrame, sets: DataFrame, facts: DataFrame) -> None:
        """Compare the outsiders of nodes with all members of other labels, ``BLOCK`` members at a time."""
        known = facts.join(self.labels.select(F.col("u").alias("c"), F.col("v").alias("k")), "c", "left").withColumn("k", F.coalesce("k", "c"))
        known = write_table(known, "known")
        blocks = F.ceil(F.col("m") / BLOCK).cast("int")

        def with_facts(rows):  # labels and parities meet a class once, whatever the number of its nodes (TREES x BRANCH ** levels at most)
            paths = rows.groupBy("c", *SKETCH).agg(F.collect_list(F.struct("node", "block")).alias("paths"))
            return paths.join(known, "c").select("c", "k", "n", *SKETCH, *PARITY, F.inline("paths"))

        members = members.join(sizes, "node").withColumn("block", F.pmod(F.xxhash64("c"), blocks).cast("int"))
        outs = outs.join(sizes, "node").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        outs = with_facts(outs).select("node", "block", *[F.col(x).alias(f"o_{x}") for x in ("c", "k", "n", *SKETCH, *PARITY)])
        can = f"k != o_k and {ALIKE} and {100 + self.percent} * ({DIFFER}) <= {100 - self.percent} * (n + o_n)"
        pairs = with_facts(members).join(outs, ["node", "block"]).filter(can)
        self._confirm(pairs.select(F.least("c", "o_c").alias("a"), F.greatest("c", "o_c").alias("b")).distinct(), sets)

    def _divide(self, large: DataFrame) -> None:
        # the members of large nodes stay the same or get fewer: their sets are made once
        sets = self._sets(large.select("c"))
        facts = write_table(sets.mapInArrow(_parities, ", ".join(f"{x} long" for x in ("c", "n", *PARITY))), "parities")
        for step in range(1, self.deepest + 1):
            outs = self._outsiders(large)
            left = large.join(outs.select("node").distinct(), "node", "left_semi")
            # nodes with the same members (other trees, other paths) count once
            members = left.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("h"))
            once = members.groupBy("m", "h").agg(F.min("node").alias("node"))
            sizes = write_table(once.join(outs.groupBy("node").agg(F.count(F.lit(1)).alias("o")), "node").select("node", "m", "o"), "sizes")
            is_dense = (F.col("o") * 4 <= F.col("m")) | (F.col("m") <= MEDIUM) | F.lit(step == self.deepest)
            dense, sparse = sizes.filter(is_dense).select("node", "m"), sizes.filter(~is_dense).select("node")
            self._meet(large, outs, dense, sets, facts)
            if sparse.isEmpty():
                return
            labels = self._fold().select(F.col("u").alias("c"), F.col("v").alias("k"))
            paths = large.join(sparse, "node", "left_semi").groupBy("c").agg(F.collect_set("node").alias("nodes"))  # TREES x BRANCH ** levels at most
            branched = paths.join(self.classes.select("c", "sig"), "c").join(labels, "c", "left").select(
                F.explode("nodes").alias("node"), "c", F.coalesce("k", "c").alias("k"), "sig")
            pairs, large = self._compare(branched.mapInArrow(_branch, NODE_ROW))
            self._confirm(pairs, sets)
            if large is None:
                return


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of all documents; linked where 100 x intersection >= percent x union."""
    return _Join(docs, width, percent, trees, depth, DEEPEST).run()
