"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits: the majority of the XXH64 hashes of a text's three-word shingles. Texts of one fingerprint form a class;
classes link where at most ``DISTANCE`` bits differ.

The bits are grouped into ``PARTS`` parts of 16, correlated bits together (greedily, by the correlations over all
classes), so that the values of a part are as uneven as they can be. Two fingerprints within distance D agree to within t_i bits in some
part i, for any thresholds with a sum of D - PARTS + 1 (-1: the part is not probed). So each class, as a query, chooses its own
thresholds: a dynamic program over the parts takes those with the least estimated cost, which is the number of classes
within t_i of its value, from the histogram of the part's 65,536 values, and its probes (values within t_i bits). A query
avoids values that many share. In a bucket (part and value) queries meet members and are verified on all 64 bits.

A bucket of more than ``LIMIT`` members is not compared: its members share the bits so far, so the remaining bits are split into four
parts, one of which must agree whole, and its rows go on to four smaller buckets each. When 12 bits are left a bucket
can't hold more than ``LIMIT`` fingerprints, so this ends, and no bucket is capped. Within a bucket only links that join two
groups of linked members are kept, so the number of links grows with the members, not their pairs.

What the driver gets has a fixed size: 64 x 64 bit counts and 4 x 65,536 value counts.

Edge cases. Fewer than three words: the whole sequence is the one shingle. Null text or no words: fingerprint zero, linked like any
other. Repeated rows, ties: a row each. Null doc_id: orders before all others; its component_id is null. Empty table: no
rows. Extra columns: ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batches_of, write_table
from quarry.llm.components import components
from quarry.llm.hashing import mix

WIDTH, SEED, DISTANCE = 3, 42, 3
PARTS, LIMIT = 4, 4096
BITS = 64 // PARTS
PROBE = 32  # candidates that cost as much as a probe, which is a row to shuffle
SMALL = 32  # buckets compared all at once
HOT = 1024  # a fingerprint of more than 1 / HOT of all rows is hot: there are fewer than HOT
BROADCAST_KEYS = 1_000_000  # 8 MB of keys of large buckets may be broadcast; beyond: a shuffle join
NO_ID = -(2**63)
ROW = "key long, fp long, c long, role int, rest long"
MEMBER, ASKS, VISITOR = 0, 1, 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BLOCK = 1 << 20


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64 majority bits of a text's shingles; block by block, with few words in memory."""
    data, at, last = (text or "").encode().translate(_LOWER), 0, []
    counts, total = np.zeros(64, np.int64), 0
    while at < len(data):
        cut = _SPACE.search(data, at + _BLOCK)
        end = cut.start() if cut else len(data)
        words = last + data[at:end].split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*[words[k:] for k in range(width)])]
        if hashes:
            counts += _bits(np.array(hashes, np.uint64)).sum(0, dtype=np.int64)
            total += len(hashes)
        last, at = words[max(0, len(words) - width + 1):], end
    if not total and last:
        counts, total = _bits(np.array([xxhash.xxh64_intdigest(b" ".join(last), SEED)], np.uint64))[0].astype(np.int64), 1
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def _bits(fp: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, the lowest first."""
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _fingerprints(batches):
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])


def _long(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _counts(batches):
    """Of a task's classes: rows (i, x) of how many have bits i // 64 and i % 64 set; i = 4096: how many there are."""
    both, n = np.zeros((64, 64), np.int64), 0
    for batch in batches:
        bits = _bits(_long(batch.column("fp")).view(np.uint64)).astype(np.float32)
        for a in range(0, len(bits), 1 << 14):  # float32 counts stay exact
            both += (bits[a:a + (1 << 14)].T @ bits[a:a + (1 << 14)]).astype(np.int64)
        n += len(bits)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(both.ravel(), n))], ["i", "x"])


def correlated_parts(both: np.ndarray, n: int, parts: int = PARTS) -> list[list[int]]:
    """64 bits in ``parts`` groups of equal size, correlated ones together: the group starts with the bit most correlated with the
    free ones, and takes the bit most correlated with it on average."""
    share = both / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(like, 0)
    free, out = list(range(64)), []
    for _ in range(parts):
        group = [max(free, key=lambda b: like[b, free].sum())]
        free.remove(group[0])
        while len(group) < 64 // parts:
            group.append(max(free, key=lambda b: like[b, group].sum()))
            free.remove(group[-1])
        out.append(group)
    return out


def values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of each fingerprint, the first one lowest."""
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def within(histogram: np.ndarray, distance: int) -> list[np.ndarray]:
    """For t = 0 to ``distance``: how many classes have a value within t bits of each value."""
    exact = [histogram.astype(np.float64)] + [np.zeros(len(histogram)) for _ in range(distance)]
    at = np.arange(len(histogram))
    for b in range(BITS):
        flipped = at ^ (1 << b)
        exact = [e + exact[k - 1][flipped] if k else e for k, e in enumerate(exact)]
    return list(np.cumsum(exact, 0))


def allocate(costs: list[list[np.ndarray]], distance: int) -> np.ndarray:
    """Thresholds of each query (rows) for each part (columns), with the least sum of costs among those whose sum is
    ``distance`` - parts + 1. ``costs[i][t + 1]``: cost of threshold t in part i, for t from -1."""
    parts, n = len(costs), len(costs[0][0])
    best = {0: (np.zeros(n), np.zeros((n, 0), np.int8))}  # by the sum so far
    for i, options in enumerate(costs):
        found = {}
        for done, (cost, chosen) in best.items():
            for t, more in enumerate(options, -1):
                # what is left can be reached by the parts to come
                if not -(parts - i - 1) <= distance - parts + 1 - done - t <= distance * (parts - i - 1):
                    continue
                row = np.concatenate([chosen, np.full((n, 1), t, np.int8)], 1)
                if done + t in found:
                    old, kept = found[done + t]
                    less = cost + more < old
                    found[done + t] = np.where(less, cost + more, old), np.where(less[:, None], row, kept)
                else:
                    found[done + t] = cost + more, row
        best = found
    return best[distance - parts + 1][1]


def _flips(t: int) -> list[int]:
    """Masks of exactly ``t`` of ``BITS`` bits."""
    masks = {0}
    for _ in range(t):
        masks = {m | 1 << b for m in masks for b in range(BITS) if not m >> b & 1}
    return sorted(masks)


def _key(parent: np.ndarray, part: int, value: np.ndarray) -> np.ndarray:
    """A bucket's key; two that fall together only give more candidates."""
    return mix(mix(parent + np.uint64(part + 1)) + value)


def _table(key, fp, c, role, rest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(c), pa.array(role.astype(np.int32)),
                                       pa.array(rest.view(np.int64))], ["key", "fp", "c", "role", "rest"])


def _probes(groups: list[list[int]], histograms: list[np.ndarray], distance: int):
    """A row for each class and part, as a member, and one for each other value that it asks for there."""
    near = [within(h, distance) for h in histograms]
    flips = [_flips(t) for t in range(distance + 1)]
    probes = np.cumsum([len(f) for f in flips])
    rest = [np.uint64(sum(1 << b for other in groups if other is not g for b in other)) for g in groups]

    def run(batches):
        for batch in batches:
            fp, c = _long(batch.column("fp")).view(np.uint64), _long(batch.column("c"))
            if not len(fp):
                continue
            own = [values(fp, g) for g in groups]
            costs = [[np.zeros(len(fp))] + [near[i][t][v.astype(np.int64)] + PROBE * (probes[t] - 1) for t in range(distance + 1)]
                     for i, v in enumerate(own)]
            chosen = allocate(costs, distance)
            zero = np.uint64(0)
            for i, v in enumerate(own):
                yield _table(_key(zero, i, v), fp, c, np.where(chosen[:, i] >= 0, ASKS, MEMBER), np.full(len(fp), rest[i]))
                for t in range(1, distance + 1):
                    far = np.flatnonzero(chosen[:, i] >= t)
                    for mask in flips[t] if len(far) else ():
                        yield _table(_key(zero, i, v[far] ^ np.uint64(mask)), fp[far], c[far], np.full(len(far), VISITOR), np.full(len(far), rest[i]))

    return run


def _split(order: list[int], parts: int):
    """The rows of large buckets, dealt to ``parts`` smaller ones each by the bits that are left."""

    def run(batches):
        for batch in batches:
            key, fp, rest = (_long(batch.column(x)).view(np.uint64) for x in ("key", "fp", "rest"))
            c, role = _long(batch.column("c")), _long(batch.column("role"))
            for left in np.unique(rest):
                mine = rest == left
                bits = [b for b in order if int(left) >> b & 1]
                for j, some in enumerate(np.array_split(np.array(bits), parts)):
                    less = np.uint64(int(left) & ~sum(1 << int(b) for b in some))
                    yield _table(_key(key[mine], j, values(fp[mine], [int(b) for b in some])), fp[mine], c[mine], role[mine], np.full(mine.sum(), less))

    return run


class _Bucket:
    """Members, and for each the group of linked members it is in; visitors pass by."""

    def __init__(self, distance: int):
        self.distance, self.parts, self.links, self.groups = distance, [], [], None

    def add(self, fp, c, role):
        member = role < VISITOR
        if member.any():
            self.parts.append((fp[member], c[member], role[member]))
        if not member.all():
            self.close()
            self._ask(fp[~member], c[~member], None)

    def close(self):
        if self.groups is None and self.parts:
            self.fp, self.c, role = (np.concatenate(x) for x in zip(*self.parts))
            self.groups = np.arange(len(self.fp))
            asks = np.flatnonzero(role == ASKS)
            self._ask(self.fp[asks], self.c[asks], asks)
        return self.links

    def _ask(self, fp, c, own):
        """Link the queries with the members near them; ``own``: their places among the members."""
        if not self.parts:
            return
        for a in range(0, len(fp), 256):
            near = np.bitwise_count(fp[a:a + 256, None] ^ self.fp[None, :]) <= self.distance
            for q in np.flatnonzero(near.sum(1) > (own is not None)):
                hits = np.flatnonzero(near[q])
                groups, first = np.unique(self.groups[hits], return_index=True)
                if own is not None:
                    mine = self.groups[own[a + q]]
                    first = first[groups != mine]
                self.links += [(int(c[a + q]), int(self.c[hits[k]])) for k in first]
                if len(groups) > 1:
                    self.groups[np.isin(self.groups, groups)] = groups[0]


def _verify(distance: int):
    """Rows sorted by key and role -> links (u, v) that join all near members and queries of each bucket."""

    def links(found):
        u, v = np.array(found, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    def run(batches):
        at, bucket = None, None
        for batch in batches:
            key, fp, c, role = (_long(batch.column(x)) for x in ("key", "fp", "c", "role"))
            fp = fp.view(np.uint64)
            if not len(key):
                continue
            edges = np.flatnonzero(np.diff(key)) + 1
            starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
            found = []
            if at == key[0]:
                bucket.add(fp[:stops[0]], c[:stops[0]], role[:stops[0]])
            else:
                found += bucket.close() if bucket else []
                at, bucket = key[0], _Bucket(distance)
                bucket.add(fp[:stops[0]], c[:stops[0]], role[:stops[0]])
            if len(starts) > 1:  # the first one has ended; the last one may go on
                found += bucket.close()
                sizes = stops[1:-1] - starts[1:-1]
                for i in np.flatnonzero(sizes > SMALL) + 1:
                    whole = _Bucket(distance)
                    whole.add(fp[starts[i]:stops[i]], c[starts[i]:stops[i]], role[starts[i]:stops[i]])
                    found += whole.close()
                size = np.repeat(np.concatenate([[0], np.where(sizes > SMALL, 0, sizes), [0]]), stops - starts)
                for d in range(1, int(size.max(initial=0))):
                    near = (size[:-d] > d) & (key[:-d] == key[d:]) & (np.bitwise_count(fp[:-d] ^ fp[d:]) <= distance)
                    near &= (role[:-d] != VISITOR) & (role[:-d] + role[d:] > 0)  # a member, and one that asks
                    i = np.flatnonzero(near)
                    found += zip(c[i].tolist(), c[i + d].tolist())
                at, bucket = key[-1], _Bucket(distance)
                bucket.add(fp[starts[-1]:], c[starts[-1]:], role[starts[-1]:])
            if len(starts) > 1:
                yield links(found)
        if bucket:
            yield links(bucket.close())

    return run


def links(classes: DataFrame, distance: int = DISTANCE, limit: int = LIMIT) -> DataFrame:
    """Links (u, v) between classes (fp, c): whoever is within ``distance`` is connected by a path of links, and each link is a pair
    within ``distance``. ``limit`` of at least 2 ** (bits left at the end)."""
    spark = classes.sparkSession
    counts = {r.i: r.x for r in classes.select("fp").mapInArrow(_counts, "i long, x long").groupBy("i").agg(F.sum("x").alias("x")).collect()}
    both = np.array([counts.get(i, 0) for i in range(4096)], np.float64).reshape(64, 64)
    groups = correlated_parts(both, counts.get(4096, 0))
    histograms = [np.zeros(1 << BITS, np.int64) for _ in groups]
    for r in _part_values(classes, groups).groupBy("part", "value").agg(F.count(F.lit(1)).alias("x")).toLocalIterator():
        histograms[r.part][r.value] = r.x
    found = []
    with batches_of(spark, 8192):
        rows = write_table(classes.select("fp", "c").mapInArrow(_probes(groups, histograms, distance), ROW), "probes")
        while True:
            sizes = rows.filter(F.col("role") < VISITOR).groupBy("key").agg(F.count(F.lit(1)).alias("x"))
            large = write_table(sizes.filter(F.col("x") > limit).select("key"), "large")
            n = large.count()
            some = F.broadcast(large) if n <= BROADCAST_KEYS else large
            small = rows.join(some, "key", "left_anti") if n else rows
            dealt = small.repartition("key").sortWithinPartitions("key", "role", "fp")
            found.append(write_table(dealt.mapInArrow(_verify(distance), "u long, v long"), "links"))
            if not n:
                break
            order = [b for g in groups for b in g]
            rows = write_table(rows.join(some, "key", "left_semi").mapInArrow(_split(order, distance + 1), ROW), "probes")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _part_values(classes: DataFrame, groups: list[list[int]]) -> DataFrame:
    """A row (part, value) for each class and part."""
    of = [sum((F.shiftleft(F.shiftright("fp", b).bitwiseAND(F.lit(1)), k) for k, b in enumerate(g)), F.lit(0)) for g in groups]
    pairs = F.array(*[F.struct(F.lit(i).alias("part"), v.cast("int").alias("value")) for i, v in enumerate(of)])
    return classes.select(F.inline(pairs))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row; fingerprints of at most ``distance`` different bits are linked."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    with batches_of(spark, 256):
        own = write_table(own.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    classes = write_table(own.groupBy("fp").agg(F.min("doc_id").alias("c"), F.count(F.lit(1)).alias("rows")), "classes")
    least = components(links(classes, distance, limit)).select(F.col("u").alias("c"), F.col("v").alias("least"))
    labels = classes.join(least, "c", "left").select("fp", F.coalesce("least", "c").alias("component_id"), "rows")
    labels = write_table(labels, "labels")
    n = labels.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(labels.filter(F.col("rows") * HOT > n).drop("rows"))  # fewer than HOT rows
    cold = labels.filter(F.col("rows") * HOT <= n).drop("rows")
    out = own.join(hot, "fp").unionByName(own.join(hot.select("fp"), "fp", "left_anti").join(cold, "fp"))
    shown = lambda x: F.nullif(F.col(x), F.lit(NO_ID)).alias(x)
    return out.select(shown("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), shown("component_id"))
