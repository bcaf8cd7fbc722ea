"""Near-duplicate removal, first occurrence wins.

Rule: walk the documents in order; drop one if any LSH band equals that of a *kept* document,
otherwise keep it. Dropped documents are not indexed, so duplicates do not chain: the kept set is the
lexicographically-first maximal independent set of the "shares a bucket" graph (not its components).

Parallel form ("peeling"): in a round, an undecided document that has the smallest position in
every bucket it belongs to is kept; every other undecided member of a bucket whose smallest member
was just kept is dropped; repeat. This equals the sequential walk. All steps are aggregations or
joins on the document position -- never on the bucket key, which may be hot -- except "members of
killed buckets", which splits hot buckets (a few, size-checked, broadcast) from the rest.

Sketch: MinHash over the distinct whitespace tokens, ``num_perm`` permutations
``h_i(t) = (a_i * h0(t) + b_i) mod (2^31 - 1)`` with ``h0`` = first 32 bits of md5(token); the band
split ``(bands, rows)`` minimises the equal-weight false-positive + false-negative area for the
threshold, as MinHash-LSH does. Signatures are computed in Arrow batches with NumPy.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quarry.functions.text import distinct_tokens
from quarry.operators.ordered import BROADCAST_MAX_ROWS, checked_broadcast
from quarry.session import cut_lineage
from quarry import defaults as DEF

PRIME = (1 << 31) - 1
EMPTY_VALUE = PRIME  # signature value of a document without tokens (never produced by a real hash)
MASK64 = (1 << 64) - 1


def _integrate(f, a: float, b: float, n: int = 2000) -> float:
    if b <= a:
        return 0.0
    xs = np.linspace(a, b, n + 1)
    ys = f(xs)
    return float(np.sum((ys[1:] + ys[:-1]) * 0.5) * (b - a) / n)


@lru_cache(maxsize=None)
def optimal_bands(threshold: float, num_perm: int, fp_weight: float = 0.5, fn_weight: float = 0.5) -> tuple[int, int]:
    """(bands, rows) minimising ``fp_weight * FP area + fn_weight * FN area`` of the S-curve."""
    best, best_err = (1, 1), float("inf")
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            fp = _integrate(lambda s: 1 - (1 - s ** r) ** b, 0.0, threshold)
            fn = _integrate(lambda s: 1 - (1 - (1 - s ** r) ** b), threshold, 1.0)
            err = fp_weight * fp + fn_weight * fn
            if err < best_err:
                best, best_err = (b, r), err
    return best


TOKEN_BLOCK = 4_096  # tokens whose permuted hashes are held at once


def perm_params(num_perm: int, seed: int = 1) -> tuple[list[int], list[int]]:
    """Permutation coefficients from a splitmix64 stream of ``seed`` (a rule, not a table)."""
    state, vals = seed & MASK64, []
    for _ in range(2 * num_perm):
        state = (state + 0x9E3779B97F4A7C15) & MASK64
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK64
        vals.append(z ^ (z >> 31))
    a = [1 + v % (PRIME - 1) for v in vals[:num_perm]]
    b = [v % PRIME for v in vals[num_perm:]]
    return a, b


def token_hash(tok: str) -> int:
    return int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % PRIME


def signature_of(tokens, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash signature of a token set (plain Python tokens; tests and small inputs)."""
    h0 = np.fromiter((token_hash(t) for t in tokens), dtype=np.int64, count=len(tokens))
    return signature_of_hashes(h0, a, b)


def signature_of_hashes(h0: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash signature from the base hashes of a token set (NumPy; inside Arrow batches)."""
    if len(h0) == 0:
        return np.full(len(a), EMPTY_VALUE, dtype=np.int64)
    out = np.full(len(a), PRIME, dtype=np.int64)
    for at in range(0, len(h0), TOKEN_BLOCK):  # all tokens, in blocks: bounded memory for any document
        np.minimum(out, ((a[:, None] * h0[None, at:at + TOKEN_BLOCK] + b[:, None]) % PRIME).min(axis=1), out=out)
    return out


def base_hashes(text: str) -> "F.Column":
    """``h0`` of every distinct token, in the JVM: first 32 bits of md5(token) mod (2^31 - 1)."""
    return F.transform(distinct_tokens(text),
                       lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(PRIME)))


def band_keys_of(sig: np.ndarray, bands: int, rows: int) -> list[str]:
    return [
        hashlib.md5((f"{j}:" + ",".join(str(int(v)) for v in sig[j * rows:(j + 1) * rows])).encode()).hexdigest()
        for j in range(bands)
    ]


def _sketch_fn(num_perm: int, seed: int, bands: int, rows: int, with_signature: bool):
    a_list, b_list = perm_params(num_perm, seed)

    def run(batches):
        a = np.array(a_list, dtype=np.int64)
        b = np.array(b_list, dtype=np.int64)
        for batch in batches:
            pos = batch.column(0)
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            sigs = [signature_of_hashes(values[offsets[i]:offsets[i + 1]], a, b) for i in range(len(lists))]
            cols = {"pos": pos, "bands": pa.array([band_keys_of(s, bands, rows) for s in sigs], pa.list_(pa.string()))}
            if with_signature:
                cols["signature"] = pa.array([s.tolist() for s in sigs], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(cols)

    return run


def minhash(df: DataFrame, text: str = "text", pos: str = "pos", num_perm: int = DEF.DEDUP_NUM_PERM,
            threshold: float = DEF.DEDUP_THRESHOLD,
            bands: int | None = None, rows: int | None = None, seed: int = 1, with_signature: bool = False) -> DataFrame:
    """A8 + A9: ``(pos, bands array<string>[, signature array<bigint>])`` per document.

    The distinct token set and the per-token base hash are computed in the JVM; only arrays of
    longs cross to Python, where NumPy takes the 128 permuted minima per document.
    """
    if bands is None or rows is None:
        bands, rows = optimal_bands(threshold, num_perm)
    fields = [ST.StructField("pos", ST.LongType()), ST.StructField("bands", ST.ArrayType(ST.StringType()))]
    if with_signature:
        fields.append(ST.StructField("signature", ST.ArrayType(ST.LongType())))
    narrow = df.select(F.col(pos).cast("long").alias("pos"), base_hashes(text).alias("h0"))
    return narrow.mapInArrow(_sketch_fn(num_perm, seed, bands, rows, with_signature), ST.StructType(fields))


def lsh_buckets(sk: DataFrame) -> DataFrame:
    """``(band, key, pos)`` memberships of the band keys (one row per document and band)."""
    return sk.select("pos", F.posexplode("bands").alias("band", "key")).select(
        F.col("band").cast("int"), "key", "pos")


def peel(members: DataFrame, hot_bucket_rows: int = 100_000) -> DataFrame:
    """Dropped positions of the first-wins independent set over bucket memberships ``(band,key,pos)``.

    Buckets of one member constrain nothing and are left out first, so documents sharing no bucket
    never enter the rounds. Each round writes one "decided" table (kept and dropped, flagged) and the
    remaining memberships, both with a reliable checkpoint, so lineage stays one round deep.
    """
    keys = ["band", "key"]
    m0 = cut_lineage(members.select(*keys, "pos"))
    sizes = m0.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))  # partial aggregation: hot buckets are fine
    hot = cut_lineage(sizes.filter(F.col("_n") > hot_bucket_rows).select(*keys))  # <= |m| / hot rows
    small = hot.count() <= BROADCAST_MAX_ROWS
    hot = F.broadcast(hot) if small else hot
    shared_cold = sizes.filter((F.col("_n") > 1) & (F.col("_n") <= hot_bucket_rows)).select(*keys)
    m = cut_lineage(m0.join(hot, keys, "left_semi").unionByName(
        m0.join(hot, keys, "left_anti").join(shared_cold, keys, "left_semi")))
    drops = []
    while not m.isEmpty():  # each round decides at least the first document left
        mins = m.groupBy(*keys).agg(F.min("pos").alias("mp"))
        nfirst = mins.groupBy(F.col("mp").alias("pos")).agg(F.count(F.lit(1)).alias("_first"))
        deg = m.groupBy("pos").agg(F.count(F.lit(1)).alias("_deg"))
        kept = deg.join(nfirst, "pos").filter(F.col("_deg") == F.col("_first")).select("pos")
        killed = mins.join(kept.withColumnRenamed("pos", "mp"), "mp").select(*keys)
        killed_hot = killed.join(hot, keys, "left_semi")
        killed_hot = F.broadcast(killed_hot) if small else killed_hot  # a subset of the size-checked table
        cold_m = m.join(hot, keys, "left_anti")
        hot_m = m.join(hot, keys, "left_semi")
        hit = cold_m.join(killed, keys, "left_semi").unionByName(hot_m.join(killed_hot, keys, "left_semi"))
        dropped = hit.select("pos").distinct().join(kept, "pos", "left_anti")
        decided = cut_lineage(kept.withColumn("_kept", F.lit(True)).unionByName(dropped.withColumn("_kept", F.lit(False))))
        drops.append(decided.filter(~F.col("_kept")).select("pos"))
        m = cut_lineage(m.join(decided, "pos", "left_anti"))
    if not drops:
        return members.sparkSession.createDataFrame([], "pos bigint")
    out = drops[0]
    for d in drops[1:]:
        out = out.unionByName(d)
    return out


def dropped_positions(sk: DataFrame, hot_bucket_rows: int = 100_000) -> DataFrame:
    """Positions dropped by first-wins dedup, from sketches ``(pos, bands)`` (written)."""
    # Identical band sets have the same neighbours: all but the first copy are dropped (partial agg).
    reps = sk.groupBy("bands").agg(F.min("pos").alias("pos"))
    copies = sk.select("pos").join(reps.select("pos"), "pos", "left_anti")
    dropped = peel(lsh_buckets(sk.join(reps.select("pos"), "pos", "left_semi")), hot_bucket_rows)
    return copies.unionByName(dropped)


def near_dedup(df: DataFrame, order: str, text: str = "text", threshold: float = DEF.DEDUP_THRESHOLD,
               num_perm: int = DEF.DEDUP_NUM_PERM, bands: int | None = None, rows: int | None = None, seed: int = 1,
               hot_bucket_rows: int = 100_000) -> DataFrame:
    """Rows of ``df`` kept by first-wins MinHash-LSH dedup in ``order`` (a unique integral key)."""
    sk = cut_lineage(minhash(df, text, order, num_perm, threshold, bands, rows, seed))
    gone = checked_broadcast(dropped_positions(sk, hot_bucket_rows).withColumnRenamed("pos", order))  # written, counted
    return df.join(gone, order, "left_anti")
