"""Shards, packing and the global index.

Everything here runs on narrow integer projections (order key, length); wide rows (text, ids) are
only joined back on an equi-key. Nothing is folded in one task:

* ``token_shards(mode="balanced")``: a document goes to shard ``start_offset div S`` (then dense
  numbering) -- a prefix sum, fully parallel.
* ``token_shards(mode="reset")`` and ``pack_lengths`` close a bin and start anew, over the whole ordered stream. The bin that
  starts at row ``j`` is followed by the one at ``next(j)``, found for all rows at once by a running minimum over the
  merged, sorted prefix sums. The chain of starts is resolved by :func:`chain_starts`: each order bucket
  shortens its part of the chain to its exits in one local pass, the few exits are chained by
  pointer doubling (log2(#buckets) rounds over a small table), and each bucket marks its starts from its one entry.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.sequences import append_eos, chunks, pad
from quarry.operators.ordered import (apply_buckets, bucket_splits, checked_broadcast, running_agg,
                                     running_count, running_sum)
from quarry.session import cut_lineage
from quarry import defaults as DEF


# ---------------------------------------------------------------- token-sized shards
def _dense_ids(df: DataFrame, raw: str, out: str) -> DataFrame:
    ids = running_count(df.select(raw).distinct(), raw, None, "_dense")
    ids = checked_broadcast(ids.select(raw, (F.col("_dense") - 1).alias(out)))
    return df.join(ids, raw).drop(raw)


def _first_at_least(data: DataFrame, queries: DataFrame) -> DataFrame:
    """``data`` (_k, _x) with _x not falling in _k, ``queries`` (_k, _t): for every query the first _k of ``data`` with
    _x >= _t, as ``_next`` (null: none)."""
    data = data.select((F.col("_x") * 2 + 1).alias("_key2"), F.col("_k").alias("_val"), F.lit(None).cast("long").alias("_q"))
    queries = queries.select((F.col("_t") * 2).alias("_key2"), F.lit(None).cast("long").alias("_val"), F.col("_k").alias("_q"))
    # descending order = ascending negated key; running min of the keys at or after the query
    merged = data.unionByName(queries).withColumn("_neg", -F.col("_key2"))
    res = running_agg(merged, "_val", "_neg", None, "_next", agg="min", inclusive=True)
    return res.filter(F.col("_q").isNotNull()).select(F.col("_q").alias("_k"), F.col("_next"))


def _by_bucket(batches):
    """The rows of each bucket together: (bucket, columns). A bucket is a bounded share of the rows."""
    held = None
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if held is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(held, rows)]
        if not len(rows[0]):
            continue
        edges = [0, *(np.flatnonzero(np.diff(rows[0])) + 1), len(rows[0])]
        for a, b in zip(edges[:-2], edges[1:-1]):
            yield [r[a:b] for r in rows]
        held = [r[edges[-2]:] for r in rows]
    if held is not None:
        yield held


NONE = -(2**63)  # no successor


def _exits(batches):
    """(bucket, k, next) -> (k, exit): the first place beyond the bucket that the chain from k comes to."""
    for _, k, nxt in _by_bucket(batches):
        at = np.searchsorted(k, nxt)
        inside = (nxt != NONE) & (at < len(k))
        inside[inside] &= k[at[inside]] == nxt[inside]
        jump = np.where(inside, at, np.arange(len(k)))
        while True:  # pointer doubling inside the bucket
            further = jump[jump]
            if (further == jump).all():
                break
            jump = further
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(nxt[jump])], ["_k", "_exit"])


def _marks(batches):
    """(bucket, k, next, entry) -> the k that the chain from the bucket's entry comes to."""
    for _, k, nxt, entry in _by_bucket(batches):
        at = np.searchsorted(k, nxt)
        inside = (nxt != NONE) & (at < len(k))
        inside[inside] &= k[at[inside]] == nxt[inside]
        on = np.flatnonzero(entry)
        reach = np.zeros(len(k), bool)
        reach[on] = True
        while len(on):
            on = on[inside[on]]
            on = at[on]
            on = on[~reach[on]]
            reach[on] = True
        yield pa.RecordBatch.from_arrays([pa.array(k[reach])], ["_k"])


def chain_starts(nxt: DataFrame, first: int) -> DataFrame:
    """The ``_k`` of the chain first, next(first), next(next(first)), ... over ``nxt`` (_k, _next; null ends it; next > k)."""
    nxt = nxt.select("_k", F.coalesce("_next", F.lit(NONE)).alias("_next"))
    splits = bucket_splits(nxt, "_k")
    nxt = cut_lineage(apply_buckets(nxt, "_k", splits).select(F.col("_bkt").cast("long").alias("_bkt"), "_k", "_next"))
    dealt = lambda df: df.repartition("_bkt").sortWithinPartitions("_bkt", "_k")
    exits = cut_lineage(dealt(nxt).mapInArrow(_exits, "_k long, _exit long").filter(F.col("_exit") != NONE))
    targets = exits.select(F.col("_exit").alias("_k")).distinct().unionByName(
        nxt.sparkSession.createDataFrame([(int(first),)], "_k long")).distinct()
    jump = cut_lineage(exits.join(checked_broadcast(targets), "_k", "left_semi").withColumnRenamed("_exit", "_j"))
    chain = nxt.sparkSession.createDataFrame([(int(first),)], "_k long")
    rounds = max(1, math.ceil(math.log2(len(splits) + 1)))  # a step leaves a bucket for good
    for r in range(rounds):
        # chain = {exit^m(first) : m < 2^r}; the new places exit^(m + 2^r) are disjoint from it
        chain = cut_lineage(chain.unionByName(jump.join(chain, "_k").select(F.col("_j").alias("_k"))))
        if r + 1 < rounds:  # jump_{r+1}(k) = jump_r(jump_r(k))
            jump = cut_lineage(jump.alias("a").join(jump.alias("b"), F.col("a._j") == F.col("b._k"))
                               .select(F.col("a._k").alias("_k"), F.col("b._j").alias("_j")))
    entries = F.broadcast(chain.withColumn("_entry", F.lit(True)))  # at most one row a bucket
    marked = nxt.join(entries, "_k", "left").select("_bkt", "_k", "_next", F.coalesce("_entry", F.lit(False)).alias("_entry"))
    return cut_lineage(dealt(marked).mapInArrow(_marks, "_k long"))


def token_shards(df: DataFrame, shard_tokens: int, order: str, n_col: str = "n_tokens", mode: str = "balanced",
                 drop_tail: bool = False, out: str = "shard") -> DataFrame:
    """Assign every row a token-sized shard id (0-based) in ``order`` (unique integral key).

    ``drop_tail=True`` omits the last shard when it holds fewer than ``shard_tokens`` tokens, as the
    reference does (it never flushes that buffer, D4); the default keeps it.
    """
    narrow = df.select(F.col(order).cast("long").alias("_k"), F.col(n_col).cast("long").alias("_n"))
    cum = running_sum(narrow, "_n", "_k", None, "_e").withColumn("_s", F.col("_e") - F.col("_n"))
    cum = cut_lineage(cum)
    if mode == "balanced":
        ids = _dense_ids(cum.withColumn("_raw", F.floor(F.col("_s") / shard_tokens).cast("long")), "_raw", out)
    elif mode == "reset":
        ids = _reset_shards(cum, shard_tokens, out)
    else:
        raise ValueError(mode)
    ids = cut_lineage(ids.select("_k", "_n", out))
    if drop_tail:
        totals = ids.groupBy(out).agg(F.sum("_n").alias("_tot"))
        last = totals.agg(F.max(out).alias(out))
        tail = last.join(totals, out).filter(F.col("_tot") < shard_tokens).select(out)
        ids = ids.join(F.broadcast(tail), out, "left_anti")  # at most one row
    return df.join(ids.select(F.col("_k").alias(order), out), order)


def _reset_shards(cum: DataFrame, shard_tokens: int, out: str) -> DataFrame:
    first = cum.agg(F.min("_k")).first()[0]
    if first is None:
        return cum.withColumn(out, F.lit(0).cast("long"))
    nxt = _first_at_least(cum.select("_k", F.col("_s").alias("_x")), cum.select("_k", (F.col("_s") + max(shard_tokens, 1)).alias("_t")))
    starts = chain_starts(nxt, first).withColumn("_start", F.lit(1))
    flagged = cum.join(starts, "_k", "left").withColumn("_start", F.coalesce("_start", F.lit(0)))
    ids = running_sum(flagged, "_start", "_k", None, "_sid")
    return ids.withColumn(out, (F.col("_sid") - 1).cast("long"))


# ---------------------------------------------------------------- count-sized shards / index
def shard_offsets(seqs: DataFrame, shard: str = "shard") -> DataFrame:
    """A2 + W6 on shards: ``(shard, n, lo, hi)`` -- the cumulative lengths, one row per shard."""
    counts = seqs.groupBy(shard).agg(F.count(F.lit(1)).alias("n"))
    cum = running_sum(counts, "n", shard, None, "hi")
    return cum.select(shard, "n", (F.col("hi") - F.col("n")).alias("lo"), "hi")


def count_shard_offsets(seqs: DataFrame, shard_size: int, shard: str = "shard") -> DataFrame:
    """A2 on count shards, which begin at multiples of ``shard_size``: ``(shard, n, lo, hi)`` by one aggregation."""
    counts = seqs.groupBy(F.col(shard).cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("shard", "n", (F.col("shard") * shard_size).alias("lo"), (F.col("shard") * shard_size + F.col("n")).alias("hi"))


def shard_name(shard, fmt: str = DEF.SEQ_SHARD_NAME) -> "F.Column":
    """the shard's name, ``shard_%06d`` for sequence shards, ``shard_%05d`` for text shards."""
    return F.format_string(fmt, F.col(shard) if isinstance(shard, str) else shard)


def lookup_global_index(index: DataFrame, offsets: DataFrame, idx: str = "idx", shard: str = "shard") -> DataFrame:
    """Global index -> ``(shard, local_idx)``; an index beyond the last sequence gives no row.

    An equi-join on index blocks: a shard is listed under every block of the index space that it
    touches (about two, since a block is as wide as an average shard), an index under its own.
    """
    nonempty = cut_lineage(offsets.filter(F.col("n") > 0).select(shard, "lo", "hi"))
    shards, total = nonempty.agg(F.count(F.lit(1)), F.max("hi")).first()
    width = max(1, (total or 0) // max(shards, 1))
    block = lambda c: F.floor(c / F.lit(width)).cast("long")
    table = nonempty.withColumn("_blk", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi") - 1))))
    hits = index.select(F.col(idx).cast("long").alias(idx)).withColumn("_blk", block(F.col(idx))).join(table, "_blk")
    return hits.filter((F.col(idx) >= F.col("lo")) & (F.col(idx) < F.col("hi"))).select(
        idx, shard, (F.col(idx) - F.col("lo")).alias("local_idx"))


# ---------------------------------------------------------------- packing
def pack_lengths(df: DataFrame, length_col: str, seq_length: int, pos: str) -> DataFrame:
    """W5 on lengths only, over the whole stream in the order of ``pos`` (unique): ``(pos, pack, offset, n_packs)``.

    A sequence joins the open pack if it fits, else it opens the next; one longer than ``seq_length`` takes
    ``n_packs`` packs of its own and leaves none open. Empty sequences add nothing and have no row.
    """
    rows = df.select(F.col(pos).cast("long").alias("_k"), F.col(length_col).cast("long").alias("_n")).filter(F.col("_n") > 0)
    cum = cut_lineage(running_sum(rows, "_n", "_k", None, "_x"))
    first = cum.agg(F.min("_k")).first()[0]
    out = [F.col("_k").alias(pos), "pack", "offset", "n_packs"]
    if first is None:
        return cum.select(F.col("_k").alias(pos), *[F.lit(0).cast("long").alias(c) for c in out[1:]])
    begin = F.col("_x") - F.col("_n")
    alone = F.col("_n") > seq_length
    # the next start is the first sequence that ends beyond what the pack holds; after a long one, the next at all
    nxt = _first_at_least(cum.select("_k", "_x"), cum.select("_k", (F.when(alone, F.col("_x")).otherwise(begin + seq_length) + 1).alias("_t")))
    starts = chain_starts(nxt, first).withColumn("_start", F.lit(True))
    n_packs = F.when(alone, F.ceil(F.col("_n") / seq_length)).otherwise(1).cast("long")
    rows = cut_lineage(cum.withColumn("n_packs", n_packs).join(starts, "_k", "left").withColumns(
        {"_opens": F.when(F.col("_start"), F.col("n_packs")).otherwise(0), "_from": F.when(F.col("_start"), begin)}))
    rows = running_sum(rows, "_opens", "_k", None, "_upto")
    rows = running_agg(rows, "_from", "_k", None, "_base", agg="max")  # starts rise with the order
    own = F.when(F.col("_start"), F.col("n_packs")).otherwise(1)
    return rows.withColumn("pack", F.col("_upto") - own).withColumn("offset", begin - F.col("_base")).select(*out)


def pack_sequences(df: DataFrame, ids: str, seq_length: int, pad_id: int, eos: int, pos: str,
                   eos_mode: str = "if_missing") -> DataFrame:
    """Packed examples ``(pack, input_ids, attention_mask)`` of the whole stream, each ``seq_length`` long.

    The sequences are written once; packs are planned on ``(pos, length)``; one join brings the ids
    to their packs, where pieces are ordered by offset, flattened and padded in the JVM. A pack holds
    at most ``seq_length`` ids, so every collected group is bounded.
    """
    seqs = df.select(F.col(pos).cast("long").alias(pos), append_eos(ids, eos, eos_mode).alias("_ids"))
    seqs = cut_lineage(seqs.withColumn("_len", F.size("_ids")))
    placed = pack_lengths(seqs, "_len", seq_length, pos)
    j = seqs.join(placed, pos)
    pieces = j.select("offset", F.posexplode(chunks("_ids", seq_length)).alias("_j", "_piece"), "pack")
    pieces = pieces.select((F.col("pack") + F.col("_j")).alias("pack"), "offset", "_piece")
    packs = pieces.groupBy("pack").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "_piece"))), lambda s: s["_piece"])).alias("_flat"))
    input_ids = pad(F.col("_flat"), seq_length, pad_id)
    return packs.select("pack", input_ids.alias("input_ids"),
                        F.transform(input_ids, lambda x: (x != F.lit(pad_id)).cast("long")).alias("attention_mask"))


def count_shard_chunks(df: DataFrame, ids: str, seq_length: int) -> DataFrame:
    """F8 over a table: one row per chunk ``(chunk_idx, chunk)`` (``[]`` gives one empty chunk)."""
    return df.select("*", F.posexplode(chunks(ids, seq_length)).alias("chunk_idx", "chunk")).drop(ids)
