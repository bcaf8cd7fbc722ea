"""Shards, packing, sequences and the global index (H7-H13, H16): hand-made cases and the properties that define them."""

import random
from itertools import accumulate, groupby, pairwise

import pytest
from pyspark.sql import functions as F

from quarry.functions import sequences as SQ
from quarry.operators import shards as SH


def shards_of(spark, ns, S, mode, drop_tail=False):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(ns)], "pos long, n_tokens long")
    got = SH.token_shards(df, S, "pos", mode=mode, drop_tail=drop_tail)
    return [r["shard"] for r in got.orderBy("pos").collect()]


def test_shard_reset_and_balanced_h7(spark):
    ns = [6, 6, 6, 6, 1]
    assert shards_of(spark, ns, 10, "reset") == [0, 0, 1, 1, 2]
    assert shards_of(spark, ns, 10, "reset", drop_tail=True) == [0, 0, 1, 1]
    assert shards_of(spark, ns, 10, "balanced") == [0, 0, 1, 1, 2]


def test_shard_overshoot_h8(spark):
    assert shards_of(spark, [25, 1], 10, "reset") == [0, 1]
    assert shards_of(spark, [25, 1], 10, "reset", drop_tail=True) == [0]
    assert shards_of(spark, [25, 1], 10, "balanced") == [0, 1]


@pytest.mark.parametrize("seed,S", [(1, 1), (2, 40)])
def test_reset_shards_by_property(spark, seed, S):
    rnd = random.Random(seed)
    ns = [rnd.randint(0, 30) for _ in range(80)]
    shards = shards_of(spark, ns, S, "reset")
    assert shards[0] == 0 and all(b - a in (0, 1) for a, b in pairwise(shards))
    sizes = [[n for _, n in g] for _, g in groupby(zip(shards, ns), key=lambda x: x[0])]
    for own in sizes[:-1]:  # full, and only with the last document
        assert sum(own) >= S > sum(own[:-1])
    assert sum(sizes[-1][:-1]) < S


def pack(spark, seqs, L, pad, eos):
    df = spark.createDataFrame([(i * 3 - 7, s) for i, s in enumerate(seqs)], "pos long, ids array<bigint>").repartition(5)
    got = SH.pack_sequences(df, "ids", L, pad, eos, "pos").orderBy("pack").collect()
    assert [r["pack"] for r in got] == list(range(len(got)))
    return [list(r["input_ids"]) for r in got], [list(r["attention_mask"]) for r in got]


def check_packs(seqs, packs, L, pad, eos):
    """What defines next-fit packing: the packs without padding are the completed sequences in order; a pack is closed
    only where the next sequence would not have fitted; a sequence longer than a pack has packs of its own."""
    full = [s + [eos] if s and s[-1] != eos else s for s in seqs if s]
    bodies = [p[: max((i + 1 for i, x in enumerate(p) if x != pad), default=0)] for p in packs]
    assert all(len(p) == L for p in packs)
    assert [x for b in bodies for x in b] == [x for s in full for x in s]
    ends = list(accumulate(len(s) for s in full))
    starts = [0, *ends]
    at = 0
    for k, body in enumerate(bodies):
        i = max(j for j, x in enumerate(starts[:-1]) if x <= at)  # the sequence that the pack begins in
        if len(full[i]) > L:
            assert (at - starts[i]) % L == 0 and len(body) == min(L, ends[i] - at)
        else:
            assert starts[i] == at
            last = at + len(body)
            assert last in ends
            if k + 1 < len(bodies):
                assert len(body) + len(full[ends.index(last) + 1]) > L
        at += len(body)


def test_packing_h9(spark):
    ids, mask = pack(spark, [[1, 2], [3], [4, 9], [], [5, 6, 7, 8]], 4, 0, 9)
    assert ids == [[1, 2, 9, 0], [3, 9, 4, 9], [5, 6, 7, 8], [9, 0, 0, 0]]
    assert mask == [[1, 1, 1, 0], [1, 1, 1, 1], [1, 1, 1, 1], [1, 0, 0, 0]]
    assert pack(spark, [[1], [2], [3], [4]], 8, 0, 9)[0] == [[1, 9, 2, 9, 3, 9, 4, 9]]
    assert pack(spark, [[], []], 8, 0, 9) == ([], [])


def test_packing_by_property(spark):
    rnd, L = random.Random(7), 9
    seqs = [[rnd.randint(1, 8) for _ in range(rnd.randint(0, 21))] for _ in range(60)]
    check_packs(seqs, pack(spark, seqs, L, 0, 9)[0], L, 0, 9)


def test_packing_crosses_every_bucket_edge(spark):
    """One stream, many order buckets: no pack is closed early."""
    seqs = [[i % 7 + 1] * (i * i % 11) for i in range(1500)]
    check_packs(seqs, pack(spark, seqs, 50, 0, 9)[0], 50, 0, 9)


def test_chain_starts(spark):
    nxt = [min(k + 1 + k * k % 13, 1000) for k in range(1000)]
    df = spark.createDataFrame([(k, n if n < 1000 else None) for k, n in enumerate(nxt)], "_k long, _next long")
    want, k = [], 3
    while k < 1000:
        want.append(k)
        k = nxt[k]
    assert sorted(r[0] for r in SH.chain_starts(df, 3).collect()) == want


def arr(spark, rows, col="ids"):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {col} array<bigint>")


def test_chunks_h10(spark):
    L = 3
    df = arr(spark, [[1, 2, 3], [1, 2, 3, 4], [1, 2, 3, 4, 5, 6], []])
    got = {r["i"]: [list(c) for c in r["c"]] for r in df.select("i", SQ.chunks("ids", L).alias("c")).collect()}
    assert got == {0: [[1, 2, 3]], 1: [[1, 2, 3], [4]], 2: [[1, 2, 3], [4, 5, 6]], 3: [[]]}


def test_eos_h11(spark):
    df = arr(spark, [[1, 9], [], [1, 2]])
    a = [list(r[0]) for r in df.orderBy("i").select(SQ.append_eos("ids", 9, "if_missing")).collect()]
    b = [list(r[0]) for r in df.orderBy("i").select(SQ.append_eos("ids", 9, "always")).collect()]
    assert a == [[1, 9], [], [1, 2, 9]]
    assert b == [[1, 9, 9], [9], [1, 2, 9]]


def test_pad_equals_eos_mask_h12_and_truncation_h13(spark):
    df = arr(spark, [[1], [1, 2, 3, 4, 5, 6]]).withColumn("e", F.lit(False))
    ids, mask = SQ.fixed_length("ids", F.col("e"), 3, 9)
    got = df.orderBy("i").select(ids.alias("a"), mask.alias("m")).collect()
    assert [list(r["a"]) for r in got] == [[1, 9, 9], [1, 2, 3]]
    assert [list(r["m"]) for r in got] == [[1, 0, 0], [1, 1, 1]]
    ids2, mask2 = SQ.fixed_length("ids", F.col("e"), 3, 9, mask_mode="length")
    assert list(df.orderBy("i").select(mask2).first()[0]) == [1, 1, 0]
    full, fmask = SQ.fixed_length("ids", F.lit(True), 3, 9)
    r = df.select(full, fmask).first()
    assert list(r[0]) == [9, 9, 9] and list(r[1]) == [0, 0, 0]


def test_global_index_lookup_h16(spark):
    lens = {0: 3, 1: 0, 2: 2}
    seqs = spark.createDataFrame([(s, i) for s, n in lens.items() for i in range(n)], "shard long, local_idx long")
    offs = SH.shard_offsets(seqs).unionByName(
        spark.createDataFrame([(1, 0, 3, 3)], "shard long, n long, lo long, hi long"))
    idx = spark.createDataFrame([(i,) for i in (0, 2, 3, 4, 5)], "idx long")
    got = sorted(tuple(r) for r in SH.lookup_global_index(idx, offs).collect())
    assert got == [(0, 0, 0), (2, 0, 2), (3, 2, 0), (4, 2, 1)]


def test_lookup_with_one_huge_shard(spark):
    offs = spark.createDataFrame([(0, 1, 0, 1), (1, 10**12, 1, 10**12 + 1), (2, 5, 10**12 + 1, 10**12 + 6)], "shard long, n long, lo long, hi long")
    idx = spark.createDataFrame([(0,), (1,), (10**12,), (10**12 + 1,), (10**12 + 5,), (10**12 + 6,), (-1,)], "idx long")
    got = sorted(tuple(r) for r in SH.lookup_global_index(idx, offs).collect())
    assert got == [(0, 0, 0), (1, 1, 0), (10**12, 1, 10**12 - 1), (10**12 + 1, 2, 0), (10**12 + 5, 2, 4)]
