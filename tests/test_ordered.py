"""Order-dependent operators by hand-made cases and plain windows."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import ordered as O
from tests.conftest import SF_MID, rows


def longest_prefix(ns, cap):
    """The documents of the longest prefix whose tokens stay within the cap."""
    return [i for i, total in enumerate(accumulate(ns)) if total <= cap]


def frame(spark, ns, source="s"):
    return spark.createDataFrame([(source, i, n) for i, n in enumerate(ns)], "source string, doc_id long, n_tokens long")


def kept_ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_budget_stops_not_skips_h1(spark):
    assert kept_ids(O.token_budget(frame(spark, [5, 9, 1]), 10)) == [0]


def test_budget_edges_h2(spark):
    assert kept_ids(O.token_budget(frame(spark, [0, 0, 3, 0]), 0)) == [0, 1]
    assert kept_ids(O.token_budget(frame(spark, [2, 3, 5]), 10)) == [0, 1, 2]
    assert kept_ids(O.token_budget(frame(spark, [4, 7, 0, 0]), 10)) == [0]


@pytest.mark.parametrize("seed,cap", [(1, 400), (2, 0), (3, 3000)])
def test_budget_is_the_longest_prefix(spark, seed, cap):
    rnd = random.Random(seed)
    ns = [rnd.randint(0, 50) for _ in range(60)]
    assert kept_ids(O.token_budget(frame(spark, ns), cap)) == longest_prefix(ns, cap)


def test_positions_in_the_order_of_several_keys(spark):
    """Keys are columns: any number of lines in a document, any document number."""
    data = [(2**31 + 5, i, i % 3) for i in range(70_000)] + [(0, 65_536, 0), (1, 0, 0), (-4, 2**40, 7), (-4, 3, 9)]
    df = spark.createDataFrame(data, "doc long, line long, chunk long").repartition(7)
    got = O.ordered_position(df, ["doc", "line", "chunk"]).collect()
    want = {k: i for i, k in enumerate(sorted(data))}
    assert len(got) == len(data) and all(want[r["doc"], r["line"], r["chunk"]] == r["pos"] for r in got)


def test_positions_of_pieces_stay_in_the_jvm(spark):
    """The pieces of a row follow each other, rows with equal keys included; wide rows never pass through Python."""
    data = [(k % 40, [f"{k}.{i}" for i in range(k % 4)]) for k in range(300)]
    df = spark.createDataFrame(data, "k long, own array<string>").repartition(6)
    placed = O.ordered_position(df, ["k"], pieces="own", idx="at")
    got = sorted(placed.collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in got] == list(range(sum(len(p) for _, p in data)))
    assert [r["k"] for r in got] == sorted(k for k, p in data for _ in p)
    for a, b in zip(got, got[1:]):  # a row's pieces in their order, side by side
        assert b["at"] == 0 or (b["at"] == a["at"] + 1 and a["own"].split(".")[0] == b["own"].split(".")[0])


def test_running_sum_equals_plain_window_any_partitioning(spark):
    d = spark.read.parquet(f"{SF_MID}/documents.parquet").select("source", "doc_id", "n_chars")
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    expect = rows(d.withColumn("cum", F.sum("n_chars").over(w)), "source", "doc_id", "cum")
    for parts, buckets in ((1, 1), (4, 3), (13, 40)):
        shuffled = d.repartition(parts).orderBy(F.rand(7))
        got = O.running_sum(shuffled, "n_chars", "doc_id", "source", "cum", n_buckets=buckets)
        assert rows(got, "source", "doc_id", "cum") == expect


def test_interleave_h3(spark):
    data = [(s, i) for s, c in ((0, 3), (1, 4), (2, 5)) for i in range(c)]
    df = spark.createDataFrame(data, "source_idx int, doc_id long")
    first = O.interleave(df, strategy="first_exhausted").orderBy("pos").collect()
    assert [(r["source_idx"], r["doc_id"]) for r in first] == [(s, r) for r in range(3) for s in range(3)]
    assert [r["pos"] for r in first] == list(range(9))
    allx = O.interleave(df, strategy="all_exhausted").orderBy("pos").collect()
    assert len(allx) == 15
    assert [(r["source_idx"], r["doc_id"]) for r in allx] == [(s, r % c) for r in range(5) for s, c in ((0, 3), (1, 4), (2, 5))]


def test_interleave_partial_round(spark):
    data = [(s, i) for s, c in ((0, 4), (1, 3), (2, 3), (3, 5)) for i in range(c)]
    df = spark.createDataFrame(data, "source_idx int, doc_id long")
    got = [(r["source_idx"], r["doc_id"]) for r in O.interleave(df, last_round="partial").orderBy("pos").collect()]
    assert got == [(s, r) for r in range(3) for s in range(4)][:10]  # ends with the last row of source 1


def test_row_cap_and_epochs(spark):
    df = frame(spark, [1] * 10, "a").unionByName(frame(spark, [1] * 3, "b"))
    assert rows(O.row_cap(df, 4), "source", "doc_id") == [("a", i) for i in range(4)] + [("b", i) for i in range(3)]
    rep = O.repeat_epochs(df.withColumn("pos", F.col("doc_id")), 3)
    assert rep.count() == 39 and rep.select("epoch").distinct().count() == 3


def test_global_position_and_batches(spark):
    keys = random.Random(3).sample(range(10_000), 500)
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    pos = O.global_position(df, "k")
    assert rows(pos, "k", "pos") == [(k, i) for i, k in enumerate(sorted(keys))]
    b = O.batch_plan(pos, 8, 2, world_size=2).filter(F.col("pos") == 13).first()
    assert (b["batch_id"], b["micro_id"], b["accum_steps"]) == (1, 2, 2)


def test_rank_split_is_a_partition(spark):
    d = spark.read.parquet(f"{SF_MID}/documents.parquet")
    parts = [O.rank_split(d, 4, rank=r).count() for r in range(4)]
    assert sum(parts) == d.count() and min(parts) > 0
