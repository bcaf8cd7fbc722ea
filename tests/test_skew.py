"""Skew: one source / one bucket holding a third of all rows must not land in one task, and the
answers stay exact."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import dedup as D
from quarry.operators import ordered as O
from tests.test_ordered import longest_prefix


def test_hot_source_is_spread_over_buckets(spark):
    rnd = random.Random(5)
    data = [("hot", i, rnd.randint(0, 9)) for i in range(3000)]
    data += [(f"s{i % 20}", 10_000 + i, rnd.randint(0, 9)) for i in range(6000)]
    df = spark.createDataFrame(data, "source string, doc_id long, n_tokens long")
    b = O.order_bucket(df, "doc_id", 32)
    per = b.filter(F.col("source") == "hot").groupBy("_bkt").count().collect()
    assert len(per) >= 8 and max(r["count"] for r in per) <= 3000 / 4  # the hot source spans many tasks
    kept = O.token_budget(df, 4_000)
    hot = sorted(r["doc_id"] for r in kept.filter(F.col("source") == "hot").collect())
    assert hot == longest_prefix([n for _, _, n in data[:3000]], 4_000)


def test_third_of_documents_are_copies(spark):
    texts = ["the same hot text " * 5] * 300 + [f"unique text number {i} " + "w" * (i % 7) for i in range(600)]
    rnd = random.Random(2)
    rnd.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "pos long, text string")
    for hot in (100_000, 10):  # default path and the hot-bucket path
        kept = sorted(r["pos"] for r in D.near_dedup(df, "pos", hot_bucket_rows=hot).collect())
        from tests.test_dedup import sequential_dedup
        assert kept == sequential_dedup(texts)


@pytest.mark.parametrize("counts", [[1], [3, 1, 7, 2]])
def test_interleave_all_exhausted_equals_cycle(spark, counts):
    data = [(s, i) for s, c in enumerate(counts) for i in range(c)]
    df = spark.createDataFrame(data, "source_idx int, doc_id long")
    got = [(r["source_idx"], r["doc_id"]) for r in O.interleave(df, strategy="all_exhausted").orderBy("pos").collect()]
    expect = [(s, r % c) for r in range(max(counts)) for s, c in enumerate(counts)]
    assert got == expect
    first = [(r["source_idx"], r["doc_id"]) for r in O.interleave(df).orderBy("pos").collect()]
    assert first == [(s, r) for r in range(min(counts)) for s in range(len(counts))]
