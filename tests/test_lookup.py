"""Lookups read the shards' sizes from the job's table, and only the parts of the shards that they need."""

import re

import pytest
from pyspark.sql import functions as F

from quarry.plans import corpus as CP
from quarry.session import scratch_path
from quarry.sources import sinks as SK
from tests.conftest import rows



@pytest.fixture(scope="module")
def shards(spark):
    path = scratch_path(spark, "test-lookup")
    seqs = spark.range(1000).select((F.col("id") / 100).cast("long").alias("shard"), (F.col("id") % 100).alias("local_idx"),
                                    F.array(F.col("id"), F.col("id") + 1).alias("input_ids"))
    SK.write_sequence_shards(seqs, f"{path}/shards")
    from quarry.operators import shards as SH

    SH.count_shard_offsets(seqs, 100).write.parquet(f"{path}/shards/{SK.OFFSETS}")
    return f"{path}/shards"


def scans(df):
    return re.findall(r"PartitionFilters: \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", df._jdf.queryExecution().toString(), re.S)


def test_few_indices_open_few_shards(spark, shards):
    index = spark.createDataFrame([(5,), (7,), (342,)], "idx long")
    got = CP.read_sequences(spark, shards, index, 2, -1)
    assert rows(got, "idx", "shard", "local_idx") == [(5, 0, 5), (7, 0, 7), (342, 3, 42)]
    assert {tuple(r.input_ids) for r in got.collect()} == {(5, 6), (7, 8), (342, 343)}
    own = [s for s in scans(got) if "shard" in s[0]]
    assert own and all("(0,3)" in a.replace(" ", "") or "shard" in a and "IN" in a.upper() for a, _ in own)
    assert all("local_idx" in b for _, b in own)
    files = CP._only(SK.read_sequence_shards(spark, shards), spark.createDataFrame([(0, 5), (3, 42)], "shard long, local_idx long")).inputFiles()
    read = CP._only(SK.read_sequence_shards(spark, shards), spark.createDataFrame([(0, 5), (3, 42)], "shard long, local_idx long"))
    assert files and rows(read, "shard", "local_idx") == [(0, 5), (0, 42), (3, 5), (3, 42)]


def test_sizes_come_from_the_job_or_are_counted(spark, shards):
    want = [(s, 100, 100 * s, 100 * s + 100) for s in range(10)]
    assert rows(CP.sequence_offsets(spark, shards), "shard", "n", "lo", "hi") == want
    assert SK.read_sequence_shards(spark, shards).count() == 1000  # readers pass over the table beside the shards
    bare = scratch_path(spark, "test-bare")
    SK.write_sequence_shards(SK.read_sequence_shards(spark, shards), bare)
    assert rows(CP.sequence_offsets(spark, bare), "shard", "n", "lo", "hi") == want


def test_many_shards_or_none(spark, shards, monkeypatch):
    monkeypatch.setattr(CP, "PRUNED", 2)
    index = spark.range(0, 1200, 50).withColumnRenamed("id", "idx")
    assert rows(CP.read_sequences(spark, shards, index, 2, -1), "idx") == [(i,) for i in range(0, 1000, 50)]
    assert CP.read_sequences(spark, shards, index.filter("idx >= 1000"), 2, -1).count() == 0
    padded = CP.read_sequences(spark, shards, index, 3, -1, missing="pad").filter("idx = 1100").first()
    assert padded.input_ids == [-1, -1, -1] and padded.shard is None


def test_a_job_writes_its_sizes(spark):
    path = scratch_path(spark, "test-job")
    lines = spark.createDataFrame([(d, n, "w " * (3 * d + n + 1)) for d in range(5) for n in range(4)], "doc_id long, line_no long, value string")
    from quarry.plans.catalog import WORDS as words

    out = CP.chunked_sequences(lines, words, 4, 3, ["doc_id", "line_no"], path)
    n = out.count()
    assert rows(CP.sequence_offsets(spark, f"{path}/shards"), "lo", "hi") == [(a, min(a + 3, n)) for a in range(0, n, 3)]
    order = [(r.doc_id, r.line_no, r.chunk_idx) for r in out.orderBy("pos").collect()]
    assert order == sorted(order) and rows(out, "pos") == [(i,) for i in range(n)]
