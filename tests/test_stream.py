"""Stream = batch, including a restart between ranges (no loss, no duplicates)."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import ordered as O
from quarry.streaming import stream as ST
from tests.conftest import SF_SMALL, rows


def test_token_budget_stream_equals_batch(spark):
    """Each range is taken by a new run from the checkpoint: nothing is lost or taken twice."""
    p = ST.fresh(spark, "test-stream")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "source", "text")
    caps = {f"src{i}": 500 + 100 * i for i in range(0, 20, 2)}  # the others have no limit

    def run():
        s = ST.file_stream(spark, p["input"], docs.schema)
        counted = s.select("source", "doc_id", T.whitespace_token_count("text").alias("n_tokens"))
        ST.stream_token_budget(counted, caps, p["out"], p["state"], p["ckpt"])

    ST.feed(docs, p["input"], "doc_id", 4, run)
    got = rows(spark.read.parquet(p["out"]), "source", "doc_id")
    batch = O.token_budget(docs.withColumn("n_tokens", T.whitespace_token_count("text")), caps)
    assert got == rows(batch, "source", "doc_id") and len(got) == len(set(got))
    kept = sorted(f for f in os.listdir(p["state"].removeprefix("file:")) if f.startswith("batch_id="))
    assert kept == ["batch_id=2", "batch_id=3"]  # older state is gone


def test_a_missing_state_fails_the_batch(spark):
    p = ST.fresh(spark, "test-lost-state")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "source", "text")
    runs = []

    def run():
        if runs:
            ST._delete(spark, p["state"])
        s = ST.file_stream(spark, p["input"], docs.schema)
        counted = s.select("source", "doc_id", T.whitespace_token_count("text").alias("n_tokens"))
        ST.stream_token_budget(counted, 800, p["out"], p["state"], p["ckpt"])
        runs.append(1)

    with pytest.raises(Exception, match="PATH_NOT_FOUND|Path does not exist"):
        ST.feed(docs, p["input"], "doc_id", 2, run)
    assert len(runs) == 1


def test_bpe_examples_stream_equals_batch(spark):
    import __spark_entry__ as E

    got = rows(E.queries()["stream_bpe_fixed_length"](spark, SF_SMALL))
    from quarry.plans import catalog as C
    from quarry.plans import corpus as CP

    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    ex = CP.fixed_length_examples(d, C.BPE, C.BPE_SEQ, ["doc_id"])
    batch = ex.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("attention_mask", ",").alias("attention_mask"))
    assert got == rows(batch)


def test_stream_dedup_with_compaction_equals_batch(spark):
    from quarry.operators import dedup as D

    p = ST.fresh(spark, "test-stream-dedup")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "source", "text")
    def run():
        ST.stream_near_dedup(ST.file_stream(spark, p["input"], docs.schema), p["out"], p["state"], p["ckpt"], compact_every=2)

    ST.feed(docs, p["input"], "doc_id", 7, run)
    got = rows(spark.read.parquet(p["out"]), "doc_id")
    assert got == rows(D.near_dedup(docs, "doc_id"), "doc_id")
    left = sorted(f for f in os.listdir(p["state"].removeprefix("file:")) if "=" in f)
    assert left == ["batch_id=4", "batch_id=5", "batch_id=6", "upto=4", "upto=6"]


def test_event_windows_drop_late_rows_and_restart(spark):
    """Rows before and after the watermark, each batch a new run from the checkpoint."""
    p = ST.fresh(spark, "test-windows")
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    batches = [[("a", 5, 1.0), ("a", 50, 3.0), ("b", 70, 5.0)],  # watermark 40 minutes after midnight
               [("a", 55, 8.0), ("a", 45, 9.0), ("b", 190, 1.0)],  # 00:45 is behind no window's end; watermark 02:40
               [("a", 59, 100.0), ("b", 161, 2.0)],  # 00:59: its window has ended and is dropped
               [("c", 400, 7.0)]]
    data = [(kind, at(m), v, b) for b, own in enumerate(batches) for kind, m, v in own]
    for ntz in ("timestamp", "timestamp_ntz"):
        p = ST.fresh(spark, f"test-windows-{ntz}")
        df = spark.createDataFrame(data, "kind string, ts string, value double, b int").withColumn("ts", F.col("ts").cast(ntz))

        def run():
            s = ST.file_stream(spark, p["input"], df.drop("b").schema)
            ST.stream_event_windows(s, "1 hour", "30 minutes", p["out"], p["ckpt"], ["kind"])

        ST.feed_batches(df, p["input"], "b", 4, run)
        got = [(r.kind, r.window_start.hour, r.n, r.mean_value, r.max_value) for r in spark.read.parquet(p["out"]).collect()]
        assert sorted(got) == [("a", 0, 4, 5.25, 9.0), ("b", 1, 1, 5.0, 5.0), ("b", 2, 1, 2.0, 2.0), ("b", 3, 1, 1.0, 1.0)]
