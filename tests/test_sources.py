"""Registry, missing sources (H19), readiness, predicate pushdown, sinks round trip."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quarry.sources import registry as REG
from quarry.sources import sinks as SK
from quarry.sources.tables import documents_registry
from quarry.session import scratch_path
from tests.conftest import SF_SMALL


def test_missing_source_skip_or_fail_h19(spark):
    reg = documents_registry(SF_SMALL) + [REG.SourceSpec(name="gone", path=f"{SF_SMALL}/none.parquet")]
    df = REG.union_sources(spark, reg, on_error="skip", columns=["doc_id"])
    assert sorted(r[0] for r in df.select("source").distinct().collect()) == ["src0", "src1", "src2"]
    with pytest.raises(AnalysisException):
        REG.union_sources(spark, reg, on_error="fail")


def test_predicates_reach_the_scan(spark):
    reg = documents_registry(SF_SMALL, extra={"src0": {"predicate": (F.col("source") == "src0") & (F.col("lang") == "en")}})
    df = REG.union_sources(spark, reg, columns=["doc_id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(lang,en)" in plan


def test_readiness(spark):
    reg = [REG.SourceSpec(name="docs", path=f"{SF_SMALL}/documents.parquet"),
           REG.SourceSpec(name="gone", path=f"{SF_SMALL}/none.parquet")]
    per, summary = REG.source_readiness(spark, reg)
    s = summary.first()
    assert (s["successful"], s["total"], s["failed"]) == (1, 2, "gone")
    assert {r["source"]: r["verified_rows"] for r in per.collect()} == {"docs": 100, "gone": 0}


def test_sequence_shards_round_trip(spark):
    path = scratch_path(spark, "test-seq")
    df = spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [3]), (1, 0, [4, 5, 6])], "shard long, local_idx long, input_ids array<bigint>")
    SK.write_sequence_shards(df, path)
    back = SK.read_sequence_shards(spark, path).orderBy("shard", "local_idx").collect()
    assert [(r["shard"], r["local_idx"], list(r["input_ids"])) for r in back] == [(0, 0, [1, 2]), (0, 1, [3]), (1, 0, [4, 5, 6])]


def test_text_shards_are_json_lines(spark):
    path = scratch_path(spark, "test-jsonl")
    df = spark.createDataFrame([(0, 0, 'a "quoted" é'), (0, 1, "b"), (1, 2, "c")], "shard long, pos long, text string")
    SK.write_text_shards(df, path)
    import glob
    import json

    files = sorted(glob.glob(f"{path.replace('file:', '')}/shard_name=shard_00000/*.json"))
    lines = [json.loads(x) for f in files for x in open(f, encoding="utf-8")]
    assert lines == [{"text": 'a "quoted" é'}, {"text": "b"}]


def test_final_scans_read_only_needed_columns(spark):
    """Column pruning survives the scan spreading: no query reads columns it does not use."""
    import __spark_entry__ as E

    q = E.queries()
    budget = q["token_budget"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in budget and "lang" not in budget
    dedup = q["near_dedup"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    read = [ln for ln in dedup.splitlines() if "ReadSchema" in ln]
    assert read and all("text" not in ln for ln in read)


def test_json_source_with_declared_schema_and_nested_filter(spark):
    path = scratch_path(spark, "test-json-src")
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    d.select("doc_id", "text", F.struct(F.col("lang").alias("category")).alias("meta")).write.json(path)
    spec = REG.SourceSpec(name="j", path=path, format="json",
                          schema="doc_id bigint, text string, meta struct<category: string>",
                          predicate=F.col("meta.category") == "en")
    got = REG.open_source(spark, spec)
    assert got.count() == d.filter(F.col("lang") == "en").count()
