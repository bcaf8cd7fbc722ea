"""Readers that resume by rank and step (T7): against a loop, and by the plan."""

import pytest
from pyspark.sql import functions as F

from quarry.operators.ordered import rank_split
from quarry.sources import ranks as RK


def dealt(keyed, world, batch, micro):
    """{rank: [(step, micro, local_pos, key)]} by a loop over the keys in order."""
    out = {r: [] for r in range(world)}
    for key, rank in sorted(keyed):
        n, own = len(out[rank]), batch // world
        out[rank].append((n // own, n % own // micro, n, key))
    return out


def test_every_rank_resumes_at_every_step(spark, tmp_path):
    df = spark.range(1, 301).select((F.col("id") * 7 - 900).alias("doc_id"), F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("text"))
    path = str(tmp_path / "ranks")
    RK.write_rank_layout(df.orderBy(F.rand(2)), path, "doc_id", 3, 12, 2, 4)
    want = dealt([(r.doc_id, r["rank"]) for r in rank_split(df, 3).collect()], 3, 12, 2)
    text = {r.doc_id: r.text for r in df.collect()}
    for rank in range(3):
        last = want[rank][-1][0]
        for step in (-1, 0, 4, 5, last, last + 1):
            got = RK.read_rank(spark, path, rank, step).collect()
            assert sorted((r.step, r.micro, r.local_pos, r.doc_id) for r in got) == [w for w in want[rank] if w[0] >= step]
            assert all(r.text == text[r.doc_id] and r["rank"] == rank for r in got)
    assert RK.read_rank(spark, path, 7, 0).count() == 0
    segments = {(r["rank"], r.segment): (r.first_step, r.last_step, r.n) for r in RK.layout(spark, path).collect()}
    for (rank, segment), (first, last, n) in segments.items():
        steps = [w[0] for w in want[rank] if w[0] // 4 == segment]
        assert (first, last, n) == (steps[0], steps[-1], len(steps))
    assert RK.resume_steps(spark, path, 1.0) == {r: rows[-1][0] for r, rows in want.items()}


def test_a_resumed_reader_opens_later_folders_only(spark, tmp_path):
    path = str(tmp_path / "ranks")
    RK.write_rank_layout(spark.range(2_000).withColumnRenamed("id", "doc_id"), path, "doc_id", 2, 20, 5, 10)
    rows = RK.read_rank(spark, path, 1, 55)
    plan = rows._sc._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    filters = next(x for x in plan.splitlines() if x.startswith("PartitionFilters"))
    assert "(rank#" in filters and "(segment#" in filters and ">= 5" in filters
    assert "GreaterThanOrEqual(step,55)" in next(x for x in plan.splitlines() if x.startswith("PushedFilters"))
    assert {int(r[0]) for r in rows.select(F.regexp_extract("_metadata.file_path", r"segment=(\d+)", 1)).distinct().collect()} \
        == {r.segment for r in RK.layout(spark, path).filter("rank = 1 AND segment >= 5").collect()}


def test_empty_table_and_wrong_arguments(spark, tmp_path):
    path = str(tmp_path / "none")
    RK.write_rank_layout(spark.range(0).withColumnRenamed("id", "doc_id"), path, "doc_id", 2, 4, 2, 3)
    rows = RK.read_rank(spark, path, 0, 5)
    assert rows.count() == 0 and rows.columns[0] == "doc_id" and RK.resume_steps(spark, path, 0.5) == {}
    for world, batch, micro in ((3, 16, 1), (4, 2, 1), (2, 16, 3)):
        with pytest.raises(ValueError):
            RK.write_rank_layout(spark.range(3), str(tmp_path / "x"), "id", world, batch, micro)
    with pytest.raises(ValueError, match="step"):
        RK.write_rank_layout(spark.range(3).withColumn("step", F.lit(1)), str(tmp_path / "x"), "id", 1, 2, 1)


def test_listing_takes_few_tasks_and_one_rank(spark, tmp_path):
    """However many segments a rank has, its folders are listed by a few tasks a core, and those of other ranks not at all."""
    path = str(tmp_path / "many")
    RK.write_rank_layout(spark.range(1_200).withColumnRenamed("id", "doc_id"), path, "doc_id", 2, 4, 2, 2)
    assert RK.layout(spark, path).filter("rank = 0").count() > 100
    sc, most = spark.sparkContext, 4 * spark.sparkContext.defaultParallelism
    sc.setJobGroup("listing", "one rank's folders")
    rows = RK.read_rank(spark, path, 0, 10)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s is not None) <= most
    assert all("/rank=0/" in f for f in rows.inputFiles()) and rows.count() == RK.layout(spark, path).filter("rank = 0").agg(F.sum("n")).first()[0] - 20
