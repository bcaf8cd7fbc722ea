"""Text shards as single files (S7): order, and nothing visible of failed or repeated attempts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quarry.sources import sinks as SK


def shards(spark, n=60, per=7):
    return spark.range(n).select(F.col("id").alias("pos"), F.expr(f"id div {per}").alias("shard"), F.concat(F.lit("t\nü "), "id").alias("text"))


def test_one_file_a_shard_in_order(spark, tmp_path):
    out = str(tmp_path / "out")
    names = SK.write_text_shard_files(shards(spark).orderBy(F.rand(1)), out)
    assert names == [f"shard_{i:05d}.jsonl" for i in range(9)]
    assert sorted(f for f in os.listdir(out) if not f.startswith(".")) == ["_SUCCESS", *names]
    for i, name in enumerate(names):
        with open(f"{out}/{name}", encoding="utf-8") as f:
            assert [json.loads(x)["text"] for x in f] == [f"t\nü {j}" for j in range(7 * i, min(60, 7 * i + 7))]
    with pytest.raises(FileExistsError):
        SK.write_text_shard_files(shards(spark), out)


def test_empty_table(spark, tmp_path):
    out = str(tmp_path / "none")
    assert SK.write_text_shard_files(shards(spark).limit(0), out) == []
    assert [f for f in os.listdir(out) if not f.startswith(".")] == ["_SUCCESS"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "failed")
    bad = shards(spark).withColumn("text", F.when(F.col("pos") == 58, F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        SK.write_text_shard_files(bad, out)
    assert not os.path.exists(out) or os.listdir(out) == []
    assert len(SK.write_text_shard_files(shards(spark), out)) == 9
