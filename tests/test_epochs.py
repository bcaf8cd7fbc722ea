"""The endless repeat (T6): against a loop, over restarts and a failed batch, and by the files it opens."""

import time

import pytest
from pyspark.sql import functions as F

from quarry.streaming import epochs as EP
from quarry.streaming import stream as ST
from tests.conftest import rows


def stored(spark, tmp_path, n, size):
    df = spark.range(n).select((n - F.col("id")).alias("key"), F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("text"))
    EP.write_segments(df, str(tmp_path / "segments"), ["key"], size)
    return str(tmp_path / "segments"), [(r.key, r.text) for r in df.orderBy("key").collect()]


def by_key(found):
    return sorted(found, key=lambda r: r[:3])


def same(got, expected):
    return [r[:3] for r in by_key(got)] == [r[:3] for r in by_key(expected)] and [r[3] for r in by_key(got)] == [r[3] for r in by_key(expected)]


def collected(df):
    return [tuple(r) for r in df.select("epoch", "pos", "key", "text").collect()]


def loop(table, size, start, stop):
    parts = [table[i:i + size] for i in range(0, len(table), size)]
    return [(v // len(parts), v % len(parts) * size + k, key, text)
            for v in range(start, stop) for k, (key, text) in enumerate(parts[v % len(parts)])]


@pytest.mark.parametrize("n,size", [(23, 5), (20, 5), (1, 5), (4, 1)])
def test_ranges_of_offsets(spark, tmp_path, n, size):
    path, table = stored(spark, tmp_path, n, size)
    total = EP.n_segments(spark, path)
    assert total == -(-n // size)
    for start, stop in ((0, 1), (0, total), (total - 1, total + 1), (total, 3 * total + 1), (7 * total + total // 2, 9 * total), (3, 3)):
        assert same(collected(EP.read_range(spark, path, start, stop)), loop(table, size, start, stop))


def test_restarts_inside_an_epoch_and_a_failed_batch(spark, tmp_path):
    path, table = stored(spark, tmp_path, 23, 5)
    p, calls = ST.fresh(spark, "test-epochs"), []

    def each(batch, batch_id):
        calls.append(batch_id)
        batch.write.mode("overwrite").parquet(f"{p['out']}/batch_id={batch_id}")
        if calls == [0, 1, 2]:
            raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        EP.stream_epochs(spark, path, each, p["ckpt"], per_batch=2, batches=5)
    EP.stream_epochs(spark, path, each, p["ckpt"], per_batch=2, batches=3)
    assert calls[:4] == [0, 1, 2, 2] and calls[4:] == list(range(3, calls[-1] + 1))  # batch 2 again, none left out
    out = spark.read.parquet(p["out"])
    assert calls[-1] >= 4 and same(collected(out), loop(table, 5, 0, 2 * (calls[-1] + 1)))
    for r in out.select("batch_id", "epoch", "pos").distinct().collect():
        assert (r.epoch * 5 + r.pos // 5) // 2 == r.batch_id


def test_a_batch_opens_its_own_folders_only(spark, tmp_path):
    path, _ = stored(spark, tmp_path, 200, 10)
    opened = lambda a, b: {int(r[0]) for r in EP.read_range(spark, path, a, b).select(
        F.regexp_extract("_metadata.file_path", r"segment=(\d+)", 1)).distinct().collect()}
    assert opened(43, 46) == {3, 4, 5} and opened(38, 42) == {18, 19, 0, 1}
    frame = EP.read_range(spark, path, 43, 46)
    plan = frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    filters = next(x for x in plan.splitlines() if x.startswith("PartitionFilters"))
    assert ">= 3" in filters and "<= 5" in filters


def test_it_runs_until_stopped(spark, tmp_path):
    path, table = stored(spark, tmp_path, 6, 3)
    p, seen = ST.fresh(spark, "test-endless"), []
    query = EP.stream_epochs(spark, path, lambda batch, i: seen.append((i, rows(batch, "epoch", "pos"))), p["ckpt"], per_batch=2)
    for _ in range(600):
        if len(seen) >= 3:
            break
        time.sleep(0.1)
    query.stop()
    assert [s for i, s in seen[:3]] == [[(e, k) for k in range(6)] for e in range(3)]


def test_empty_table_and_wrong_arguments(spark, tmp_path):
    path, _ = stored(spark, tmp_path, 0, 5)
    assert EP.n_segments(spark, path) == 0 and EP.read_range(spark, path, 0, 4).count() == 0
    assert EP.stream_epochs(spark, path, lambda *_: 1 / 0, str(tmp_path / "c"), batches=2) is None
    with pytest.raises(ValueError, match="rows_per_segment"):
        EP.write_segments(spark.range(3), str(tmp_path / "x"), ["id"], 0)
    with pytest.raises(ValueError, match="epoch"):
        EP.write_segments(spark.range(3).withColumn("epoch", F.lit(1)), str(tmp_path / "x"), ["id"], 1)
