"""Reports: step plan (H17), best-loss flags (H18), mixture profile."""

import datetime as dt


from quarry.operators import report as R
from tests.conftest import rows


def test_step_plan_h17(spark):
    base = spark.range(1)
    r = R.step_plan(base, 512, 1024, 8, 0.05, total_tokens=30_000_000_000).first()
    assert (r["steps_reference"], r["warmup_reference"]) == (7152, 357)
    assert r["steps_global"] == 57220


def step_log(spark, steps, epoch=0):
    t0 = dt.datetime(2024, 1, 1)
    data = [(s, t0 + dt.timedelta(seconds=s), float(s), 0.1 * s, epoch + s // 12) for s in steps]
    return spark.createDataFrame(data, "step long, ts timestamp, loss double, lr double, epoch int")


def test_best_loss_flags_h18(spark):
    roll = spark.createDataFrame([(i * 50, l) for i, l in enumerate([3.0, 2.0, 2.5, 1.0], 1)], "log_step long, train_loss double")
    steps = spark.range(1, 201).withColumnRenamed("id", "step")
    got = [r["is_best"] for r in R.best_loss_flags(roll, steps, 50).orderBy("save_step").collect()]
    assert got == [True, True, False, True]
    # save points between log lines take the last line's mean; one before the first line has none
    got = [(r["save_step"], r["avg_loss"], r["is_best"]) for r in R.best_loss_flags(roll, steps, 40).orderBy("save_step").collect()]
    assert got == [(80, 3.0, True), (120, 2.0, True), (160, 2.5, False), (200, 1.0, True)]


def test_step_rollup(spark):
    r = R.step_rollup(step_log(spark, range(1, 26)), 10, 2, 4, 1).orderBy("log_step").collect()
    assert [x["log_step"] for x in r] == [10, 20]
    assert r[0]["train_loss"] == 5.5 and abs(r[1]["learning_rate"] - 2.0) < 1e-12
    assert r[1]["tokens_per_second"] == 10 * 2 * 4 / 10.0
    assert [x["tokens_seen"] for x in r] == [80, 160] and [x["epoch"] for x in r] == [0, 1]


def test_step_rollup_with_gaps_and_repeats(spark):
    steps = [1, 2, 3, 4, 4, 5, 6, 8, 9, 10, *range(11, 20), *range(21, 31)]  # 7 and 20 missing, 4 twice
    r = R.step_rollup(step_log(spark, steps), 10, 2, 4, 1).orderBy("log_step").collect()
    assert [x["log_step"] for x in r] == [10, 30]
    assert r[0]["train_loss"] == sum(steps[:10]) / 10
    assert abs(r[1]["train_loss"] - sum(steps[10:]) / 19) < 1e-12  # the steps of the line that step 20 lacks go into the next
    assert r[1]["tokens_per_second"] == 10 * 2 * 4 / 20.0


def test_mixture_profile_has_total_row(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 30), ("b", 3, 60)], "source string, doc_id long, n_tokens long")
    got = rows(R.mixture_profile(df, {"a": 100, "b": 100}), "source", "docs", "tokens", "share", "remaining")
    assert got == [("__all__", 3, 100, 1.0, 100), ("a", 2, 40, 0.4, 60), ("b", 1, 60, 0.6, 40)]
