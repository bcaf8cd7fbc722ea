"""Reports over the corpus and the step log, re-aimed as table jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quarry.operators.ordered import _cap_expr, running_agg, running_sum
from quarry.session import cut_lineage
from quarry import defaults as DEF

ALL = "__all__"


def epoch_micros(col: str, dtype) -> "F.Column":
    """Microseconds since the epoch, independent of the session time zone for ``TIMESTAMP_NTZ``
    (a wall-clock value) and exact for ``TIMESTAMP``."""
    if isinstance(dtype, ST.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(col))
    return F.unix_micros(F.col(col))


def mixture_profile(df: DataFrame, caps=None, source: str = "source", n_col: str = "n_tokens",
                    target_tokens: int | None = None) -> DataFrame:
    """A3: per source docs, tokens, cap, share of all tokens, remaining budget; plus an overall row.

    The per-source table has one row per source; the overall row comes from ``rollup`` over it.
    """
    per = df.groupBy(source).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col(n_col).cast("long")).alias("tokens"))
    if caps is not None:
        per = per.withColumn("cap_tokens", _cap_expr(caps, [source]))
    else:
        per = per.withColumn("cap_tokens", F.lit(None).cast("long"))
    rolled = per.rollup(source).agg(
        F.sum("docs").cast("long").alias("docs"),
        F.sum("tokens").cast("long").alias("tokens"),
        F.sum("cap_tokens").cast("long").alias("cap_tokens"),
    )
    total = F.sum(F.when(F.col(source).isNotNull(), F.col("tokens"))).over(Window.partitionBy(F.lit(1)))
    out = rolled.select(
        F.coalesce(F.col(source), F.lit(ALL)).alias(source),
        "docs",
        "tokens",
        "cap_tokens",
        F.round(F.col("tokens") / total, 6).alias("share"),
        (F.col("cap_tokens") - F.col("tokens")).alias("remaining"),
    )
    if target_tokens is not None:
        out = out.withColumn("target_gap", F.lit(int(target_tokens)) - F.col("cap_tokens"))
    return out


def step_plan(df: DataFrame, batch_size: int, seq_length: int, world_size: int,
              warmup_ratio: float = DEF.WARMUP_RATIO, n_col: str = "n_tokens", total_tokens: int | None = None) -> DataFrame:
    """A4: steps = total tokens // tokens per step, warmup = int(steps * ratio).

    Both readings of the batch size (D16): ``*_reference`` multiplies the global batch by the world
    size again, as the reference does; ``*_global`` takes the batch as global.
    """
    base = (df.agg(F.sum(F.col(n_col).cast("long")).alias("total_tokens")) if total_tokens is None
            else df.sparkSession.range(1).select(F.lit(int(total_tokens)).cast("long").alias("total_tokens")))
    tps_ref = batch_size * seq_length * world_size
    tps_glob = batch_size * seq_length
    return base.select(
        "total_tokens",
        F.lit(tps_ref).cast("long").alias("tokens_per_step_reference"),
        F.floor(F.col("total_tokens") / F.lit(tps_ref)).cast("long").alias("steps_reference"),
        F.lit(tps_glob).cast("long").alias("tokens_per_step_global"),
        F.floor(F.col("total_tokens") / F.lit(tps_glob)).cast("long").alias("steps_global"),
    ).select(
        "*",
        F.floor(F.col("steps_reference") * F.lit(float(warmup_ratio))).cast("long").alias("warmup_reference"),
        F.floor(F.col("steps_global") * F.lit(float(warmup_ratio))).cast("long").alias("warmup_global"),
    )


def step_partials(log: DataFrame, log_interval: int, step: str = "step", ts: str = "ts", loss: str = "loss", lr: str = "lr",
                  epoch: str = "epoch") -> DataFrame:
    """Mergeable sums of a step log, one row per interval ``((iv) * I, (iv + 1) * I]`` of steps. Partials of the same
    interval (of several micro-batches) are merged by :func:`log_lines`."""
    return (log.withColumn("_tus", epoch_micros(ts, log.schema[ts].dataType))
               .groupBy(F.floor((F.col(step) - 1) / log_interval).cast("long").alias("iv"))
               .agg(F.count(F.lit(1)).alias("n"), F.max(step).cast("long").alias("last_step"), F.sum(loss).alias("loss_sum"),
                    F.max_by(F.col(lr), F.col(step)).alias("learning_rate"), F.min("_tus").alias("t0"),
                    F.max("_tus").alias("t1"), F.max(epoch).cast("long").alias("epoch")))


def log_lines(partials: DataFrame, log_interval: int, tokens_interval: int) -> DataFrame:
    """The log lines of merged interval sums: a line at every step that is a multiple of the interval and was run.

    A line's mean covers all steps since the line before, as the reference's running sum does: steps that were
    skipped lack, repeated ones count again, and an interval without its last step goes into the next line. The
    previous line's end time comes from an equi-join on the line's number, not a global window.
    """
    per = partials.groupBy("iv").agg(
        F.sum("n").alias("n"), F.max("last_step").alias("last_step"), F.sum("loss_sum").alias("loss_sum"),
        F.max_by("learning_rate", "last_step").alias("learning_rate"), F.min("t0").alias("t0"), F.max("t1").alias("t1"),
        F.max("epoch").alias("epoch"))
    per = per.withColumn("_logs", (F.col("last_step") == (F.col("iv") + 1) * log_interval).cast("long"))
    numbered = running_sum(per, "_logs", "iv", None, "_upto").withColumn("_line", F.col("_upto") - F.col("_logs"))
    lines = (numbered.groupBy("_line").agg(
        F.sum("n").alias("n"), F.max("last_step").alias("log_step"), F.sum("loss_sum").alias("loss_sum"),
        F.max_by("learning_rate", "last_step").alias("learning_rate"), F.min("t0").alias("t0"), F.max("t1").alias("t1"),
        F.max("epoch").alias("epoch"), F.max("_logs").alias("_logs")).filter("_logs = 1"))
    prev = lines.select((F.col("_line") + 1).alias("_line"), F.col("t1").alias("_tp"))
    elapsed = F.col("t1") - F.coalesce(F.col("_tp"), F.col("t0"))
    mean = F.col("loss_sum") / F.col("n")
    return lines.join(prev, "_line", "left").select(
        "log_step", mean.alias("train_loss"), F.exp(mean).alias("train_perplexity"), "learning_rate",
        F.when(elapsed > 0, F.lit(float(tokens_interval)) / (elapsed / F.lit(1e6))).alias("tokens_per_second"),
        (F.col("log_step") * F.lit(tokens_interval // log_interval)).cast("long").alias("tokens_seen"), "epoch")


def step_rollup(log: DataFrame, log_interval: int, batch_size: int, seq_length: int, world_size: int,
                step: str = "step", ts: str = "ts", loss: str = "loss", lr: str = "lr", epoch: str = "epoch") -> DataFrame:
    """A6 (+W7, F12): the log lines of a step log: mean loss, ``exp`` of it, the lr at the line's step, tokens/s over
    the time since the previous line (the first: since its first step), cumulative tokens seen."""
    return log_lines(step_partials(log, log_interval, step, ts, loss, lr, epoch), log_interval,
                     log_interval * batch_size * seq_length * world_size)


def best_loss_flags(rollup: DataFrame, steps: DataFrame, save_interval: int, step: str = "step") -> DataFrame:
    """At every step of ``steps`` that is a multiple of ``save_interval``, the mean of the last log line up to it and
    ``is_best`` = that mean is less than at all earlier save points (the first: true). Save points before
    the first log line have no mean and no row.

    The last line and the best so far are balanced running maxima and minima over the merged, sorted steps.
    """
    saves = steps.filter(F.col(step) % save_interval == 0).select(F.col(step).cast("long").alias("_s")).distinct()
    merged = saves.select((F.col("_s") * 2 + 1).alias("_key"), F.lit(None).cast("long").alias("_line"), "_s").unionByName(
        rollup.select((F.col("log_step") * 2).alias("_key"), F.col("log_step").alias("_line"), F.lit(None).cast("long").alias("_s")))
    last = running_agg(merged, "_line", "_key", None, "log_step", agg="max").filter(F.col("_s").isNotNull() & F.col("log_step").isNotNull())
    points = cut_lineage(last.select("_s", "log_step").join(rollup.select("log_step", F.col("train_loss").alias("avg_loss")), "log_step"))
    prior = running_agg(points, "avg_loss", "_s", None, "_best", agg="min", inclusive=False, cast="double")
    return prior.select(F.col("_s").alias("save_step"), "avg_loss",
                        (F.col("_best").isNull() | (F.col("avg_loss") < F.col("_best"))).alias("is_best"))
