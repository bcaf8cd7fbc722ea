"""Structured Streaming forms of the operators.

* T1 ``file_stream``: lazy unbounded read of a folder (``maxFilesPerTrigger``), declared schema. ``feed`` delivers a table in
  ranges of its order: each range is written by many tasks, and the stream runs until it has taken it.
* T2 stateless: the very same Column / ``mapInArrow`` functions as the batch path, append mode.
* T3 ``stream_near_dedup``, T4 ``stream_token_budget``: ``foreachBatch`` over the parallel batch operators. What earlier
  micro-batches decided is a table written under the batch's number (overwrite, so a replayed batch rewrites the same
  folder); the tables that the next batch needs are opened by their names, and a missing one is an error, never an
  empty state. Superseded ones are deleted two steps later.
* T5 ``stream_step_rollup``: each micro-batch writes its mergeable interval sums; the log lines are made from the merged sums.

Sinks and checkpoints live in the shared folder (``spark.checkpoint.dir``), never a local temp dir.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.dedup import dropped_positions, lsh_buckets, minhash
from quarry.operators.ordered import order_bucket, token_budget
from quarry.operators.report import log_lines, step_partials
from quarry.session import cut_lineage, scratch_path
from quarry import defaults as DEF


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    hadoop, fs = _path(spark, path)
    fs.delete(hadoop, True)


# ---------------------------------------------------------------- T1
def feed(df: DataFrame, path: str, order: str, n_ranges: int, run: Callable[[], None]) -> None:
    """Deliver ``df`` to the folder ``path`` in ``n_ranges`` ranges of ``order``, calling ``run`` (which takes what is there
    and ends) after each. The range decides the order, not the files' names or times; all tasks write."""
    spark = df.sparkSession
    staged = f"{path}-staged"
    order_bucket(df, order, n_ranges, "_range").write.partitionBy("_range").parquet(staged)
    whole = spark.read.parquet(staged)
    for i in range(n_ranges):
        whole.filter(F.col("_range") == i).select(*df.columns).write.mode("append").parquet(path)
        run()


def feed_batches(df: DataFrame, path: str, batch: str, n_batches: int, run: Callable[[], None]) -> None:
    """Deliver ``df`` to the folder ``path`` by the numbers in its column ``batch``, calling ``run`` after each."""
    staged = f"{path}-staged"
    df.write.partitionBy(batch).parquet(staged)
    columns = [f for f in df.schema.fields if f.name != batch]
    whole = df.sparkSession.read.parquet(staged)
    for i in range(n_batches):
        whole.filter(F.col(batch) == i).select(*[f.name for f in columns]).write.mode("append").parquet(path)
        run()


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files_per_trigger: int = 1_000) -> DataFrame:
    """A folder as an unbounded table."""
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(path))


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Drive a stream over everything available now into a parquet sink."""
    q = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(out))
    q.awaitTermination()


# ---------------------------------------------------------------- T3
def _kept_bands(spark: SparkSession, state: str, batch_id: int, every: int) -> DataFrame | None:
    """Band keys of the rows kept before ``batch_id``: the last compacted generation and the batches after it."""
    start = batch_id // every * every
    paths = ([f"{state}/upto={start}"] if start else []) + [f"{state}/batch_id={i}" for i in range(start, batch_id)]
    return spark.read.schema("band int, key string").parquet(*paths) if paths else None


def stream_near_dedup(stream: DataFrame, out: str, state: str, checkpoint: str, order: str = "doc_id",
                      text: str = "text", threshold: float = DEF.DEDUP_THRESHOLD, num_perm: int = DEF.DEDUP_NUM_PERM,
                      seed: int = 1, compact_every: int = 32) -> None:
    """First-wins near-dedup across micro-batches (which must arrive in ``order``).

    The state is the kept band keys of each batch and, every ``compact_every`` batches, one compacted
    generation; a batch reads at most that many folders, and what a generation holds is deleted one
    generation later.
    """

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(order, *[c for c in batch.columns if c != order])
        sk = cut_lineage(minhash(rows, text, order, num_perm, threshold, seed=seed))  # sketched once per batch
        prior = _kept_bands(spark, state, batch_id, compact_every)
        if prior is not None:  # rows hitting a band of an earlier kept row
            hit = lsh_buckets(sk).join(prior, ["band", "key"], "left_semi").select("pos").distinct()
            sk = cut_lineage(sk.join(hit, "pos", "left_anti"))
        kept_pos = cut_lineage(sk.select("pos").join(dropped_positions(sk), "pos", "left_anti"))
        kept = rows.join(kept_pos.withColumnRenamed("pos", order), order, "left_semi")
        kept.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        bands = lsh_buckets(sk.join(kept_pos, "pos", "left_semi")).select("band", "key")
        bands.write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")
        done = batch_id + 1
        if done % compact_every == 0:  # a new generation: everything up to and including this batch
            parts = [bands.sparkSession.read.schema("band int, key string").parquet(f"{state}/batch_id={batch_id}")]
            parts += [] if prior is None else [prior]
            gen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            gen.repartition("band", "key").write.mode("overwrite").parquet(f"{state}/upto={done}")
            old = done - 2 * compact_every  # nothing reads before the last generation but one any more
            if old >= 0:
                for i in range(old, old + compact_every):
                    _delete(spark, f"{state}/batch_id={i}")
                _delete(spark, f"{state}/upto={old}")

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


# ---------------------------------------------------------------- T4
def stream_token_budget(stream: DataFrame, cap, out: str, state: str, checkpoint: str,
                        order: str = "doc_id", n_col: str = "n_tokens", group: str = "source") -> None:
    """T4: every micro-batch runs the parallel (bucketed) batch budget with the remaining cap of each source.
    ``cap`` is an int or a ``{source: cap}`` mapping (a source it lacks has no limit).

    State: one row per source, ``(total, stopped)``. A row is rejected exactly when its source's running total passes
    the cap, and since token counts are non-negative the source then stays stopped:
    ``stopped' = stopped or total + batch sum > cap``.
    """

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = f"{group} string, total long, stopped boolean"
        prior = (spark.read.schema(schema).parquet(f"{state}/batch_id={batch_id - 1}") if batch_id
                 else spark.createDataFrame([], schema))
        limit = F.lit(None).cast("long")
        for name, most in (cap.items() if isinstance(cap, dict) else ()):
            limit = F.when(F.col(group) == F.lit(name), F.lit(int(most))).otherwise(limit)
        limit = limit if isinstance(cap, dict) else F.lit(int(cap)).cast("long")
        sums = cut_lineage(batch.groupBy(group).agg(F.sum(F.col(n_col).cast("long")).alias("_bs"))
                           .join(prior, group, "full").withColumn("_limit", limit)
                           .withColumn("_had", F.coalesce("total", F.lit(0))).withColumn("_off", F.coalesce("stopped", F.lit(False))))
        remaining = sums.select(group, F.when(F.col("_off"), F.lit(-1)).otherwise(F.col("_limit") - F.col("_had")).alias("cap"))
        kept = token_budget(batch, remaining, n_col, order, group)
        kept.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        now = F.col("_had") + F.coalesce("_bs", F.lit(0))
        new_state = sums.select(group, now.alias("total"), (F.col("_off") | F.coalesce(now > F.col("_limit"), F.lit(False))).alias("stopped"))
        new_state.write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")
        if batch_id >= 2:  # a replay reads the batch before it, nothing older
            _delete(spark, f"{state}/batch_id={batch_id - 2}")

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


# ---------------------------------------------------------------- T5
def stream_step_rollup(stream: DataFrame, log_interval: int, out: str, checkpoint: str) -> None:
    """T5: interval sums of every micro-batch of a step log, written under the batch's number. No state is kept: sums
    of one interval from several batches merge when they are read (:func:`read_rollup`)."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        step_partials(batch, log_interval).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_event_windows(stream: DataFrame, width: str, delay: str, out: str, checkpoint: str, by: list[str], ts: str = "ts",
                         value: str = "value") -> None:
    """T5 over event time: windows of ``width`` by ``by``, kept as state until the watermark (the latest ``ts`` less ``delay``) has
    passed them, then written once. Events of windows already written are dropped; state is bounded by the windows still open. A restart from
    ``checkpoint`` goes on with state and watermark. Times without a zone are taken as UTC, whatever the session's zone."""
    kind = stream.schema[ts].dataType.simpleString()
    at = F.col(ts) if kind == "timestamp" else F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts)))
    rows = stream.withColumn("_at", at).withWatermark("_at", delay).groupBy(F.window("_at", width), *by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value"), F.min("_at").alias("first_ts"), F.max("_at").alias("last_ts"))
    rows = rows.select(F.col("window.start").alias("window_start"), *by, "n", "mean_value", "max_value", "first_ts", "last_ts")
    run_to_parquet(rows, out, checkpoint)


def read_rollup(spark: SparkSession, out: str, log_interval: int, tokens_interval: int) -> DataFrame:
    """The log lines of all that the stream has taken so far."""
    return log_lines(spark.read.parquet(out).drop("batch_id"), log_interval, tokens_interval)


def fresh(spark: SparkSession, name: str) -> dict:
    base = scratch_path(spark, name)
    return {"input": f"{base}/input", "out": f"{base}/out", "state": f"{base}/state", "ckpt": f"{base}/checkpoint"}
