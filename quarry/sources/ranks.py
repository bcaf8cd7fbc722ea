"""A layout that every rank can read from any step on.

Rows are dealt to ranks by hash (P10) and numbered in order inside their rank; a rank takes ``batch_size / world_size`` of them a step, in
micro-batches. They are stored by (rank, segment of ``segment_steps`` steps), sorted by position. A reader that begins
at step k lists only its rank's folders from that step's segment on, and in the first of them skips row groups by the statistics of
``step``; nothing of what was consumed is read again. ``_layout``, beside the folders, holds the segments' first and last step.

Scale: a (rank, segment) is written by one task and has ``segment_steps`` x ``batch_size / world_size`` rows, whatever the table's
size. Positions are balanced running counts, so no rank passes through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import defaults as DEF
from quarry.operators.ordered import rank_split, running_count
from quarry.session import few_listing_tasks

LAYOUT, SCHEMA = "_layout", "_schema"  # beside the folders; Spark's readers pass over names that begin so
LAYOUT_SCHEMA = "rank int, segment long, first_step long, last_step long, n long, segment_steps long"
ROW_GROUP = 8 << 20  # bytes: what a resumed reader may skip of its first segment


def write_rank_layout(df: DataFrame, out: str, key: str, world_size: int, batch_size: int = DEF.BATCH_SIZE,
                      micro_batch_size: int = DEF.MICRO_BATCH_SIZE, segment_steps: int = DEF.SAVE_INTERVAL, hash_key: str | None = None) -> None:
    """Store ``df`` for ``world_size`` readers, in the order of ``key`` (unique integers, no nulls). The last step of a rank may be short.

    Adds ``rank``, ``step``, ``micro`` and ``local_pos`` (the row's number inside its rank). ``df`` is read twice, for its keys and
    for its rows, so it should be a stored table; the rows move twice, to be numbered and to their folders.
    """
    own, uneven = divmod(batch_size, world_size)
    if own < 1 or uneven or own % micro_batch_size:
        raise ValueError("batch_size must be a multiple of world_size x micro_batch_size")
    clash = {"rank", "step", "micro", "local_pos", "segment"} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here")
    ranked = rank_split(df, world_size, hash_key or key)
    pos = F.col("_n") - 1
    rows = running_count(ranked, key, "rank", "_n").select(
        *df.columns, "rank", (pos % own / micro_batch_size).cast("long").alias("micro"), pos.alias("local_pos"),
        F.floor(pos / own).alias("step"), F.floor(pos / (own * segment_steps)).alias("segment"))
    (rows.repartition("rank", "segment").sortWithinPartitions("rank", "segment", "local_pos")
         .write.option("parquet.block.size", ROW_GROUP).partitionBy("rank", "segment").parquet(out))
    rows.sparkSession.createDataFrame([], rows.schema).coalesce(1).write.parquet(f"{out}/{SCHEMA}")
    # the numbers inside a rank have no gaps: its count tells its segments, and no file is opened for that
    counts = ranked.filter(F.col(key).isNotNull() & F.col("rank").isNotNull()).groupBy("rank").agg(F.count(F.lit(1)).alias("_rows"))
    size = own * segment_steps
    told = counts.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_rows") - 1) / size))))
    n = F.least(F.lit(size), F.col("_rows") - F.col("segment") * size)
    first = F.col("segment") * segment_steps
    told.select("rank", "segment", first.alias("first_step"), (first + F.floor((n - 1) / own)).alias("last_step"), n.alias("n"),
                F.lit(segment_steps).cast("long").alias("segment_steps")).coalesce(1).write.parquet(f"{out}/{LAYOUT}")


def layout(spark: SparkSession, path: str) -> DataFrame:
    """(rank, segment, first_step, last_step, n, segment_steps): one row a stored segment."""
    return spark.read.schema(LAYOUT_SCHEMA).parquet(f"{path}/{LAYOUT}")


def read_rank(spark: SparkSession, path: str, rank: int, from_step: int = 0) -> DataFrame:
    """The rows of ``rank`` from step ``from_step`` on, unordered; ``(step, micro, local_pos)`` tells their order. A rank or step
    that isn't there gives no rows."""
    schema = spark.read.parquet(f"{path}/{SCHEMA}").schema
    stored = layout(spark, path).filter(F.col("rank") == rank).select("segment_steps").first()  # one number
    if stored is None:
        return spark.createDataFrame([], schema).drop("segment")
    with few_listing_tasks(spark):  # of this rank's folders only
        rows = spark.read.schema(schema).option("basePath", path).parquet(f"{path}/rank={int(rank)}")
    first = max(from_step, 0) // stored["segment_steps"]
    return rows.filter((F.col("rank") == rank) & (F.col("segment") >= first) & (F.col("step") >= from_step)).drop("segment")


def resume_steps(spark: SparkSession, path: str, share: float) -> dict[int, int]:
    """For each rank the step at ``share`` of its last one (a row a rank)."""
    last = layout(spark, path).groupBy("rank").agg(F.max("last_step").alias("last"))
    return {r["rank"]: int(r["last"] * share) for r in last.collect()}
