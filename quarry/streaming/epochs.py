"""A stored table as an endless stream, epoch after epoch.

The table is stored by segments of consecutive positions. The stream itself carries numbers only: its offset is a count of segments, of
which ``offset div S`` is the epoch and ``offset mod S`` the segment (S segments in all). A micro-batch reads the folders of its own range of
segments; it may end inside an epoch or go over into the next. The offset is in the stream's checkpoint, so a restart goes on behind the last
committed batch, also inside an epoch, and a batch that failed is given again with the same rows and the same number.

Scale: what a micro-batch reads depends on ``per_batch`` x ``rows_per_segment``, not on the table or the epochs gone by. Rows are never
copied for later epochs, and no state is kept.

Edge cases. Empty table: there is nothing to repeat, so no batch is given and no stream started. ``per_batch`` above S: a batch has a row more
than once, each with its epoch. Nulls, repeated rows and other columns: as they are; the keys of the order are unique and not null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.ordered import ordered_position

LAYOUT, SCHEMA = "_layout", "_schema"  # beside the folders; Spark's readers pass over names that begin so


def write_segments(df: DataFrame, out: str, keys: list[str], rows_per_segment: int) -> None:
    """Store ``df`` with its position ``pos`` in the order of ``keys``, by segments of ``rows_per_segment`` positions. A segment is written by
    one task. ``_layout`` is written last, so a store without it isn't whole."""
    if rows_per_segment < 1:
        raise ValueError("rows_per_segment must be at least 1")
    clash = {"pos", "segment", "epoch"} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here")
    rows = ordered_position(df, keys).withColumn("segment", F.expr(f"pos div {rows_per_segment}"))
    rows.repartition("segment").sortWithinPartitions("segment", "pos").write.partitionBy("segment").parquet(out)
    spark = df.sparkSession
    spark.createDataFrame([], rows.schema).coalesce(1).write.parquet(f"{out}/{SCHEMA}")
    last = spark.read.schema("segment long").parquet(out).agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.max("segment"), F.lit(-1)) + 1).alias("segments"))
    last.coalesce(1).write.parquet(f"{out}/{LAYOUT}")


def n_segments(spark: SparkSession, path: str) -> int:
    return spark.read.schema("n long, segments long").parquet(f"{path}/{LAYOUT}").first()["segments"]


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """The rows of the segments that the offsets ``start`` to ``stop`` - 1 stand for, with their ``epoch``; only their folders are listed."""
    total = n_segments(spark, path)
    rows = spark.read.schema(spark.read.parquet(f"{path}/{SCHEMA}").schema).parquet(path)
    if not total or start >= stop:
        return rows.filter(F.lit(False)).withColumn("epoch", F.lit(0).cast("long")).drop("segment")
    if stop - start < total:
        a, b = start % total, (stop - 1) % total
        after, before = F.col("segment") >= a, F.col("segment") <= b
        rows = rows.filter(after & before if a <= b else after | before)
    # the epochs e with start <= e * total + segment < stop
    first = F.expr(f"({start} - segment + {total - 1}) div {total}")
    last = F.expr(f"({stop - 1} - segment) div {total}")
    return rows.withColumn("epoch", F.explode(F.sequence(first, last))).drop("segment")


def stream_epochs(spark: SparkSession, path: str, each: Callable[[DataFrame, int], None], checkpoint: str, per_batch: int = 1,
                  batches: int | None = None) -> StreamingQuery | None:
    """Give the stored table to ``each(rows, batch_id)``, ``per_batch`` segments at a time, epoch after epoch (``epoch``, ``pos``).

    Without ``batches`` the stream runs until it is stopped, and the running query is returned. With it, the call takes as many more
    batches and ends; each of them is a start from the checkpoint. As a failed batch is given again, ``each`` overwrites by ``batch_id``.
    """
    if not n_segments(spark, path):
        return None
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_batch).option("numPartitions", 1).load().select("value")

    def give(batch: DataFrame, batch_id: int) -> None:
        due = batch.agg(F.min("value").alias("a"), F.max("value").alias("b")).first()
        if due["a"] is not None:
            each(read_range(batch.sparkSession, path, due["a"], due["b"] + 1), batch_id)

    writer = ticks.writeStream.foreachBatch(give).option("checkpointLocation", checkpoint)
    if batches is None:
        return writer.start()
    for _ in range(batches):
        writer.trigger(availableNow=True).start().awaitTermination()  # one batch
    return None
