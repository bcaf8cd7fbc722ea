"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from quarry.session import scratch_path


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the cluster's shared folder and read it back: cuts the
    lineage at a table that survives lost executors, and nothing above it is computed twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_rows(spark: SparkSession, rows: int = 256) -> None:
    """Rows of a batch sent to a Python worker. Texts may be long, so a batch is a few hundred rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Rows of a batch sent to Python workers by the jobs run inside; the session's setting is restored."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, made from ``names``."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out
