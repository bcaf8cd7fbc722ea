"""Reading the given tables and the registry fixture built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.registry import SourceSpec

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core. A table stored as one row group reads as one
    task, which would serialise every per-row stage before the first shuffle; on a cluster the scan
    already has far more splits than cores and this is a no-op (planning-time check, no job)."""
    want = 3 * df.sparkSession.sparkContext.defaultParallelism  # a few per core: uneven documents balance
    if df.rdd.getNumPartitions() >= want:
        return df
    # hash of the leading id column: deterministic on retry without the local sort a round-robin
    # split needs, and it pins only that column, so the scan still prunes every other unused one
    return df.repartition(want, F.col(df.columns[0]))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(table_path(sf_dir, name)))


def source_index(source: str = "source"):
    """Registry position of a ``srcN`` source name (N)."""
    return F.regexp_extract(F.col(source), r"(\d+)$", 1).cast("int")


def documents_registry(sf_dir: str, names=("src0", "src1", "src2"), extra: dict | None = None) -> list[SourceSpec]:
    """The three-source registry fixture: one source per ``documents.source`` value, in order.

    ``extra`` maps a source name to further ``SourceSpec`` fields (e.g. its own predicate).
    """
    path = table_path(sf_dir, "documents")
    extra = extra or {}
    specs = []
    for n in names:
        fields = {"predicate": F.col("source") == n, **extra.get(n, {})}
        specs.append(SourceSpec(name=n, path=path, **fields))
    return specs
