"""Session defaults and the shared working folder.

The shared folder is the one the cluster names in ``spark.checkpoint.dir``. Lineage is cut at Parquet
tables written below it, so a lost executor only costs a recomputation from the last written table. A folder of our own is made only
when the setting is unset *and* Spark runs in local mode (tests, the bench); on a cluster an unset
checkpoint dir is an error, never a silent machine-local temporary folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # documents reach 20,000 words: keep Arrow batches to Python workers small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.pythonUDF.arrow.enabled": "true",
}


def _default_driver_memory() -> str:
    """About 60% of the host's memory, at most 16 GiB (local mode: the driver is the executor)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    return f"{max(1, min(16, int(total * 0.6 / 2**30)))}g"


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "quarry") -> SparkSession:
    """Build (or reuse) a session with the defaults above; used by tests and the bench."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", _default_driver_memory()))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared checkpoint folder (``spark.checkpoint.dir``), set up if needed."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; quarry needs a folder shared by the cluster")
    local = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one job's written tables."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: the lineage ends at a columnar
    table that survives lost executors, later passes read only the columns they use, and its size is known."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def few_listing_tasks(spark: SparkSession):
    """Folders of a table opened inside are listed by a few tasks a core. Else Spark takes a task for every folder, each with some
    kilobytes for the driver; the session's setting is restored."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)
