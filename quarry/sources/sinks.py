"""Sinks and the scans that read them back.

* Text shards (S7/F9): JSON lines ``{"text": ...}``, one folder per shard ``shard_name=shard_%05d``, or one file ``shard_%05d.jsonl``.
* Sequence shards (S8): parquet partitioned by ``shard``; read back (S6) sorted by (shard, local_idx).
* Metadata (S9): one JSON object.
* Text lines (S5): ``spark.read.text`` over files, with the file path for provenance.

Each writer repartitions by shard so a shard is written by one task, and a shard is bounded in size
by construction (token- or count-sized), so no task holds more than one shard's rows at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.shards import shard_name
from quarry.session import cut_lineage, few_listing_tasks
from quarry import defaults as DEF


OFFSETS = "_offsets"  # beside the shards; Spark's readers pass over names that begin so
ROW_GROUP = 8 << 20  # bytes: a lookup skips what it doesn't need of a shard's files
TASK_ROWS = 100_000  # sequences of a shard that one task writes; a larger shard is a folder of several files


def write_text_shards(df: DataFrame, out: str, shard: str = "shard", order: str = "pos", fmt: str = DEF.TEXT_SHARD_NAME,
                      mode: str = "overwrite") -> None:
    """``{"text": ...}`` lines in corpus order, one folder per shard (``shard_%05d``)."""
    nparts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    named = df.select(shard_name(shard, fmt).alias("shard_name"), order, "text")
    (named.repartition(nparts, "shard_name").sortWithinPartitions("shard_name", order)
          .select("shard_name", "text").write.mode(mode).partitionBy("shard_name").json(out))


def write_text_shard_files(df: DataFrame, out: str, shard: str = "shard", order: str = "pos", fmt: str = DEF.TEXT_SHARD_NAME) -> list[str]:
    """S7 as files: ``out/shard_%05d.jsonl``, one file a shard; returns the names in order.

    Spark's commit protocol writes the shards into a hidden folder beside the result, so of failed and repeated attempts nothing stays;
    then the files are renamed into place and ``_SUCCESS`` is set. The driver only handles names, one a shard. ``out`` must be
    new or empty: shards of another run are never mixed in. Works on any file system that Spark writes to.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    root, staging = hadoop(out), hadoop(out, f"_staging-{uuid.uuid4().hex}")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(root) and len(fs.listStatus(root)):
        raise FileExistsError(f"{out} is not empty")
    names = []
    try:
        write_text_shards(df, staging.toString(), shard, order, fmt)
        moves = []
        for folder in fs.listStatus(staging):
            key, _, name = folder.getPath().getName().partition("=")
            if key == "shard_name":
                parts = [f.getPath() for f in fs.listStatus(folder.getPath()) if not f.getPath().getName().startswith(("_", "."))]
                if len(parts) != 1:
                    raise RuntimeError(f"{name} was written as {len(parts)} files")
                moves.append((f"{name}.jsonl", parts[0]))
        for name, part in sorted(moves):
            if not fs.rename(part, hadoop(out, name)):
                raise OSError(f"{name} could not be moved into {out}")
            names.append(name)
    except BaseException:
        for name in names:
            fs.delete(hadoop(out, name), False)
        raise
    finally:
        fs.delete(staging, True)
    fs.create(hadoop(out, "_SUCCESS"), True).close()
    return names


def read_text_shards(spark: SparkSession, path: str) -> DataFrame:
    """Read S7 output back: ``(shard_name, text)``."""
    return spark.read.schema("text string, shard_name string").json(path)


def write_sequence_shards(df: DataFrame, out: str, shard: str = "shard", local: str = "local_idx",
                          ids: str = "input_ids", mode: str = "overwrite") -> None:
    """``(local_idx, input_ids)`` rows per shard, partitioned by ``shard``."""
    (df.select(shard, local, ids).repartition(shard, F.floor(F.col(local) / TASK_ROWS)).sortWithinPartitions(shard, local)
       .write.mode(mode).option("parquet.block.size", ROW_GROUP).partitionBy(shard).parquet(out))


def read_sequence_shards(spark: SparkSession, path: str, shard: str = "shard") -> DataFrame:
    """Every shard under ``path``; an empty location is an error, as in the reference."""
    with few_listing_tasks(spark):
        df = spark.read.parquet(path)
    if shard not in df.columns:
        raise ValueError(f"no shard files found in {path}")
    return df.withColumn(shard, F.col(shard).cast("long"))  # partition values are inferred as int


def write_metadata(meta: DataFrame, out: str, mode: str = "overwrite") -> None:
    """The one-row metadata table as a single JSON object."""
    meta.coalesce(1).write.mode(mode).json(out)


def read_text_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines of UTF-8 text files ``(file, value)`` (no order)."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")


def read_text_lines_ordered(spark: SparkSession, paths: list[str]) -> DataFrame:
    """S5 with the reference's order: ``(file_idx, block_start, line_no, value)``, files in the given order, lines
    in file order. A line's place is its file's number, the byte at which its split begins and its number
    in the split: the scan reads a split in one task, front to back, so the counter of rows in the task
    orders its lines (the number itself restarts with every split)."""
    from urllib.parse import unquote

    files = [r[0] for p in paths for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p)
             .select("path").orderBy("path").collect()]  # names only
    order = spark.createDataFrame([(f, i) for i, f in enumerate(dict.fromkeys(unquote(f) for f in files))], "_file string, file_idx long")
    lines = spark.read.option("recursiveFileLookup", "true").text(paths).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_no"))
    lines = cut_lineage(lines.withColumn("_file", F.url_decode("_file")))
    return lines.join(F.broadcast(order), "_file").select("file_idx", "block_start", "line_no", "value")
