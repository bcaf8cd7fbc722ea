"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of ``docs``; the last
one returns packed pieces. ``run`` writes each stage's result as Parquet below the shared folder and reads it
back, so a lost executor costs no more than the running stage.

1. language: texts without letters, and those whose language is less certain than ``MIN_SCORE``, go.
2. lines: line chunks that an earlier document has are cut out of the text; a document that loses all its words goes.
3. near_duplicates: of documents whose five-word shingles are linked by similarity 0.8 or more, the one with the least
   doc_id stays.
4. benchmark: documents that hold a benchmark item, up to a fifth of its words edited, go.
5. pack: the ids of what is left in sequences of at most 1024; a row per piece.

Rows that share a doc_id stay or go together in stages 3 and 4. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, langid, linedup, neardup
from quarry.llm.common import fresh, write_table
from quarry.llm.queries import held_out, pack_whole
from quarry.sources.tables import table_path

MIN_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learn = ~F.coalesce(held_out(), F.lit(False))
    model = langid.train(docs.select("doc_id", "text", "lang"), learn, sample=4000)
    found = langid.identify(docs.select(*docs.columns, F.col("text").alias(fresh(docs, "t")[0])), model, docs.columns, fresh(docs, "t")[0])
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linedup.clean(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh(docs, "gone")[0]
    gone = neardup.near_duplicates(docs, width=5, percent=80).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[name]), "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(table_path(sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_whole(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
