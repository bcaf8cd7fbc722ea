"""Small tables with the awkward rows that every operator must take."""

import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, ids=None, langs=None):
    rows = [(i, t, lang, "s", None if t is None else len(t))
            for i, t, lang in zip(ids if ids is not None else range(len(texts)), texts, langs or ["en"] * len(texts))]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Null and empty texts, null keys and languages, blanks, a very long text, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(60_000))
    rows = [(0, None, "en"), (1, "", "en"), (2, " \n\t ", None), (3, long, "en"), (None, "a null key, some words here", "en"), (4, "one", "xx"),
            (5, "same text twice over\nand a line", "en"), (6, "same text twice over\nand a line", "en"),
            (6, "same text twice over\nand a line", "en"), (7, "12345 !!", "en"), (8, "été déjà vu, naïve œuvre", "fr")]
    df = spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], DOCS)
    from pyspark.sql import functions as F

    for name in ("shard", "slot", "_b", "h", "th", "id", "chunk", "node", "c", "t", "removed_words", "score", "sig", "n"):
        df = df.withColumn(name, F.lit(name))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
