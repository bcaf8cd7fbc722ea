"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Each record scores every shard with ``-ln(u) / weight``, where u in (0, 1) comes from an md5 of the record
key and the shard number, and goes to the shard with the least score (ties: the lower number). Only the key
and the shards decide, so a record moves only when its own best shard is removed or a new one scores better:
one more shard takes rows only into itself, about its share of the weights.

Edge cases. Null key: a key of its own, so all null keys share a shard. Repeated rows: same shard, each its own slot.
Null text: size 1, crc32 of no bytes. Empty table: no rows. Extra columns: ignored by ``shard_table``, kept by
``with_shard``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import write_table

SLOT_BUCKETS = 1024  # per shard: a slot count joins shards x this many offsets, a bound that rows don't move


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """Weighted rendezvous score of a shard; the least wins. 52 bits of md5, exact as a double."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("\0")), F.lit(f":{shard}")))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return -F.ln((bits + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The number of the shard that ``key`` goes to."""
    scored = [F.struct(score(key, i, w).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights)]
    return (F.least(*scored) if len(scored) > 1 else scored[0])["i"]


def with_shard(df: DataFrame, key: str, weights: list[float], out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row."""
    return df.withColumn(out, rendezvous(F.col(key), weights))


def with_slot(df: DataFrame, by: list[str], shard: str = "shard", out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without a gap. ``df`` must be cheap to read twice (a written table).

    Rows spread over hash buckets of ``by`` within their shard; a bucket's first slot is the running sum of the
    shard's bucket counts, so no task holds a shard. The order is (bucket, ``by``)."""
    bucket = F.pmod(F.xxhash64(*by), F.lit(SLOT_BUCKETS)).cast("int")
    rows = df.withColumn("_b", bucket)
    counts = rows.groupBy(shard, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    local = F.row_number().over(Window.partitionBy(shard, "_b").orderBy(*by)) - 1
    return (rows.join(F.broadcast(starts), [shard, "_b"]).withColumn(out, (F.col("_at") + local).cast("long"))
            .drop("_b", "_at"))


def shard_table(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, size, text_crc32, shard, slot, grown_shard)``; ``grown_shard`` is the shard with one more of
    weight 1. The texts are read once; what is numbered and shuffled has a few integers a row."""
    utf8 = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    narrow = docs.select(key, (F.octet_length(utf8) + 1).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"))
    narrow = narrow.withColumn("shard", rendezvous(F.col(key), weights))
    extra = score(F.col(key), len(weights))
    own = F.array(*[score(F.col(key), i, w) for i, w in enumerate(weights)])
    grown = F.when(extra < F.array_min(own), F.lit(len(weights))).otherwise(F.col("shard"))
    return with_slot(write_table(narrow.withColumn("grown_shard", grown), "shards"), [key, "size", "text_crc32"])
