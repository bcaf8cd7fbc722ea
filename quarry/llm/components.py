"""Connected components of an edge table, by alternating large-star and small-star rounds of aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import write_table


def _stars(both: DataFrame, least: DataFrame) -> DataFrame:
    return both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _stars(both.filter("v > u"), least).filter("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _stars(down, least).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def _is_forest(table: DataFrame) -> bool:
    """Whether every node has one parent and no parent has one: then parents are the components' least nodes."""
    ends = table.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        table.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)")
    return odd.isEmpty()


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(u, v)``: each node of ``edges`` (u, v) but the least of its component, and that least node. Rounds grow with the
    logarithm of the longest path; a star takes one. After a given number of ``rounds`` these are edges that join the same
    components: v is perhaps not the least node yet, and u may have several."""
    table, done = edges.filter("u != v"), 0
    while True:
        table, done = write_table(_small(_large(table)), "components"), done + 1
        if done == rounds or rounds is None and _is_forest(table):
            return table
