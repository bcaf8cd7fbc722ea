"""Allocation of a corpus's token target over its parts and sources: the caps that W1 then keeps to.

A part (say 80 of 100 for one subject, 20 for the rest) has a share of the target, and the sources of a part share what falls to it.
What a part or a source can't give, because it has no more tokens or a cap of its own, goes to those that still have room,
in the ratio of their weights (water-filling). All sums are exact integers.

Scale: the only pass over the data is the token total of each source, a partial aggregation. The tables here have one row a source,
so their windows are over the declared registry and don't grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def water_fill(df: DataFrame, by: list[str], name: str, limit: str, weight: str, quota: str, out: str) -> DataFrame:
    """``df`` (one row per ``by`` and ``name``) with ``out``: the row's part of the group's ``quota`` (equal in all its rows).

    Rows get ``weight`` x level, at most ``limit``; the level is the one at which the group's parts add up to its quota, or every row
    its limit where the quota is larger. Parts are rounded down, and what that leaves goes one by one to rows with room, in
    order of ``name``. Weights are 1 or more; a null or negative limit counts as 0.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    lim, w, q = F.greatest(F.coalesce(F.col(limit), F.lit(0)), F.lit(0)).cast("long"), F.col(weight).cast("long"), F.col(quota).cast("long")
    rows = df.withColumns({"_lim": lim, "_w": w, "_q": q})
    # breakpoints: the levels at which the rows are full, in ascending order, compared exactly
    up = group.orderBy(F.expr("_lim div _w"), F.expr("(_lim % _w) / _w"), F.col(name).asc_nulls_first())
    rows = rows.withColumns({
        "_at": F.row_number().over(up),
        "_left": F.col("_q") - F.coalesce(F.sum("_lim").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_open": F.sum("_w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    here = F.when(F.col("_left") * F.col("_w") <= F.col("_lim") * F.col("_open"), F.struct("_at", "_left", "_open"))
    rows = rows.withColumn("_stop", F.min(here).over(group))  # the first row that isn't filled up
    rows = rows.withColumn("_part", F.expr("if(_stop is null or _at < _stop._at, _lim, (_w * _stop._left) div _stop._open)"))
    rest = F.least(F.col("_q"), F.sum("_lim").over(group)) - F.sum("_part").over(group)
    room = F.col("_part") < F.col("_lim")
    turn = F.sum(room.cast("int")).over(group.orderBy(F.col(name).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_rest": rest, "_turn": turn})
    part = F.col("_part") + (room & (F.col("_turn") <= F.col("_rest"))).cast("long")
    return rows.withColumn(out, part).drop("_lim", "_w", "_q", "_at", "_left", "_open", "_stop", "_part", "_rest", "_turn")


def _share_of(shares: dict[str, int], part: str) -> Column:
    pairs = [x for k, v in shares.items() for x in (F.lit(k), F.lit(int(v)))]
    return F.try_element_at(F.create_map(*pairs), F.col(part))


def allocate(sources: DataFrame, target: int, shares: dict[str, int], part: str = "part", source: str = "source",
             available: str = "available", declared: str | None = None, weight: str | None = None) -> DataFrame:
    """``sources`` (one row a source: its part, the tokens it has and maybe a cap and a weight) with ``cap``, the tokens to take.

    ``shares`` gives each part's weight of ``target``; a source of a part without one gets 0. All caps together are the target,
    or all that may be taken where that is less.
    """
    if target < 0 or not shares or min(shares.values()) < 1:
        raise ValueError("the target is 0 or more, and every share 1 or more")
    known = _share_of(shares, part)
    most = F.col(available) if declared is None else F.least(F.col(available), F.col(declared))  # a null cap: none
    rows = sources.withColumns({"_most": F.when(known.isNotNull(), most).otherwise(F.lit(0)).cast("long"),
                                "_weight": F.lit(1) if weight is None else F.col(weight)})
    parts = rows.groupBy(part).agg(F.sum("_most").alias("_most")).withColumns({"_share": F.coalesce(known, F.lit(1)), "_target": F.lit(int(target))})
    parts = water_fill(parts, [], part, "_most", "_share", "_target", "_quota").select(F.col(part).alias("_p"), "_quota")
    rows = rows.join(parts, F.col(part).eqNullSafe(F.col("_p"))).drop("_p")
    return water_fill(rows, [part], source, "_most", "_weight", "_quota", "cap").drop("_most", "_weight", "_quota")
