"""Order-dependent operators without a single-task window.

The reference folds over one ordered stream. A plain ``Window.partitionBy(source).orderBy(key)``
reproduces that but puts a whole source -- possibly a third of the corpus -- into one task. Instead:

* **Bucketed prefix sum.** Cut the order key into ``n_buckets`` order-preserving ranges from
  literal bounds (one profile job with ``percentile_approx``; then a pure function of the key, so
  recomputation after an executor loss lands every row in the same bucket). Totals per ``(group, bucket)`` are a small
  table; running offsets over it are joined back, and the running sum inside a bucket is a local
  window over one ``(group, bucket)`` only.
* **Prefix cut-offs.** A token budget and a row cap keep a *prefix* of each group (the running sum
  of non-negative numbers is monotone), so the answer is one cut-off key per group. The running sum
  runs on the narrow ``(group, key, n)`` projection; the wide rows (text) are only filtered against a
  one-row-per-group table -- they are never shuffled.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage

BROADCAST_MAX_ROWS = 2_000_000  # rows of a small side we are willing to ship to every executor


def _cols(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def default_buckets(df: DataFrame) -> int:
    """Buckets per order key: a few per shuffle partition, so each local window is a fraction of a task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    return max(4, 4 * n)


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Materialise a derived small table once (reliable checkpoint) and broadcast it only if it is
    proven small; otherwise leave the join to a shuffle (and AQE)."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= max_rows else df


def bucket_splits(df: DataFrame, key: str, n_buckets: int | None = None) -> list[float]:
    """Literal, order-preserving bucket bounds of ``key`` from one ``approxQuantile`` pass."""
    n_buckets = n_buckets or default_buckets(df)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = df.approxQuantile(key, probs, 1.0 / (4 * n_buckets)) if probs else []
    return [float("-inf")] + sorted({float(b) for b in bounds if b is not None}) + [float("inf")]


def apply_buckets(df: DataFrame, key: str, splits: list[float], out: str = "_bkt") -> DataFrame:
    """Bucket id of ``key`` from literal bounds: a pure function of the key (JVM binary search)."""
    if len(splits) < 3:  # one bucket
        return df.withColumn(out, F.lit(0))
    keyed = df.withColumn("_bkey", F.col(key).cast("double"))
    out_df = Bucketizer(splits=splits, inputCol="_bkey", outputCol=out).transform(keyed)
    return out_df.withColumn(out, F.col(out).cast("int")).drop("_bkey")


def order_bucket(df: DataFrame, key: str, n_buckets: int | None = None, out: str = "_bkt") -> DataFrame:
    """Add an order-preserving bucket id of ``key`` (integral, unique per group, |key| < 2^53)."""
    return apply_buckets(df, key, bucket_splits(df, key, n_buckets), out)


def _profile(narrow: DataFrame, key: str, g: list[str], n_buckets: int | None):
    """One job over the narrow table: row count, exact number of groups, and bucket bounds."""
    n_buckets = n_buckets or default_buckets(narrow)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    aggs = [F.count(F.lit(1)).alias("n"),
            (F.count_distinct(F.struct(*g)) if g else F.lit(1).cast("long")).alias("ng")]
    if probs:
        aggs.append(F.percentile_approx(F.col(key).cast("double"), probs, max(10_000, 4 * n_buckets)).alias("q"))
    row = narrow.agg(*aggs).first()
    bounds = (row["q"] or []) if probs else []
    splits = [float("-inf")] + sorted({float(b) for b in bounds if b is not None}) + [float("inf")]
    return row["n"], row["ng"], splits


def _running_agg(df, value, key, group, out, agg, inclusive, n_buckets, cast, materialized=False):
    fn = {"sum": F.sum, "min": F.min, "max": F.max}[agg]
    g = _cols(group)
    val = F.col(value) if isinstance(value, str) else value
    narrow = df.select(*g, key, val.cast(cast).alias("_v"))
    narrow = narrow if materialized else cut_lineage(narrow)
    n, ng, splits = _profile(narrow, key, g, n_buckets)
    hi = 0 if inclusive else -1
    totals = apply_buckets(narrow, key, splits).groupBy(*g, "_bkt").agg(fn("_v").alias("_bt"))
    w_off = Window.partitionBy(*g).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*g, "_bkt", fn("_bt").over(w_off).alias("_off"))
    # the offsets table has at most (#groups x #buckets) rows: a bound known from the profile job
    if ng * (len(splits) - 1) <= BROADCAST_MAX_ROWS:
        offsets = F.broadcast(offsets)
    b = apply_buckets(df.withColumn("_v", val.cast(cast)), key, splits)
    joined = b.join(offsets, [*g, "_bkt"])
    w = Window.partitionBy(*g, "_bkt").orderBy(key).rowsBetween(Window.unboundedPreceding, hi)
    local = fn("_v").over(w)
    if agg == "sum":
        res = F.coalesce(F.col("_off"), F.lit(0).cast(cast)) + F.coalesce(local, F.lit(0).cast(cast))
        if not inclusive:
            res = F.when(F.col("_off").isNull() & local.isNull(), F.lit(None)).otherwise(res)
    elif agg == "min":
        res = F.least(F.col("_off"), local)
    else:
        res = F.greatest(F.col("_off"), local)
    return joined.withColumn(out, res).drop("_v", "_bkt", "_off"), ng


def running_agg(
    df: DataFrame,
    value: Column | str,
    key: str,
    group: str | list[str] | None = None,
    out: str = "cum",
    agg: str = "sum",
    inclusive: bool = True,
    n_buckets: int | None = None,
    cast: str = "long",
) -> DataFrame:
    """Running ``sum``/``min``/``max`` of ``value`` over ``key`` within ``group``, balanced across tasks.

    ``inclusive=False`` gives the aggregate of the rows strictly before (null for the first row).
    The narrow ``(group, key, value)`` projection is written once (reliable checkpoint); one job over
    it yields the row count, the exact number of groups and the bucket bounds, which prove the size
    of the offsets table before it is broadcast. The wide input is evaluated once more, for the final
    local windows.
    """
    return _running_agg(df, value, key, group, out, agg, inclusive, n_buckets, cast)[0]


def running_sum(df: DataFrame, value, key: str, group=None, out: str = "cum", n_buckets: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` over ``key`` within ``group``."""
    return running_agg(df, value, key, group, out, "sum", True, n_buckets)


def running_count(df: DataFrame, key: str, group=None, out: str = "rn", n_buckets: int | None = None) -> DataFrame:
    """1-based row number over ``key`` within ``group`` (balanced; equals ``row_number``)."""
    return running_sum(df, F.lit(1), key, group, out, n_buckets)


def ordered_position(df: DataFrame, keys: list[str], out: str = "pos", pieces: str | None = None, idx: str = "idx") -> DataFrame:
    """W6 in the order of several keys (together unique), each a column of its own: the 0-based position of every row, or, with ``pieces``,
    of every element of that array column: a row each, with its place ``idx`` in the array; the keys of a row stay together.

    One sort by range: a task numbers its own stretch in the JVM while the rows pass by to a stored table, and the counts of the tasks
    before it, one row a task, are added as an offset. ``df`` should be a stored table or cheap, since the bounds of the ranges come
    from a sample of it.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    if pieces is not None:
        dealt = dealt.select(*[c for c in df.columns if c != pieces], F.posexplode(pieces).alias(idx, pieces)).withColumn(idx, F.col(idx).cast("long"))
    names = dealt.columns
    local = cut_lineage(dealt.withColumn("_id", F.monotonically_increasing_id()))  # the task's number above 33 bits of the row's in it
    task, own = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    totals = local.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    totals = cut_lineage(totals.select("_task", F.coalesce(before, F.lit(0)).alias("_before")))  # as many rows as tasks
    res = local.withColumn("_task", task).join(F.broadcast(totals), "_task")
    return res.select(*names, (F.col("_before") + own).alias(out))


def _cap_expr(cap, group: list[str]) -> Column:
    if isinstance(cap, dict):
        if len(group) != 1:
            raise ValueError("a per-group cap mapping needs exactly one group column")
        expr = None
        for k, v in cap.items():
            expr = (F.when(F.col(group[0]) == F.lit(k), F.lit(int(v))) if expr is None
                    else expr.when(F.col(group[0]) == F.lit(k), F.lit(int(v))))
        return expr.otherwise(F.lit(None).cast("long"))
    return F.lit(int(cap)).cast("long")


def prefix_cutoffs(df: DataFrame, value: Column | str, key: str, group, cap) -> DataFrame:
    """Per group, the largest ``key`` whose inclusive running sum of ``value`` is <= cap.

    Runs on the narrow projection only. A group whose first row already overflows gets no row.
    A ``None`` cap (group missing from a mapping) means unlimited.
    """
    return _prefix_cutoffs(df, value, key, group, cap)[0]


def _prefix_cutoffs(df: DataFrame, value, key: str, group, cap):
    g = _cols(group)
    val = F.col(value) if isinstance(value, str) else value
    narrow = cut_lineage(df.select(*g, key, val.cast("long").alias("_n")))  # the only pass over df
    cum, ng = _running_agg(narrow, "_n", key, g, "_cum", "sum", True, None, "long", materialized=True)
    if isinstance(cap, DataFrame):  # a (group..., cap) table, one row per group
        cum = cum.join(checked_broadcast(cap.select(*g, F.col("cap").cast("long").alias("_capv"))), g, "left")
        capc = F.col("_capv")
    else:
        capc = _cap_expr(cap, g)
    cuts = cum.filter(capc.isNull() | (F.col("_cum") <= capc)).groupBy(*g).agg(F.max(key).alias("_cut"))
    return cuts, ng


def _small_side(cuts: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast a table whose row count is bounded by ``n_rows`` (known); else a shuffle join."""
    return F.broadcast(cuts) if n_rows <= BROADCAST_MAX_ROWS else cuts


def token_budget(df: DataFrame, cap, n_col: str = "n_tokens", key: str = "doc_id", group="source") -> DataFrame:
    """Per group, keep rows while the running token total stays <= cap; stop at the first overflow.

    ``cap`` is an int, a ``{group value: cap}`` mapping or a ``(group..., cap)`` DataFrame.
    Returns the input rows (all columns) kept.
    """
    g = _cols(group)
    cuts, ng = _prefix_cutoffs(df, n_col, key, g, cap)  # one row per group at most
    return df.join(_small_side(cuts, ng), g).filter(F.col(key) <= F.col("_cut")).drop("_cut")


def row_cap(df: DataFrame, n, key: str = "doc_id", group="source") -> DataFrame:
    """L1: the first ``n`` rows of every group by ``key`` (``n`` int or mapping)."""
    g = _cols(group)
    cuts, ng = _prefix_cutoffs(df, F.lit(1), key, g, n)
    return df.join(_small_side(cuts, ng), g).filter(F.col(key) <= F.col("_cut")).drop("_cut")


def interleave(
    df: DataFrame,
    key: str = "doc_id",
    source_idx: str = "source_idx",
    strategy: str = "first_exhausted",
    n_buckets: int | None = None,
    expected: list[int] | None = None,
    last_round: str = "whole",
) -> DataFrame:
    """Round-robin interleave of the sources of ``df`` (equal share, registry order).

    ``expected`` lists the registry positions that were opened; with ``first_exhausted`` one of them
    having no rows ends the interleave before it starts (as a stream that is exhausted at once).

    Adds ``rn`` (round, 1-based) and ``pos`` (0-based global position; order = ``(rn, source_idx)``).
    ``first_exhausted`` runs while every source has rows. ``last_round="whole"`` keeps whole rounds, as an
    interleave of tables does; ``"partial"`` stops right after the first source's last row, as one of streams
    does, so the last round holds the sources up to that one. ``all_exhausted`` runs as
    many rounds as the longest source, short sources wrapping around (their rows repeat).
    """
    if strategy not in ("first_exhausted", "all_exhausted") or last_round not in ("whole", "partial"):
        raise ValueError(f"unknown strategy {strategy!r} or last_round {last_round!r}")
    ranked = running_count(df, key, source_idx, "_r", n_buckets)
    counts = df.groupBy(source_idx).agg(F.count(F.lit(1)).alias("_cnt"))
    if expected is not None and strategy == "first_exhausted":
        # a registered source without rows is exhausted at once: the interleave then yields nothing
        reg = df.sparkSession.createDataFrame([(int(i),) for i in expected], f"{source_idx} int")
        if reg.join(counts, source_idx, "left_anti").limit(1).count() > 0:
            return ranked.limit(0).withColumn("rn", F.lit(0).cast("long")).withColumn("pos", F.lit(0).cast("long")) \
                .drop("_r")
    stats = cut_lineage(counts.withColumn("_srank", (F.row_number().over(Window.orderBy(source_idx)) - 1).cast("long")))
    n, low, high = stats.agg(F.count(F.lit(1)), F.min("_cnt"), F.max("_cnt")).first()
    # one row per source: bounded by the registry when it is known, else by the count
    stats = F.broadcast(stats) if n <= BROADCAST_MAX_ROWS else stats
    if not n:
        j = ranked.join(stats, source_idx).withColumn("rn", F.col("_r"))
    elif strategy == "first_exhausted":
        j = ranked.join(stats, source_idx).filter(F.col("_r") <= low).withColumn("rn", F.col("_r"))
        if last_round == "partial":
            stop = stats.filter(F.col("_cnt") == low).agg(F.min("_srank")).first()[0]
            j = j.filter((F.col("_r") < low) | (F.col("_srank") <= stop))
    else:
        # every position of the result, made in parallel; a short source's row meets all its rounds
        slots = df.sparkSession.range(n * high).select(F.floor(F.col("id") / n).alias("_round"), F.pmod("id", F.lit(n)).alias("_srank"))
        slots = slots.join(stats, "_srank").withColumn("_r", F.pmod("_round", "_cnt") + 1).withColumn("rn", F.col("_round") + 1)
        j = ranked.join(slots.drop("_round"), [source_idx, "_r"])
    pos = (F.col("rn") - 1) * F.lit(n) + F.col("_srank")
    return j.withColumn("pos", pos.cast("long")).withColumn("rn", F.col("rn").cast("long")).drop("_r", "_cnt", "_srank")


def _draws(spark, n: int, seed: int, thresholds: list[tuple[int, int]], source_idx: str) -> DataFrame:
    """``(pos, source)`` of the first ``n`` draws. A draw is a pure function of the seed and the position: the first 32 bits of
    md5("seed:position"), below the threshold of its source."""
    x = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")
    own = F.lit(None).cast("int")
    for source, upto in reversed(thresholds):
        own = F.when(x < upto, F.lit(source)).otherwise(own)
    return spark.range(n).select(F.col("id").alias("pos"), own.alias(source_idx))


def interleave_weighted(df: DataFrame, probabilities: dict[int, float], seed: int = 42, key: str = "doc_id", source_idx: str = "source_idx",
                        strategy: str = "first_exhausted") -> DataFrame:
    """W2 with probabilities: every position draws a source, and a source's n-th draw takes its n-th row by ``key``.

    ``first_exhausted`` ends right after the first source's last row, ``all_exhausted`` once every source has given all its rows,
    short ones beginning again. Adds ``pos`` (from 0) and ``draw`` (the source's, from 1). Sources of probability zero, or
    not named, give nothing; one that is named but has no rows is exhausted at once. The draws are made in parallel by ranges of positions, counted by balanced
    running counts, and met with the rows by an equi-join on (source, row number).
    """
    if strategy not in ("first_exhausted", "all_exhausted"):
        raise ValueError(strategy)
    total = sum(probabilities.values())
    if total <= 0 or min(probabilities.values()) < 0:
        raise ValueError("probabilities must be positive")
    spark, upto, so_far = df.sparkSession, [], 0.0
    for source, p in sorted(probabilities.items()):
        so_far += p / total
        if p > 0:
            upto.append((source, round(so_far * 2**32)))
    upto[-1] = upto[-1][0], 2**32
    ranked = running_count(df, key, source_idx, "_r")
    counts = {r[source_idx]: r["n"] for r in df.groupBy(source_idx).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per source
    dry = [counts.get(source, 0) for source, _ in upto]
    if not (all(dry) if strategy == "first_exhausted" else any(dry)):
        return ranked.limit(0).withColumn("pos", F.lit(0).cast("long")).withColumn("draw", F.lit(0).cast("long")).drop("_r")
    wanted = {source: counts[source] for source, _ in upto if counts.get(source)}
    size = spark.createDataFrame(list(wanted.items()), f"{source_idx} int, _cnt long")
    share = {source: (probabilities[source] / total) for source in wanted}
    pick = min if strategy == "first_exhausted" else max
    n = int(1.05 * pick(c / share[s] for s, c in wanted.items())) + 1000
    while True:  # more draws where chance has kept the sources from running dry
        got = {r[source_idx]: r["n"] for r in _draws(spark, n, seed, upto, source_idx).groupBy(source_idx).agg(F.count(F.lit(1)).alias("n")).collect()}
        if (any if strategy == "first_exhausted" else all)(got.get(s, 0) >= c for s, c in wanted.items()):
            break
        n *= 2
    draws = cut_lineage(running_count(_draws(spark, n, seed, upto, source_idx), "pos", source_idx, "draw").join(F.broadcast(size), source_idx))
    last = draws.filter("draw = _cnt").agg((F.min if strategy == "first_exhausted" else F.max)("pos")).first()[0]
    taken = draws.filter(F.col("pos") <= last).select(source_idx, "pos", "draw", (F.pmod(F.col("draw") - 1, F.col("_cnt")) + 1).alias("_r"))
    return ranked.join(taken, [source_idx, "_r"]).drop("_r")


def repeat_epochs(df: DataFrame, epochs: int, pos: str = "pos") -> DataFrame:
    """The data repeated ``epochs`` times; order ``(epoch, pos)``. A generator, no join."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def rank_hash(key: Column | str) -> Column:
    """Deterministic 32-bit hash of a key (first 8 hex digits of md5 of its string form)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("long")


def rank_split(df: DataFrame, world_size: int, key: str = "doc_id", rank: int | None = None) -> DataFrame:
    """P10: ``rank = hash(key) mod world_size``; with ``rank`` given, keep that rank's rows only."""
    out = df.withColumn("rank", F.pmod(rank_hash(key), F.lit(world_size)).cast("int"))
    return out if rank is None else out.filter(F.col("rank") == rank)


def global_position(df: DataFrame, key: str, out: str = "pos", n_buckets: int | None = None) -> DataFrame:
    """0-based position of every row in the total order ``key`` (no group)."""
    return running_count(df, key, None, "_rn", n_buckets).withColumn(out, F.col("_rn") - 1).drop("_rn")


def count_shards(df: DataFrame, shard_size: int, pos: str = "pos") -> DataFrame:
    """``shard = pos div shard_size`` and the index inside the shard."""
    return (df.withColumn("shard", F.floor(F.col(pos) / shard_size).cast("long"))
              .withColumn("local_idx", F.pmod(F.col(pos), F.lit(shard_size)).cast("long")))


def batch_plan(df: DataFrame, batch_size: int, micro_batch_size: int, world_size: int = 1, pos: str = "pos") -> DataFrame:
    """A5: consecutive rows in batches of ``batch_size`` (last partial kept) and micro-batch slices.

    Gradient-accumulation steps = ``batch // (micro * world)`` must be >= 1 (the reference asserts it).
    """
    accum = batch_size // (micro_batch_size * world_size)
    if accum < 1:
        raise ValueError("batch_size must be >= micro_batch_size * world_size")
    p = F.col(pos)
    return (df.withColumn("batch_id", F.floor(p / batch_size).cast("long"))
              .withColumn("micro_id", F.floor(F.pmod(p, F.lit(batch_size)) / micro_batch_size).cast("long"))
              .withColumn("accum_steps", F.lit(accum)))
