"""The source registry, opening sources, skipping missing ones, readiness report.

A registry is an ordered list of ``SourceSpec``. Order is meaning (interleave order), so every
source carries ``source_idx``. Predicates are ``Column`` expressions or SQL strings, never Python
lambdas, so Catalyst pushes them into the scan.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SourceSpec:
    name: str
    path: str
    format: str = "parquet"
    split: str | None = None  # value of the split column, if any
    split_col: str = "split"
    cap_tokens: int | None = None  # token budget (W1); None = unlimited
    cap_rows: int | None = None  # row limit (L1)
    part: str | None = None  # the part of the corpus that the source counts towards, when a token target is shared out
    weight: int = 1  # its weight among the sources of that part
    predicate: Column | str | None = None
    config: str | None = None  # sub-folder / partition of the source, honoured always (D9)
    options: dict = field(default_factory=dict)
    rename: dict = field(default_factory=dict)  # field renames applied after open (schema mapping)
    schema: str | None = None  # declared schema (DDL); avoids an inference pass over JSON/CSV sources


def _open_table(spark: SparkSession, spec: SourceSpec, schema=None) -> DataFrame:
    """What is read for a source, before its predicate."""
    path = spec.path if spec.config is None else f"{spec.path.rstrip('/')}/{spec.config}"
    reader = spark.read.format(spec.format).options(**spec.options)
    schema = schema if schema is not None else spec.schema
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    for old, new in spec.rename.items():
        df = df.withColumnRenamed(old, new)
    if spec.split is not None:
        if spec.split_col not in df.columns:
            raise ValueError(f"source {spec.name!r} has no split: no column {spec.split_col!r}")
        df = df.filter(F.col(spec.split_col) == spec.split)
    return df


def _predicate(spec: SourceSpec) -> Column | None:  # P1
    return F.expr(spec.predicate) if isinstance(spec.predicate, str) else spec.predicate


def open_source(spark: SparkSession, spec: SourceSpec, schema=None) -> DataFrame:
    """Open one source lazily; split becomes a filter (pushed to the scan / partition pruning)."""
    df, pred = _open_table(spark, spec, schema), _predicate(spec)
    return df if pred is None else df.filter(pred)


def _attempt(opening):
    """The frame that ``opening`` makes, or what kept it from being opened (S3: any error does)."""
    try:
        df = opening()
        df.schema  # analysis happens here: a missing path raises PATH_NOT_FOUND
        return df, None
    except AnalysisException as e:
        cond = getattr(e, "getCondition", None) or getattr(e, "getErrorClass", None)
        return None, ((cond() if cond else None) or type(e).__name__)
    except Exception as e:  # an unknown format, a split that isn't there, a store that can't be reached
        return None, type(e).__name__


def _probe(spark: SparkSession, spec: SourceSpec):
    return _attempt(lambda: open_source(spark, spec))


def _table_key(spec: SourceSpec) -> tuple:
    return (spec.path, spec.format, spec.config, spec.split, spec.split_col, spec.schema,
            repr(sorted(spec.options.items())), repr(list(spec.rename.items())))


def _shareable(df: DataFrame, own: DataFrame, pred: Column) -> bool:
    """Whether a predicate gives the same answer twice (a random draw doesn't) and works outside a filter (a subquery doesn't)."""
    return own._jdf.queryExecution().analyzed().deterministic() and _attempt(lambda: df.select(F.explode(F.array(pred))))[1] is None


def open_scans(spark: SparkSession, registry: list[SourceSpec]) -> tuple[list[tuple[DataFrame, Column]], dict[int, str]]:
    """S2 for a whole registry: ``(scans, errors)``, the errors by registry position.

    Sources that differ only in their predicate share one scan, else the table that holds them is read once for each. A predicate that
    draws at random or holds a subquery keeps a scan of its own. A scan is
    ``(rows, of)``: the rows that any of its sources takes (their predicates reach the scan, joined by or), and a column for ``select``
    that gives the struct ``(source, source_idx)`` of a row, repeating a row that several sources take.
    """
    tables, groups, errors = {}, {}, {}
    for idx, spec in enumerate(registry):
        key = _table_key(spec)
        if key not in tables:
            tables[key] = _attempt(lambda: _open_table(spark, spec))
        (df, err), pred = tables[key], _predicate(spec)
        if err is None and pred is not None:
            own, err = _attempt(lambda: df.filter(pred))
            if err is None and not _shareable(df, own, pred):
                key = (*key, idx)
        if err is not None:
            errors[idx] = err
            continue
        tag = F.struct(F.lit(spec.name).alias("source"), F.lit(idx).alias("source_idx"))
        groups.setdefault(key, (df, []))[1].append((pred, tag))
    scans = []
    for df, members in groups.values():
        preds = [pred for pred, _ in members]
        if all(pred is not None for pred in preds):
            df = df.filter(reduce(lambda a, b: a | b, preds))
        if len(members) == 1:
            of = members[0][1]
        else:
            of = F.explode(F.array_compact(F.array(*[tag if pred is None else F.when(pred, tag) for pred, tag in members])))
        scans.append((df, of))
    return scans, errors


def skipped_sources(spark: SparkSession, registry: list[SourceSpec]) -> dict[str, str]:
    """The sources that ``on_error="skip"`` leaves out, each with its error."""
    found = {spec.name: _probe(spark, spec)[1] for spec in registry}
    return {name: err for name, err in found.items() if err is not None}


def union_sources(
    spark: SparkSession,
    registry: list[SourceSpec],
    on_error: str = "fail",
    columns: list[str] | None = None,
) -> DataFrame:
    """S1 + U1: one DataFrame over all sources (``unionByName``, missing columns null).

    Adds ``source`` (name) and ``source_idx`` (registry position). ``on_error="skip"`` drops sources
    that cannot be opened (S3; :func:`skipped_sources` names them, and each is a warning); ``"fail"`` raises.
    """
    scans, errors = open_scans(spark, registry)
    for idx, err in errors.items():
        if on_error != "skip":
            raise AnalysisException(f"source {registry[idx].name!r} cannot be opened: {err}")
        warnings.warn(f"source {registry[idx].name!r} skipped: {err}", stacklevel=2)
    frames = []
    for df, of in scans:
        kept = df.columns if columns is None else [c for c in columns if c in df.columns]
        df = df.select(*[F.col(f"`{c}`") for c in kept], of.alias("_of"))
        frames.append(df.withColumn("source", F.col("_of.source")).withColumn("source_idx", F.col("_of.source_idx")).drop("_of"))
    if not frames:
        raise ValueError("no source could be opened")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def source_readiness(
    spark: SparkSession, registry: list[SourceSpec], probe_rows: int = 100
) -> tuple[DataFrame, DataFrame]:
    """S4 + L2 (R): per source: opened?, first row present?, rows verified (at most ``probe_rows``).

    Returns (per-source table, one-row summary ``successful, total, failed``). Each source is read
    through ``limit`` so only the first rows are touched; the frames are tiny by construction.
    """
    rows = []
    for idx, spec in enumerate(registry):
        df, err = _probe(spark, spec)
        if err is not None:
            rows.append(
                spark.range(1).select(
                    F.lit(idx).alias("source_idx"),
                    F.lit(spec.name).alias("source"),
                    F.lit(False).alias("ok"),
                    F.lit(0).cast("long").alias("verified_rows"),
                    F.lit(err).alias("error"),
                )
            )
            continue
        probe = df.limit(probe_rows).agg(F.count(F.lit(1)).alias("verified_rows"))
        rows.append(
            probe.select(
                F.lit(idx).alias("source_idx"),
                F.lit(spec.name).alias("source"),
                (F.col("verified_rows") > 0).alias("ok"),
                F.col("verified_rows").cast("long"),
                F.when(F.col("verified_rows") == 0, F.lit("EMPTY")).alias("error"),
            )
        )
    per_source = reduce(DataFrame.unionByName, rows)
    summary = per_source.agg(
        F.sum(F.col("ok").cast("long")).alias("successful"),
        F.count(F.lit(1)).alias("total"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("source")))), ",").alias("failed"),
    )
    return per_source, summary
