"""Token-id array functions as JVM expressions on ``array<bigint>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def append_eos(ids, eos: int, mode: str = "always") -> Column:
    """``always`` appends EOS (also to an empty array); ``if_missing`` only to a non-empty array
    whose last id is not EOS. The size is checked before ``element_at`` (which raises on [] under ANSI)."""
    ids = _c(ids)
    added = F.concat(ids, F.array(F.lit(eos).cast("long")))
    if mode == "always":
        return added
    if mode != "if_missing":
        raise ValueError(mode)
    last_is_eos = F.when(F.size(ids) > 0, F.element_at(ids, -1) == F.lit(eos)).otherwise(F.lit(True))
    return F.when(last_is_eos, ids).otherwise(added)


def truncate(ids, length: int) -> Column:
    """the first ``length`` ids."""
    return F.slice(_c(ids), 1, length)


def pad(ids, length: int, pad_id: int) -> Column:
    """right-pad to ``length`` (longer arrays are left as they are)."""
    ids = _c(ids)
    n = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(pad_id).cast("long"), n))


def attention_mask(ids, pad_id: int, mode: str = "id", real_length: Column | None = None) -> Column:
    """``id`` -> 1 where ``id != pad`` (the reference's rule, D12); ``length`` -> 1 for the first
    ``real_length`` positions."""
    ids = _c(ids)
    if mode == "id":
        return F.transform(ids, lambda x: (x != F.lit(pad_id)).cast("long"))
    return F.transform(ids, lambda x, i: (i < real_length).cast("long"))


def chunks(ids, length: int) -> Column:
    """F8: the array cut into pieces of ``length`` (last one short); ``[]`` gives one empty piece. The array is bound to a lambda's
    variable, so that an expression given for it is computed once and not for every piece."""

    def cut(x):
        starts = F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(length))
        return F.transform(starts, lambda i: F.slice(x, i + 1, length))

    return F.get(F.transform(F.array(_c(ids)), cut), F.lit(0))


def fixed_length(ids, text_empty: Column, length: int, eos: int, pad_id: int | None = None,
                 eos_mode: str = "always", mask_mode: str = "id", empty: str = "pad") -> tuple[Column, Column]:
    """C4 core: EOS -> truncate -> pad -> mask; an empty text becomes a full-pad row.

    ``pad_id`` defaults to EOS (the reference's fallback). Returns ``(input_ids, attention_mask)``;
    with ``empty="drop"`` an empty text gives ``[]`` (drop it with :func:`drop_empty`).
    """
    pad_id = eos if pad_id is None else pad_id
    full = append_eos(ids, eos, eos_mode)
    real = F.least(F.size(full), F.lit(length))
    padded = pad(truncate(full, length), length, pad_id)
    full_pad = F.array_repeat(F.lit(pad_id).cast("long"), length)
    empty_ids = full_pad if empty == "pad" else F.array().cast("array<bigint>")
    input_ids = F.when(text_empty, empty_ids).otherwise(padded)
    if mask_mode == "id":
        mask = attention_mask(input_ids, pad_id, "id")
    else:
        mask = F.when(text_empty, F.transform(empty_ids, lambda x: F.lit(0).cast("long"))).otherwise(
            attention_mask(padded, pad_id, "length", real))
    return input_ids, mask


def with_fixed_length(df: DataFrame, ids: str, text_empty: str, length: int, eos: int, pad_id: int | None = None,
                      eos_mode: str = "always", mask_mode: str = "id", empty: str = "pad",
                      out_ids: str = "input_ids", out_mask: str = "attention_mask") -> DataFrame:
    """C4 core as projection steps: each intermediate array is its own column, so no array
    expression is re-evaluated where it is referenced several times (Catalyst does not collapse
    projections that would duplicate non-trivial expressions).

    With ``empty="drop"`` (P9) the rows of empty text are dropped on the boolean flag itself: a
    filter on the computed array would be pushed below the projections and evaluate it twice.
    """
    pad_id = eos if pad_id is None else pad_id
    if empty == "drop":
        df = df.filter(~F.col(text_empty))
    d = df.withColumn("_full", append_eos(ids, eos, eos_mode))
    d = d.withColumn("_real", F.least(F.size("_full"), F.lit(length))).withColumn("_trunc", truncate("_full", length))
    full_pad = F.array_repeat(F.lit(pad_id).cast("long"), length)
    empty_ids = full_pad if empty == "pad" else F.array().cast("array<bigint>")
    d = d.withColumn(out_ids, F.when(F.col(text_empty), empty_ids).otherwise(pad("_trunc", length, pad_id)))
    if mask_mode == "id":
        d = d.withColumn(out_mask, attention_mask(out_ids, pad_id, "id"))
    else:
        d = d.withColumn(out_mask, F.when(F.col(text_empty), F.transform(out_ids, lambda x: F.lit(0).cast("long")))
                         .otherwise(attention_mask(out_ids, pad_id, "length", F.col("_real"))))
    return d.drop("_full", "_real", "_trunc")


def drop_empty(df: DataFrame, col: str = "input_ids") -> DataFrame:
    """Drop examples whose ``input_ids`` is empty (use it on materialised ids, e.g. after a join
    or read; on freshly computed ids prefer ``with_fixed_length(empty="drop")``)."""
    return df.filter(F.size(col) > 0)


def word_length_ids(tokens: Column) -> Column:
    """SQL-reproducible stand-in ids: the character length of every whitespace token."""
    return F.transform(tokens, lambda t: F.length(t).cast("long"))
