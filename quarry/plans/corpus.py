"""The composite jobs, each a chain of the operators through ``DataFrame.transform``.

* :func:`build_text_shards`   registry -> filter -> count -> budget -> interleave -> near-dedup -> token shards -> JSONL
* :func:`chunked_sequences`   text lines -> strip/skip -> tokenise -> EOS -> chunk -> count shards -> parquet + metadata
* :func:`fixed_length_examples` resolve text -> tokenise -> EOS -> truncate -> pad -> mask
* :func:`training_view`       registry -> examples (ids and mask) -> interleave -> drop empty -> epochs -> batches -> ranks
* :func:`read_sequences`      sequence shards -> global index lookup -> truncate/pad/mask
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.errors import AnalysisException

from quarry.functions import sequences as SQ
from quarry.functions import text as T
from quarry.functions.tokenize import TokenizerSpec, encode
from quarry.operators import allocation as AL
from quarry.operators import ordered as O
from quarry.operators import shards as SH
from quarry.operators.dedup import near_dedup
from quarry.sources import registry as REG
from quarry.sources import sinks as SK
from quarry.sources.tables import spread
from quarry.session import cut_lineage
from quarry import defaults as DEF


def _with_counts(df: DataFrame, tokenizer: TokenizerSpec | None, keys: list[str]) -> DataFrame:
    if tokenizer is None:  # whitespace tokenizer, JVM only: recomputing it is cheaper than storing it
        return df.withColumn("n_tokens", T.whitespace_token_count("text"))
    # BPE runs once: the narrow (keys, n_tokens) table is written, then joined back to the text
    counts = cut_lineage(encode(df, tokenizer, "text", keys, "_ids")
                         .select(*keys, F.size("_ids").cast("long").alias("n_tokens")))
    return df.join(counts, keys)


def _merged_sources(spark: SparkSession, registry: list[REG.SourceSpec], order: str, resolve, on_error: str):
    """Every source opened (filters pushed to its scan, one scan for those of one table), its text resolved against its own
    schema, then one union ``(doc_id, source, source_idx, text)`` so that later stages run once for all."""
    scans, errors = REG.open_scans(spark, registry)
    for idx, err in errors.items():
        if on_error != "skip":
            raise ValueError(f"source {registry[idx].name!r} cannot be opened: {err}")
    frames = [df.select(F.col(order).cast("long").alias("doc_id"), of.alias("_of"), resolve(df))
              .select("doc_id", "_of.source", "_of.source_idx", "text") for df, of in scans]
    if not frames:
        raise ValueError("no source could be opened")
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f)
    return spread(merged), [idx for idx in range(len(registry)) if idx not in errors]


def _apply_caps(df: DataFrame, registry: list[REG.SourceSpec]) -> DataFrame:
    """W1 and L1 for all sources at once (one job set, per-source caps as a mapping)."""
    tok_caps = {s.name: s.cap_tokens for s in registry if s.cap_tokens is not None}
    row_caps = {s.name: s.cap_rows for s in registry if s.cap_rows is not None}
    if tok_caps:
        df = O.token_budget(df, tok_caps, "n_tokens", "doc_id", "source")
    if row_caps:
        df = O.row_cap(df, row_caps, "doc_id", "source")
    return df


def allocated(spark: SparkSession, registry: list[REG.SourceSpec], shares: dict[str, int], target: int | None = None, percent: int | None = None,
              order: str = "doc_id", tokenizer: TokenizerSpec | None = None, on_error: str = "fail") -> list[REG.SourceSpec]:
    """The registry with ``cap_tokens`` set so that its sources share out ``target`` tokens (or ``percent`` of all there are).

    ``shares`` has the weight of each part; what a short source or a source's own ``cap_tokens`` leaves goes to those with room, first in its
    part. One pass counts the tokens of each source. A source without a part that has a share, or one that can't be opened (``skip``), gets 0.
    """
    if (target is None) == (percent is None):
        raise ValueError("either target or percent")
    merged, _ = _merged_sources(spark, registry, order, T.resolve_text_presence, on_error)
    counted = _with_counts(merged, tokenizer, ["source_idx", "doc_id"]).groupBy("source_idx").agg(F.sum("n_tokens").alias("available"))
    declared = spark.createDataFrame([(i, s.part, s.weight, s.cap_tokens) for i, s in enumerate(registry)],
                                     "source_idx int, part string, weight int, declared long")
    rows = declared.join(counted, "source_idx", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    rows = cut_lineage(rows)  # one row per registry entry, as is all that follows
    if target is None:
        target = rows.agg(F.sum("available")).first()[0] * percent // 100
    caps = AL.allocate(rows, target, shares, source="source_idx", declared="declared", weight="weight")
    found = {r["source_idx"]: r["cap"] for r in caps.select("source_idx", "cap").collect()}
    return [replace(s, cap_tokens=found[i]) for i, s in enumerate(registry)]


def corpus_stream(spark: SparkSession, registry: list[REG.SourceSpec], order: str = "doc_id",
                  tokenizer: TokenizerSpec | None = None, on_error: str = "fail",
                  strategy: str = "first_exhausted") -> DataFrame:
    """The interleaved, budgeted document stream with ``pos``.

    Budgets and the interleave are planned on the narrow ``(source, doc_id, n_tokens)`` table, written
    once; the text is joined back once at the end. Every source keeps a prefix of its order, so the
    wide side is first cut to each source's kept key range (a one-row-per-source broadcast).
    """
    merged, opened = _merged_sources(spark, registry, order, T.resolve_text_presence, on_error)
    keys = ["source", "source_idx", "doc_id"]
    counted = _with_counts(merged, tokenizer, ["source_idx", "doc_id"])
    narrow = cut_lineage(counted.select(*keys, "n_tokens"))
    plan = cut_lineage(O.interleave(_apply_caps(narrow, registry), "doc_id", "source_idx", strategy, expected=opened))
    ranges = plan.groupBy("source_idx").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"))
    wide = merged.join(F.broadcast(ranges), "source_idx").filter(F.col("doc_id").between(F.col("_lo"), F.col("_hi")))
    return wide.drop("_lo", "_hi").join(plan, keys)  # ranges: one row per registry entry


def build_text_shards(spark: SparkSession, registry: list[REG.SourceSpec], out: str | None = None,
                      shard_tokens: int = DEF.SHARD_TOKENS, tokenizer: TokenizerSpec | None = None,
                      threshold: float = DEF.DEDUP_THRESHOLD, num_perm: int = DEF.DEDUP_NUM_PERM, mode: str = "reset",
                      drop_tail: bool = False, dedup: bool = True) -> DataFrame:
    """The corpus job. Returns ``(pos, source, doc_id, n_tokens, shard, text)``; writes JSONL
    shards to ``out`` when given. First occurrence (in interleave order) wins the dedup."""
    stream = cut_lineage(corpus_stream(spark, registry, tokenizer=tokenizer))  # the budgeted corpus, bounded by the caps
    plan = stream.select("pos", "n_tokens")  # dedup's sketches and the write read the text, the rest only these
    if dedup:
        plan = cut_lineage(plan.join(near_dedup(stream.select("pos", "text"), "pos", "text", threshold, num_perm).select("pos"), "pos", "left_semi"))
    plan = SH.token_shards(plan, shard_tokens, "pos", "n_tokens", mode, drop_tail)
    sharded = stream.join(plan.select("pos", "shard"), "pos")
    if out is not None:
        SK.write_text_shards(sharded, out)
    return sharded


def fixed_length_examples(df: DataFrame, tokenizer: TokenizerSpec, seq_length: int, keys: list[str],
                          empty: str = "pad", mask_mode: str = "id") -> DataFrame:
    """C4: ``keys + (input_ids, attention_mask)``; text resolved by first non-empty field (P6),
    special tokens off, EOS always, truncate, pad with pad (EOS when unset)."""
    resolved = df.select(*keys, T.resolve_text_first_nonempty(df))
    enc = encode(resolved, tokenizer, "text", keys + ["text"], "_ids", add_special_tokens=False)
    fx = SQ.with_fixed_length(enc.withColumn("_e", F.col("text") == ""), "_ids", "_e", seq_length, tokenizer.eos(),
                              tokenizer.pad(), "always", mask_mode, empty)
    out = fx.select(*keys, "input_ids", "attention_mask", F.size("_ids").cast("long").alias("n_tokens"))
    # The declared example features (as the reference's explicit Features)
    declared = ST.StructType([f for f in out.schema.fields if f.name in keys] + [
        ST.StructField("input_ids", ST.ArrayType(ST.LongType())),
        ST.StructField("attention_mask", ST.ArrayType(ST.LongType())),
        ST.StructField("n_tokens", ST.LongType())])
    return out.to(declared)


def chunked_sequences(lines: DataFrame, tokenizer: TokenizerSpec, seq_length: int = DEF.SEQ_LENGTH,
                      shard_size: int = DEF.SEQ_SHARD_SIZE, order: str | list[str] = "line_pos", out: str | None = None) -> DataFrame:
    """Lines ``(order..., value)`` -> stripped, non-blank -> ids (tokenizer default specials) ->
    EOS if missing -> chunks of ``seq_length`` -> global position -> count shards.

    Returns ``(order..., chunk_idx, pos, shard, local_idx, input_ids)``; with ``out`` writes parquet shards and
    metadata. The sequences are written once and sorted by range once, positions being counted while they pass by. The
    job knows the shards' sizes, so it writes them beside the shards (:func:`sequence_offsets`).
    """
    keys = [order] if isinstance(order, str) else list(order)
    s = lines.select(*[F.col(k).cast("long").alias(k) for k in keys], T.py_strip("value").alias("text")).filter(F.length("text") > 0)
    enc = encode(s, tokenizer, "text", keys, "_ids")
    seqs = cut_lineage(enc.select(*keys, SQ.chunks(SQ.append_eos("_ids", tokenizer.eos(), "if_missing"), seq_length).alias("input_ids")))
    pos = O.ordered_position(seqs, keys, pieces="input_ids", idx="chunk_idx")
    res = O.count_shards(pos, shard_size).select(*keys, "chunk_idx", "pos", "shard", "local_idx", "input_ids")
    if out is not None:
        SK.write_sequence_shards(res, f"{out}/shards")
        offsets = cut_lineage(SH.count_shard_offsets(res, shard_size))
        offsets.write.mode("overwrite").parquet(f"{out}/shards/{SK.OFFSETS}")
        sizes = offsets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_sequences"), F.count(F.lit(1)).alias("num_shards"))
        SK.write_metadata(sizes.select("*", F.lit(seq_length).cast("long").alias("seq_length"), F.lit(shard_size).cast("long").alias("shard_size")),
                          f"{out}/metadata")
    return res


def create_sequence_shards(spark: SparkSession, input_files: list[str], out: str, tokenizer: TokenizerSpec,
                           seq_length: int = DEF.SEQ_LENGTH, shard_size: int = DEF.SEQ_SHARD_SIZE) -> DataFrame:
    """C3 from text files: the files' lines in order -> sequence shards and metadata under ``out``."""
    return chunked_sequences(SK.read_text_lines_ordered(spark, input_files), tokenizer, seq_length, shard_size,
                             ["file_idx", "block_start", "line_no"], out)


def shard_metadata(seqs: DataFrame, seq_length: int, shard_size: int) -> DataFrame:
    """``total_sequences, num_shards, seq_length, shard_size``."""
    return seqs.agg(F.count(F.lit(1)).alias("total_sequences"), F.countDistinct("shard").alias("num_shards")).select(
        "total_sequences", "num_shards", F.lit(seq_length).cast("long").alias("seq_length"),
        F.lit(shard_size).cast("long").alias("shard_size"))


def sequence_offsets(spark: SparkSession, path: str) -> DataFrame:
    """A2: ``(shard, n, lo, hi)`` of the shards below ``path``: as the job that wrote them has left it, else counted."""
    try:
        return spark.read.schema("shard long, n long, lo long, hi long").parquet(f"{path}/{SK.OFFSETS}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return SH.shard_offsets(SK.read_sequence_shards(spark, path))


PRUNED = 1_000  # shards, and local indices, that are named in a scan's filter


def _only(seqs: DataFrame, hits: DataFrame) -> DataFrame:
    """``seqs`` filtered by the shards and local indices of ``hits``, where they are few: the scan then opens those shards'
    folders only, and in their files, sorted by local index, the row groups and pages that can hold one."""
    found = hits.agg(F.count_distinct("shard"), F.min("local_idx"), F.max("local_idx"), F.count_distinct("local_idx")).first()
    if not found[0] or found[0] > PRUNED:
        return seqs
    seqs = seqs.filter(F.col("shard").isin([r[0] for r in hits.select("shard").distinct().collect()]))  # PRUNED rows at most
    if found[3] <= PRUNED:
        return seqs.filter(F.col("local_idx").isin([r[0] for r in hits.select("local_idx").distinct().collect()]))
    return seqs.filter(F.col("local_idx").between(found[1], found[2]))


def read_sequences(spark: SparkSession, path: str, index: DataFrame, seq_length: int, pad_id: int,
                   idx: str = "idx", missing: str = "drop") -> DataFrame:
    """``(idx, shard, local_idx, input_ids, attention_mask)`` for every requested global index. An index that no
    shard holds has no row, or with ``missing="pad"`` a row of padding with a null shard. The shards themselves are read once, and only
    those (and of them only the parts) that a small set of indices needs."""
    hits = cut_lineage(SH.lookup_global_index(index, sequence_offsets(spark, path), idx))
    rows = hits.join(_only(SK.read_sequence_shards(spark, path), hits).select("shard", "local_idx", "input_ids"), ["shard", "local_idx"])
    if missing == "pad":
        rows = index.select(F.col(idx).cast("long").alias(idx)).join(rows, idx, "left").withColumn(
            "input_ids", F.coalesce("input_ids", F.array().cast("array<bigint>")))
    elif missing != "drop":
        raise ValueError(missing)
    ids = SQ.pad(SQ.truncate("input_ids", seq_length), seq_length, pad_id)
    return rows.select(idx, "shard", "local_idx", ids.alias("input_ids"), SQ.attention_mask(ids, pad_id).alias("attention_mask"))


def training_view(spark: SparkSession, registry: list[REG.SourceSpec], tokenizer: TokenizerSpec, seq_length: int,
                  epochs: int, batch_size: int, micro_batch_size: int, world_size: int, empty: str = "pad") -> DataFrame:
    """Examples (``input_ids`` and ``attention_mask``) from every source (filters honoured, budgets applied, D14), interleaved, those
    without ids dropped (P9), repeated ``epochs`` times, with batch / micro-batch ids and the rank of every row. An empty text is
    a row of padding, so that none is dropped for it, or has no ids with ``empty="drop"`` (D13): its turn in the interleave
    passes, positions go on without it. Sources that cannot be opened are skipped, as the reference does."""
    if empty not in ("pad", "drop"):
        raise ValueError(empty)
    merged, opened = _merged_sources(spark, registry, "doc_id", T.resolve_text_first_nonempty, "skip")
    merged = merged.withColumn("_e", F.col("text") == "")
    keys = ["source", "source_idx", "doc_id"]
    # ids once, whole texts counted, what no example has room for not stored; everything is planned on (keys, n_tokens), examples are
    # built for the rows that stay
    enc = cut_lineage(encode(merged.select(*keys, "_e", "text"), tokenizer, "text", [*keys, "_e"], "_ids", add_special_tokens=False)
                      .select(*keys, "_e", F.size("_ids").cast("long").alias("n_tokens"), SQ.truncate("_ids", seq_length).alias("_ids")))
    plan = cut_lineage(O.interleave(_apply_caps(enc.select(*keys, "_e", "n_tokens"), registry), "doc_id", "source_idx", expected=opened))
    if empty == "drop":  # known before the examples are built, so that positions are counted on the plan
        plan = cut_lineage(O.global_position(plan.filter(~F.col("_e")).withColumnRenamed("pos", "_at"), "_at").drop("_at"))
    n = plan.count()  # rows per epoch: one number
    texts = merged.select("source_idx", "doc_id", "_e")
    ex = plan.drop("_e").join(enc.select("source_idx", "doc_id", "_ids"), ["source_idx", "doc_id"]).join(texts, ["source_idx", "doc_id"])
    ex = SQ.with_fixed_length(ex, "_ids", "_e", seq_length, tokenizer.eos(), tokenizer.pad(), "always", "id", empty).drop("_ids", "_e")
    rep = O.repeat_epochs(SQ.drop_empty(ex), epochs)
    rep = rep.withColumn("pos", F.col("epoch") * F.lit(n) + F.col("pos"))
    batched = O.batch_plan(rep, batch_size, micro_batch_size, world_size)
    return O.rank_split(batched, world_size, "pos")
