"""The registered queries: one per SURVEY §2 operator group, each over the whole given tables.

Every function takes ``(spark, sf_dir)`` and returns a DataFrame whose column names and integer
types equal those of the matching SQL in ``quarry.plans.oracle``. Floats are rounded in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import records as RC
from quarry.functions import sql as QL
from quarry.functions import text as T
from quarry.operators import allocation as AL
from quarry.operators import dedup as D
from quarry.operators import ordered as O
from quarry.operators import shards as SH
from quarry.functions import sequences as SQ
from quarry.functions.tokenize import TokenizerSpec, encode
from quarry.plans import corpus as CP
from quarry.session import cut_lineage, scratch_path
from quarry.sources import ranks as RK
from quarry.sources import sinks as SK
from quarry.streaming import epochs as EP
from quarry.streaming import stream as ST
from quarry.operators import report as R
from quarry.sources import registry as REG
from quarry.sources.tables import documents_registry, load, source_index, table_path

# Fixed parameters of the registered queries (shared with the oracle SQL).
BUDGET_CAP = 5_000  # whitespace tokens per source
ROW_CAP = 7
WORLD_SIZE = 4
BATCH_SIZE, MICRO_BATCH = 8, 2
STEP_BATCH, STEP_SEQ, STEP_WORLD, WARMUP = 4, 128, 2, 0.05
LOG_INTERVAL, SAVE_INTERVAL, EPOCH_STEPS = 10, 25, 700  # save points need not be log points
EPOCHS = 2


def registry_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """The registry fixture: every source that the documents have, by its number."""
    d = spark.read.parquet(table_path(sf_dir, "documents"))
    found = d.select("source", source_index().alias("i")).distinct().orderBy("i", "source")
    return [r["source"] for r in found.collect()]  # one row per source


def registry_caps(names: list[str], base: int = 4_000, step: int = 1_000) -> dict[str, int]:
    """Whitespace-token cap of each source, by rule."""
    return {n: base + step * (int(n.removeprefix("src")) % 3) for n in names}


def docs_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents + whitespace ``n_tokens`` (the whitespace tokenizer's counts, A1)."""
    d = load(spark, sf_dir, "documents")
    return d.withColumn("n_tokens", T.whitespace_token_count("text"))


# ---------------------------------------------------------------- sources / predicates
def q_registry_scan_filter(spark, sf_dir):
    """Three sources with predicates, unioned by name."""
    reg = documents_registry(sf_dir, registry_names(spark, sf_dir), extra={
        "src0": {"predicate": (F.col("source") == "src0") & (F.col("lang") == "en")},
        "src1": {"predicate": (F.col("source") == "src1") & F.col("lang").isin("de", "fr")},
    })
    df = REG.union_sources(spark, reg, columns=["doc_id", "lang", "text"])
    return df.select(F.col("source"), F.col("source_idx").cast("long"), "doc_id", "lang",
                     F.length("text").cast("long").alias("n_chars"))


def q_nested_field_filter(spark, sf_dir):
    """Nested-field equality with missing -> false (``props.k`` parsed from JSON)."""
    ev = load(spark, sf_dir, "events")
    nested = ev.withColumn("meta", F.from_json("props", "k bigint, category string"))
    return nested.filter(F.coalesce(F.col("meta.k") == 29, F.lit(False))).select("event_id", "user_id", "event_type")


def q_skip_missing_source(spark, sf_dir):
    """S3: a registry row whose path is absent is skipped; the others still run."""
    reg = documents_registry(sf_dir, registry_names(spark, sf_dir)) + [
        REG.SourceSpec(name="src_missing", path=f"{sf_dir}/no_such_table.parquet")]
    df = REG.union_sources(spark, reg, on_error="skip", columns=["doc_id"])
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))


def q_source_readiness(spark, sf_dir):
    """Per-source probe of the first rows + overall summary."""
    reg = [
        REG.SourceSpec(name="documents", path=table_path(sf_dir, "documents")),
        REG.SourceSpec(name="pages", path=table_path(sf_dir, "pages")),
        REG.SourceSpec(name="conversations", path=table_path(sf_dir, "conversations")),
        REG.SourceSpec(name="empty_docs", path=table_path(sf_dir, "documents"), predicate=F.col("doc_id") < 0),
        REG.SourceSpec(name="absent", path=f"{sf_dir}/absent.parquet"),
    ]
    per, _ = REG.source_readiness(spark, reg)
    everything = Window.partitionBy(F.lit(1))  # the per-source table has one row per registry entry
    return per.select(
        "source", "ok", "verified_rows",
        F.sum(F.col("ok").cast("long")).over(everything).alias("successful"),
        F.count(F.lit(1)).over(everything).alias("total"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("source"))).over(everything)), ",").alias("failed"))


def q_source_split_config(spark, sf_dir):
    """One split of a configuration (a sub-folder) of a source; a source whose split is not there is skipped, and
    reported with its error."""
    base = scratch_path(spark, "sources")
    load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("split")).write.parquet(f"{base}/small")
    reg = [REG.SourceSpec(name="german", path=base, config="small", split="de"),
           REG.SourceSpec(name="no_split", path=table_path(sf_dir, "documents"), split="train"),
           REG.SourceSpec(name="no_config", path=base, config="large")]
    rows = REG.union_sources(spark, reg, on_error="skip", columns=["doc_id"]).groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    gone = [(name, err) for name, err in REG.skipped_sources(spark, reg).items()]
    skipped = spark.createDataFrame(gone, "source string, error string").withColumn("docs", F.lit(None).cast("long"))
    return rows.withColumn("error", F.lit(None).cast("string")).unionByName(skipped)


# ---------------------------------------------------------------- text functions
def q_token_counts(spark, sf_dir):
    """A1 F1: whitespace token count per document."""
    return docs_with_counts(spark, sf_dir).select("doc_id", "n_tokens")


def q_distinct_token_set_size(spark, sf_dir):
    """Size of the distinct token set of every document."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(T.distinct_tokens("text")).cast("long").alias("n_distinct"))


def q_strip_nonblank_lines(spark, sf_dir):
    """Lines of every document, stripped, blank ones dropped."""
    d = load(spark, sf_dir, "documents")
    lines = T.strip_nonblank_lines(d, keep=["doc_id"])
    return lines.select("doc_id", F.col("line_no").cast("long"), F.length("line").cast("long").alias("line_chars"),
                        F.md5("line").alias("line_md5"))


def text_shapes(spark, sf_dir):
    """Raw records of several shapes (X1): documents.text, benchmark as ``content``,
    conversations as ``instruction``/``response``, pages without any text field."""
    docs = load(spark, sf_dir, "documents").select(F.lit("documents").alias("shape"), F.col("doc_id").cast("string").alias("rid"), "text")
    bench = load(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("shape"), F.col("item_id").cast("string").alias("rid"),
                                                    F.col("text").alias("content"))
    conv = load(spark, sf_dir, "conversations")
    conv = conv.select(F.lit("conversations").alias("shape"), F.concat_ws(":", "conv_id", "turn").alias("rid"),
                       F.when(F.col("role") == "user", F.col("text")).alias("instruction"),
                       F.when(F.col("role") == "assistant", F.col("text")).alias("response"))
    pages = load(spark, sf_dir, "pages").select(F.lit("pages").alias("shape"), F.col("page_id").cast("string").alias("rid"), "url")
    return [docs, bench, conv, pages]


def q_resolve_text_presence(spark, sf_dir):
    """P5: per shape, ``text`` if present else ``content`` else empty (decided by schema)."""
    parts = [s.select("shape", "rid", T.resolve_text_presence(s)) for s in text_shapes(spark, sf_dir)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.select("shape", "rid", F.length("text").cast("long").alias("text_chars"), F.md5("text").alias("text_md5"))


def q_resolve_text_first_nonempty(spark, sf_dir):
    """First non-empty of text/content/instruction/response/output."""
    parts = [s.select("shape", "rid", T.resolve_text_first_nonempty(s)) for s in text_shapes(spark, sf_dir)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.select("shape", "rid", F.length("text").cast("long").alias("text_chars"), F.md5("text").alias("text_md5"))


def q_variant_field_filter(spark, sf_dir):
    """P2 over records without a schema: a nested field of ``props`` equals a number, every record wrapped one level deeper or in an
    array by turns (a path through an array is missing)."""
    ev = load(spark, sf_dir, "events")
    shape = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"meta": '), F.col("props"), F.lit("}"))) \
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"meta": ['), F.col("props"), F.lit("]}"))).otherwise(F.col("props"))
    ev = ev.withColumn("record", RC.parse_records(shape))
    hit = RC.field_equals("record", "$.meta.k", 29) | RC.field_equals("record", "$.k", 29)
    return ev.filter(hit).select("event_id", "user_id", "event_type")


def q_variant_text_resolution(spark, sf_dir):
    """P5 P6 over the four record shapes as one VARIANT column."""
    parts = [s.select("shape", "rid", F.to_json(F.struct(*[c for c in s.columns if c not in ("shape", "rid")])).alias("json"))
             for s in text_shapes(spark, sf_dir)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    r = RC.parse_records("json")
    df = df.select("shape", "rid", RC.text_by_presence(r).alias("a"), RC.text_first_nonempty(r).alias("b"))
    return df.select("shape", "rid", F.md5("a").alias("presence_md5"), F.length("b").cast("long").alias("text_chars"), F.md5("b").alias("text_md5"))


# ---------------------------------------------------------------- ordered operators
def q_token_budget(spark, sf_dir):
    """Per source, documents by doc_id while the running token total stays <= cap."""
    kept = O.token_budget(docs_with_counts(spark, sf_dir), BUDGET_CAP)
    return kept.select("source", "doc_id", "n_tokens")


def q_registry_token_budget(spark, sf_dir):
    """W1 over the registry fixture with per-source caps (registry order, filters honoured)."""
    reg = documents_registry(sf_dir, registry_names(spark, sf_dir))
    df = REG.union_sources(spark, reg, columns=["doc_id", "text"])
    df = df.withColumn("n_tokens", T.whitespace_token_count("text"))
    kept = O.token_budget(df, registry_caps([s.name for s in reg]))
    return kept.select("source", "doc_id", "n_tokens")


def q_row_cap(spark, sf_dir):
    """L1: first ROW_CAP documents of every source by doc_id."""
    kept = O.row_cap(load(spark, sf_dir, "documents"), ROW_CAP)
    return kept.select("source", "doc_id")


def by_source(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", "source", source_index().alias("source_idx"))


def q_interleave_first_exhausted(spark, sf_dir):
    """W2 (first_exhausted) of the documents of all sources."""
    out = O.interleave(by_source(spark, sf_dir), strategy="first_exhausted")
    return out.select("doc_id", "source", F.col("rn").cast("long"), "pos")


def q_interleave_partial_round(spark, sf_dir):
    """W2 (first_exhausted) that stops right after the first source's last row, as over streams."""
    out = O.interleave(by_source(spark, sf_dir), strategy="first_exhausted", last_round="partial")
    return out.select("doc_id", "source", F.col("rn").cast("long"), "pos")


def q_interleave_all_exhausted(spark, sf_dir):
    """W2 (all_exhausted): short sources wrap around."""
    out = O.interleave(by_source(spark, sf_dir), strategy="all_exhausted")
    return out.select("doc_id", "source", F.col("rn").cast("long"), "pos")


MIX_SEED = 42


def mix_probabilities(names: list[str]) -> dict[int, float]:
    """Probability of each source (by its number), by rule: one to three shares."""
    shares = {int(n.removeprefix("src")): 1 + int(n.removeprefix("src")) % 3 for n in names}
    return {k: v / sum(shares.values()) for k, v in shares.items()}


def _interleave_weighted(spark, sf_dir, strategy):
    p = mix_probabilities(registry_names(spark, sf_dir))
    out = O.interleave_weighted(by_source(spark, sf_dir), p, MIX_SEED, strategy=strategy)
    return out.select("pos", "doc_id", "source", F.col("draw").cast("long"))


def q_interleave_weighted(spark, sf_dir):
    """W2 with probabilities and a seed: sources drawn at random, up to the first one's last row."""
    return _interleave_weighted(spark, sf_dir, "first_exhausted")


def q_interleave_weighted_all(spark, sf_dir):
    """W2 with probabilities and a seed, until every source has given all its rows; short ones begin again."""
    return _interleave_weighted(spark, sf_dir, "all_exhausted")


def q_epochs(spark, sf_dir):
    """The interleaved data repeated EPOCHS times, documents without any word dropped."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "text", source_index().alias("source_idx"))
    inter = O.interleave(d.select("doc_id", "source", "source_idx"))
    ids = d.select("doc_id", SQ.word_length_ids(T.py_split("text")).alias("input_ids"))
    rep = O.repeat_epochs(SQ.drop_empty(inter.join(ids, "doc_id")), EPOCHS)
    return rep.select("epoch", "pos", "doc_id").withColumn("epoch", F.col("epoch").cast("long"))


def q_rank_split(spark, sf_dir):
    """P10: deterministic hash split of documents over WORLD_SIZE ranks."""
    return O.rank_split(load(spark, sf_dir, "documents"), WORLD_SIZE).select(
        "doc_id", F.col("rank").cast("long"))


def q_batch_plan(spark, sf_dir):
    """Global positions in (source_idx, doc_id) order, batch and micro-batch ids."""
    d = load(spark, sf_dir, "documents").select("doc_id", source_index().alias("source_idx"))
    pos = O.ordered_position(d, ["source_idx", "doc_id"])
    return O.batch_plan(pos, BATCH_SIZE, MICRO_BATCH).select("doc_id", "pos", "batch_id", "micro_id")


RANK_BATCH, RANK_MICRO, RANK_SEGMENT = 16, 2, 5


def q_rank_resume(spark, sf_dir):
    """Documents stored for WORLD_SIZE readers; every rank resumes at half of its steps."""
    path = scratch_path(spark, "ranks")
    RK.write_rank_layout(load(spark, sf_dir, "documents").select("doc_id", "source"), path, "doc_id", WORLD_SIZE, RANK_BATCH, RANK_MICRO, RANK_SEGMENT)
    steps, out = RK.resume_steps(spark, path, 0.5), None
    for rank in range(WORLD_SIZE):
        rows = RK.read_rank(spark, path, rank, steps.get(rank, 0))
        out = rows if out is None else out.unionByName(rows)
    return out.select(F.col("rank").cast("long"), "step", "micro", "local_pos", "doc_id", "source")


# ---------------------------------------------------------------- SQL functions
def _views(spark, sf_dir):
    QL.register(spark)
    load(spark, sf_dir, "documents").createOrReplaceTempView("quarry_documents")


def q_sql_token_counts(spark, sf_dir):
    """F1 A1 in SQL."""
    _views(spark, sf_dir)
    return spark.sql("SELECT doc_id, word_count(text) AS n_tokens FROM quarry_documents")


def q_sql_examples(spark, sf_dir):
    """F1 F4-F7 F11 in SQL: a fixed-length example of every document."""
    _views(spark, sf_dir)
    return spark.sql(f"""
        WITH e AS (SELECT doc_id, example_ids(word_ids(first_text(array(text))), {SEQ_LEN}, {EOS_ID}) AS ids FROM quarry_documents)
        SELECT doc_id, array_join(ids, ',') AS input_ids, array_join(id_mask(ids, {EOS_ID}), ',') AS attention_mask FROM e""")


def q_sql_line_chunks(spark, sf_dir):
    """F1 F2 F4 F8 P7 in SQL: the lines of all documents, stripped, as ids, cut into chunks."""
    _views(spark, sf_dir)
    return spark.sql(f"""
        WITH l AS (SELECT doc_id, n AS line_no, strip_text(line) AS line FROM quarry_documents LATERAL VIEW posexplode(split(text, '\n')) AS n, line),
        c AS (SELECT doc_id, line_no, id_chunks(append_eos(word_ids(line), {EOS_ID}, false), {SEQ_LEN}) AS chunks FROM l WHERE line <> '')
        SELECT doc_id, cast(line_no AS BIGINT) AS line_no, cast(k AS BIGINT) AS chunk_idx, array_join(chunk, ',') AS ids
        FROM c LATERAL VIEW posexplode(chunks) AS k, chunk""")


# ---------------------------------------------------------------- reports
def q_mixture_profile(spark, sf_dir):
    """A3 over the token budget's output: per source docs, tokens, cap, share, remaining + total row."""
    kept = O.token_budget(docs_with_counts(spark, sf_dir).select("source", "doc_id", "n_tokens"), BUDGET_CAP)
    return R.mixture_profile(kept, BUDGET_CAP)


ALLOC_SHARES = {"core": 80, "general": 20}
ALLOC_TARGET = 70  # percent of all tokens


def q_mixture_allocation(spark, sf_dir):
    """The target over two parts (80 to 20) and their sources, two of which in seven are short by a cap of their own; the caps feed
    the token budget. The first sources in seven are the core part, too small for its share."""
    d = cut_lineage(docs_with_counts(spark, sf_dir).select("source", "doc_id", "n_tokens"))
    number = source_index().cast("long")
    per = d.groupBy("source").agg(F.sum("n_tokens").alias("available")).select(
        "source", "available", F.when(number % 7 < 3, "core").otherwise("general").alias("part"),
        F.when(number % 7 == 1, F.expr("available div 3")).when(number % 7 == 4, F.expr("available div 10")).alias("declared"),
        (1 + number % 2).alias("weight"))
    per = cut_lineage(per)  # one row per source
    target = (per.agg(F.sum("available")).first()[0] or 0) * ALLOC_TARGET // 100
    caps = cut_lineage(AL.allocate(per, target, ALLOC_SHARES, declared="declared", weight="weight"))
    kept = O.token_budget(d, caps.select("source", "cap")).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    gap = F.lit(target) - F.sum("cap").over(Window.partitionBy(F.lit(1)))
    return caps.withColumn("target_gap", gap).join(kept, "source", "left").select(
        "source", "part", "available", F.col("cap").alias("cap_tokens"), F.coalesce("docs", F.lit(0)).alias("docs"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), "target_gap")


def q_step_plan(spark, sf_dir):
    """A4: steps and warmup for the corpus's whitespace token total."""
    return R.step_plan(docs_with_counts(spark, sf_dir), STEP_BATCH, STEP_SEQ, STEP_WORLD, WARMUP)


def step_log(spark, sf_dir):
    """events as a step log (X10): step = event_id + 1, loss = value / 50, lr decays with the step, an epoch every
    EPOCH_STEPS steps. Every 97th step is missing and every 89th was run twice, so some intervals lack steps or
    their last one."""
    ev = load(spark, sf_dir, "events").filter((F.col("event_id") + 1) % 97 != 0)
    ev = ev.withColumn("_run", F.explode(F.when((F.col("event_id") + 1) % 89 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return ev.select(
        (F.col("event_id") + 1).alias("step"), "ts", (F.col("value") / F.lit(50.0)).alias("loss"),
        (F.lit(3e-4) / (F.lit(1.0) + F.col("event_id") / F.lit(1000.0))).alias("lr"),
        F.floor(F.col("event_id") / EPOCH_STEPS).cast("long").alias("epoch"))


def q_step_rollup(spark, sf_dir):
    """Logged rows every LOG_INTERVAL steps."""
    r = R.step_rollup(step_log(spark, sf_dir), LOG_INTERVAL, STEP_BATCH, STEP_SEQ, STEP_WORLD)
    return r.select("log_step", F.round("train_loss", 6).alias("train_loss"),
                    F.round("train_perplexity", 4).alias("train_perplexity"),
                    F.round(F.col("learning_rate") * 1e6, 4).alias("lr_micro"),
                    F.round("tokens_per_second", 2).alias("tokens_per_second"), "tokens_seen", "epoch")


def q_best_loss_flags(spark, sf_dir):
    """Best-so-far flags at every SAVE_INTERVAL step."""
    log = cut_lineage(step_log(spark, sf_dir))
    r = cut_lineage(R.step_rollup(log, LOG_INTERVAL, STEP_BATCH, STEP_SEQ, STEP_WORLD))
    flags = R.best_loss_flags(r, log, SAVE_INTERVAL)
    return flags.select("save_step", F.round("avg_loss", 6).alias("avg_loss"), "is_best")


# ---------------------------------------------------------------- near-dedup
DEDUP_THRESHOLD, DEDUP_PERM, DEDUP_SEED = 0.9, 128, 1


def q_minhash_signature(spark, sf_dir):
    """The 128-value MinHash signature of every document (digest + minimum)."""
    d = load(spark, sf_dir, "documents")
    sk = D.minhash(d, "text", "doc_id", DEDUP_PERM, DEDUP_THRESHOLD, seed=DEDUP_SEED, with_signature=True)
    return sk.select(F.col("pos").alias("doc_id"),
                     F.md5(F.array_join(F.transform("signature", lambda x: x.cast("string")), ",")).alias("sig_md5"),
                     F.array_min("signature").alias("sig_min"))


def q_lsh_buckets(spark, sf_dir):
    """LSH buckets shared by more than one document: size and first member (no pairs emitted)."""
    d = load(spark, sf_dir, "documents")
    sk = D.minhash(d, "text", "doc_id", DEDUP_PERM, DEDUP_THRESHOLD, seed=DEDUP_SEED)
    b = D.lsh_buckets(sk).groupBy("band", "key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("pos").alias("first_doc"))
    return b.filter(F.col("n_docs") > 1).select(F.col("band").cast("long"), "key", "n_docs", "first_doc")


def q_near_dedup(spark, sf_dir):
    """Documents kept by first-wins MinHash-LSH near-dedup in doc_id order."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    kept = D.near_dedup(d, "doc_id", "text", DEDUP_THRESHOLD, DEDUP_PERM, seed=DEDUP_SEED)
    return kept.select("doc_id", "source")


# ---------------------------------------------------------------- sequences, packing, shards
SEQ_LEN, EOS_ID = 16, 0  # word-length ids are >= 1, so 0 is free for EOS (= pad, as in the reference)
SHARD_SIZE = 1_000  # sequences per count shard
SHARD_TOKENS = 20_000
WORDS = TokenizerSpec(kind="word_length", eos_id=EOS_ID)


def q_fixed_length_ids(spark, sf_dir):
    """Fixed-length examples from every record shape (word-length ids)."""
    out = None
    for shp in text_shapes(spark, sf_dir):
        r = shp.select("shape", "rid", T.resolve_text_first_nonempty(shp))
        r = r.select("shape", "rid", SQ.word_length_ids(T.py_split("text")).alias("_w"), (F.col("text") == "").alias("_e"))
        r = SQ.with_fixed_length(r, "_w", "_e", SEQ_LEN, EOS_ID).select("shape", "rid", "input_ids", "attention_mask")
        out = r if out is None else out.unionByName(r)
    # P9 (drop empty input_ids) cannot remove anything here: empty texts become full-pad rows
    return out.select("shape", "rid", F.array_join("input_ids", ",").alias("input_ids"),
                      F.array_join("attention_mask", ",").alias("attention_mask"))


def doc_lines(spark, sf_dir):
    """Every line of every document, in the order (doc_id, line_no)."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))


def line_sequences(spark, sf_dir):
    """Stripped non-blank lines of every document with word-length ids (+EOS if missing)."""
    lines = T.strip_nonblank_lines(load(spark, sf_dir, "documents"), keep=["doc_id"])
    w = lines.select("doc_id", F.col("line_no").cast("long"), SQ.word_length_ids(T.py_split("line")).alias("_w"))
    return w.select("doc_id", "line_no", SQ.append_eos("_w", EOS_ID, "if_missing").alias("ids"))


def chunk_table(spark, sf_dir, out=None):
    """C3 over the lines of all documents with the word-length tokenizer."""
    c = CP.chunked_sequences(doc_lines(spark, sf_dir), WORDS, SEQ_LEN, SHARD_SIZE, ["doc_id", "line_no"], out)
    return c.withColumnRenamed("input_ids", "chunk")


def q_chunk_ids(spark, sf_dir):
    """F8 + W4: lines cut into SEQ_LEN chunks, with global position and count shard."""
    c = chunk_table(spark, sf_dir)
    return c.select("doc_id", "line_no", "chunk_idx", "pos", "shard", "local_idx",
                    F.array_join("chunk", ",").alias("ids"), F.size("chunk").cast("long").alias("n_ids"))


def q_count_shards(spark, sf_dir):
    """Sequences per count shard."""
    return chunk_table(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("n_sequences"))


def q_shard_metadata(spark, sf_dir):
    """Total sequences, shards, parameters (one row), written by the job and read back from its sink."""
    path = scratch_path(spark, "sequence-job")
    chunk_table(spark, sf_dir, path)
    names = ["total_sequences", "num_shards", "seq_length", "shard_size"]
    return spark.read.schema(", ".join(f"{n} long" for n in names)).json(f"{path}/metadata").select(*names)


def q_sequence_files(spark, sf_dir):
    """S5 P7 F8 W4 S8 S6 (C3 from files): documents written as text files, their lines in order -> ids -> chunks -> count
    shards, read back from the shards."""
    src, path = scratch_path(spark, "ordered-lines"), scratch_path(spark, "sequence-files")
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    d.sort("doc_id").select("text").write.text(src)  # a global sort: files in the order of their names
    CP.create_sequence_shards(spark, [src], path, WORDS, SEQ_LEN, SHARD_SIZE)
    back = SK.read_sequence_shards(spark, f"{path}/shards")
    return back.select((F.col("shard") * SHARD_SIZE + F.col("local_idx")).alias("pos"), F.col("shard").cast("long"), "local_idx",
                       F.array_join("input_ids", ",").alias("ids"))


def q_shard_names(spark, sf_dir):
    """Shard file names with their global index ranges."""
    offs = SH.shard_offsets(chunk_table(spark, sf_dir))
    return offs.select("shard", SH.shard_name("shard").alias("name"), "n", "lo", "hi")


LOOKUP_STRIDE = 997


def q_global_index_points(spark, sf_dir):
    """J3 C7 for few indices: every LOOKUP_STRIDE-th global index; only the shards, and in them the local indices, that hold one are
    read."""
    path = scratch_path(spark, "points")
    chunk_table(spark, sf_dir, path)
    total = CP.sequence_offsets(spark, f"{path}/shards").agg(F.max("hi")).first()[0] or 0
    index = spark.range(0, total, LOOKUP_STRIDE).withColumnRenamed("id", "idx")
    got = CP.read_sequences(spark, f"{path}/shards", index, SEQ_LEN, EOS_ID)
    return got.select("idx", "shard", "local_idx", F.array_join("input_ids", ",").alias("input_ids"))


def q_global_index_lookup(spark, sf_dir):
    """Chunks written as sequence shards; every global index, and some beyond the end -> (shard,
    local index) -> the sequence, truncated and padded; an index beyond the end is a row of padding."""
    path = scratch_path(spark, "lookup")
    chunk_table(spark, sf_dir, path)
    total = CP.sequence_offsets(spark, f"{path}/shards").agg(F.max("hi")).first()[0] or 0
    index = spark.range(total + 10).withColumnRenamed("id", "idx")
    got = CP.read_sequences(spark, f"{path}/shards", index, SEQ_LEN, EOS_ID, missing="pad")
    return got.select("idx", F.col("shard").cast("long"), "local_idx", F.array_join("input_ids", ",").alias("input_ids"))


PACK_LEN = 256  # ids of a pack


def packing_input(spark, sf_dir):
    return O.ordered_position(cut_lineage(line_sequences(spark, sf_dir)), ["doc_id", "line_no"])


def q_pack_lengths(spark, sf_dir):
    """W5 (lengths only): next-fit pack id and offset of every line sequence of the whole stream."""
    s = packing_input(spark, sf_dir).select("pos", F.size("ids").alias("n"))
    return SH.pack_lengths(s, "n", PACK_LEN, "pos").select("pos", "pack", "offset", "n_packs")


def q_pack_ids(spark, sf_dir):
    """Packed fixed-length examples (ids + mask) of the whole stream."""
    packs = SH.pack_sequences(packing_input(spark, sf_dir), "ids", PACK_LEN, EOS_ID, EOS_ID, "pos")
    return packs.select("pack", F.array_join("input_ids", ",").alias("input_ids"),
                        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_real"))


def _token_shards(spark, sf_dir, mode, drop_tail=False):
    d = docs_with_counts(spark, sf_dir).select("doc_id", "n_tokens")
    return SH.token_shards(d, SHARD_TOKENS, "doc_id", mode=mode, drop_tail=drop_tail).select("doc_id", "shard")


def q_token_shards_balanced(spark, sf_dir):
    """W3 balanced: shard = start offset div S, densely numbered."""
    return _token_shards(spark, sf_dir, "balanced")


def q_token_shards_reset(spark, sf_dir):
    """W3 reset: the reference's fold (close at >= S tokens, restart at 0), tail kept."""
    return _token_shards(spark, sf_dir, "reset")


def q_token_shards_drop_tail(spark, sf_dir):
    """W3 reset with the reference's lost tail."""
    return _token_shards(spark, sf_dir, "reset", drop_tail=True)


# ---------------------------------------------------------------- sinks and round trips
def q_text_line_scan(spark, sf_dir):
    """Documents written as text files, scanned line by line, stripped, blanks dropped."""
    path = scratch_path(spark, "text-lines")
    load(spark, sf_dir, "documents").select("text").write.text(path)
    lines = SK.read_text_lines(spark, path).select(T.py_strip("value").alias("line")).filter(F.length("line") > 0)
    return lines.select(F.length("line").cast("long").alias("line_chars"), F.md5("line").alias("line_md5"))


def q_sequence_shard_round_trip(spark, sf_dir):
    """Chunk sequences written as parquet shards and read back."""
    path = scratch_path(spark, "seq-shards")
    SK.write_sequence_shards(chunk_table(spark, sf_dir), path, ids="chunk")
    back = SK.read_sequence_shards(spark, path)
    return back.select(F.col("shard").cast("long"), "local_idx", F.array_join("chunk", ",").alias("ids"))


def q_jsonl_round_trip(spark, sf_dir):
    """Documents in reset token shards written as JSONL shards and read back."""
    d = docs_with_counts(spark, sf_dir).select("doc_id", "text", "n_tokens")
    sharded = SH.token_shards(d, SHARD_TOKENS, "doc_id", mode="reset")
    path = scratch_path(spark, "jsonl-shards")
    SK.write_text_shards(sharded, path, order="doc_id")
    back = SK.read_text_shards(spark, path)
    return back.select("shard_name", F.md5("text").alias("text_md5"))


def q_jsonl_shard_files(spark, sf_dir):
    """Reset token shards, one file a shard, read back with the files' names."""
    d = docs_with_counts(spark, sf_dir).select("doc_id", "text", "n_tokens")
    path = scratch_path(spark, "jsonl-files")
    SK.write_text_shard_files(SH.token_shards(d, SHARD_TOKENS, "doc_id", mode="reset"), path, order="doc_id")
    back = spark.read.schema("text string").json(path).select(F.col("_metadata.file_name").alias("file"), F.md5("text").alias("text_md5"))
    return back


BUILD_SHARD_TOKENS = 2_000


def build_registry(spark, sf_dir, tokens, whole):
    """The registry whose caps are one to three parts in ``whole`` of each source's sum of ``tokens``, so they grow with the table."""
    d = load(spark, sf_dir, "documents").select("source", tokens.alias("n"))
    totals = {r["source"]: r["n"] or 0 for r in d.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # one row per source
    names = registry_names(spark, sf_dir)
    return documents_registry(sf_dir, names, extra={n: {"cap_tokens": totals[n] * (1 + int(n.removeprefix("src")) % 3) // whole} for n in names})


def allocated_registry(spark, sf_dir):
    """The registry whose caps share out ALLOC_TARGET percent of all tokens over two parts."""
    names = registry_names(spark, sf_dir)
    number = {n: int(n.removeprefix("src")) for n in names}
    extra = {n: {"part": "core" if number[n] % 7 < 3 else "general", "weight": 1 + number[n] % 2} for n in names}
    return CP.allocated(spark, documents_registry(sf_dir, names, extra=extra), ALLOC_SHARES, percent=ALLOC_TARGET)


def q_build_text_shards(spark, sf_dir):
    """C2 end to end: registry -> allocation of the target -> budget -> interleave -> near-dedup -> reset token shards -> JSONL."""
    path = scratch_path(spark, "corpus-shards")
    out = CP.build_text_shards(spark, allocated_registry(spark, sf_dir), path, BUILD_SHARD_TOKENS)
    return out.select("pos", "source", "doc_id", "n_tokens", "shard")


# ---------------------------------------------------------------- byte-level BPE (rows-only oracle)
BPE = TokenizerSpec()
BPE_SEQ = 128
TRAIN_CHARS = 12  # a source's cap: one to three BPE tokens for so many of its characters


def q_bpe_token_counts(spark, sf_dir):
    """Byte-level BPE token count of every document."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    enc = encode(d, BPE, "text", ["doc_id"])
    return enc.select("doc_id", F.size("ids").cast("long").alias("n_tokens"))


def q_bpe_fixed_length(spark, sf_dir):
    """C4 with BPE: fixed-length examples of every record shape."""
    out = None
    for shp in text_shapes(spark, sf_dir):
        ex = CP.fixed_length_examples(shp, BPE, BPE_SEQ, ["shape", "rid"])
        out = ex if out is None else out.unionByName(ex)
    return out.select("shape", "rid", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("attention_mask", ",").alias("attention_mask"))


def q_bpe_chunked_sequences(spark, sf_dir):
    """Document lines -> BPE ids + EOS -> 2048-token chunks -> count shards."""
    res = CP.chunked_sequences(doc_lines(spark, sf_dir), BPE, 2048, SHARD_SIZE, ["doc_id", "line_no"])
    return res.select("pos", "shard", "local_idx", F.size("input_ids").cast("long").alias("n_ids"))


def q_training_view(spark, sf_dir):
    """Registry -> BPE examples (ids and mask) -> interleave -> drop empty -> epochs -> batches -> ranks."""
    reg = build_registry(spark, sf_dir, F.length("text").cast("long"), TRAIN_CHARS)
    tv = CP.training_view(spark, reg, BPE, BPE_SEQ, EPOCHS, BATCH_SIZE, MICRO_BATCH, 2)
    return tv.select("epoch", "pos", "doc_id", "source", "batch_id", "micro_id", "rank", F.array_join("input_ids", ",").alias("input_ids"),
                     F.array_join("attention_mask", ",").alias("attention_mask"))


# ---------------------------------------------------------------- streaming (batch twins are the oracles)
STREAM_RANGES = 4


def _doc_stream(spark, sf_dir, cols, drive):
    """Documents delivered in STREAM_RANGES ranges of doc_id to a stream that ``drive(stream, paths)`` runs."""
    p = ST.fresh(spark, "stream")
    d = load(spark, sf_dir, "documents").select(*cols)
    ST.feed(d, p["input"], "doc_id", STREAM_RANGES, lambda: drive(ST.file_stream(spark, p["input"], d.schema), p))
    return p


def q_stream_fixed_length(spark, sf_dir):
    """Documents arriving as files -> fixed-length examples (same functions as batch)."""

    def drive(s, p):
        w = s.select("doc_id", SQ.word_length_ids(T.py_split("text")).alias("_w"), (F.col("text") == "").alias("_e"))
        ex = SQ.with_fixed_length(w, "_w", "_e", SEQ_LEN, EOS_ID).select(
            "doc_id", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("attention_mask", ",").alias("attention_mask"))
        ST.run_to_parquet(ex, p["out"], p["ckpt"])

    return spark.read.parquet(_doc_stream(spark, sf_dir, ["doc_id", "text"], drive)["out"])


def q_stream_bpe_fixed_length(spark, sf_dir):
    """BPE fixed-length examples on a stream (the batch mapInArrow function, append mode)."""

    def drive(s, p):
        ex = CP.fixed_length_examples(s, BPE, BPE_SEQ, ["doc_id"])
        out = ex.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("attention_mask", ",").alias("attention_mask"))
        ST.run_to_parquet(out, p["out"], p["ckpt"])

    return spark.read.parquet(_doc_stream(spark, sf_dir, ["doc_id", "text"], drive)["out"])


def _budget_stream(spark, sf_dir, cap):
    def drive(s, p):
        counted = s.select("source", "doc_id", T.whitespace_token_count("text").alias("n_tokens"))
        ST.stream_token_budget(counted, cap, p["out"], p["state"], p["ckpt"])

    p = _doc_stream(spark, sf_dir, ["doc_id", "source", "text"], drive)
    return spark.read.parquet(p["out"]).select("source", "doc_id", "n_tokens")


def q_stream_token_budget(spark, sf_dir):
    """T4: per-source token budget with state across micro-batches, one cap for all sources."""
    return _budget_stream(spark, sf_dir, BUDGET_CAP)


def q_stream_token_budget_batches(spark, sf_dir):
    """T4 with a cap for each source."""
    return _budget_stream(spark, sf_dir, registry_caps(registry_names(spark, sf_dir)))


def q_stream_near_dedup(spark, sf_dir):
    """First-wins near-dedup across micro-batches (kept-band table per batch)."""

    def drive(s, p):
        ST.stream_near_dedup(s, p["out"], p["state"], p["ckpt"], "doc_id", "text", DEDUP_THRESHOLD, DEDUP_PERM, DEDUP_SEED, compact_every=2)

    p = _doc_stream(spark, sf_dir, ["doc_id", "source", "text"], drive)
    return spark.read.parquet(p["out"]).select("doc_id", "source")


def q_stream_step_rollup(spark, sf_dir):
    """T5: step-log rollup on a stream of step records."""
    p = ST.fresh(spark, "stream-steps")
    log = cut_lineage(step_log(spark, sf_dir))
    ST.feed(log, p["input"], "step", STREAM_RANGES,
            lambda: ST.stream_step_rollup(ST.file_stream(spark, p["input"], log.schema), LOG_INTERVAL, p["out"], p["ckpt"]))
    r = ST.read_rollup(spark, p["out"], LOG_INTERVAL, LOG_INTERVAL * STEP_BATCH * STEP_SEQ * STEP_WORLD)
    return r.select("log_step", F.round("train_loss", 6).alias("train_loss"),
                    F.round("train_perplexity", 4).alias("train_perplexity"),
                    F.round(F.col("learning_rate") * 1e6, 4).alias("lr_micro"),
                    F.round("tokens_per_second", 2).alias("tokens_per_second"), "tokens_seen", "epoch")


WINDOW_HOURS, LATE_HOURS = 6, 30


def late_batch(n):
    """The batch in which an event arrives: STREAM_RANGES even ranges of event_id, but every 50th event one batch late and every
    97th two."""
    late = F.when(F.col("event_id") % 97 == 0, 2).when(F.col("event_id") % 50 == 0, 1).otherwise(0)
    return F.floor(F.col("event_id") * STREAM_RANGES / F.lit(n)).cast("int") + late


def q_stream_event_windows(spark, sf_dir):
    """T5 as a stateful streaming aggregation: windows of event time behind a watermark, late events dropped, each batch a restart
    from the checkpoint."""
    p = ST.fresh(spark, "event-windows")
    ev = load(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    n = (ev.agg(F.max("event_id")).first()[0] or 0) + 1

    def drive():
        s = ST.file_stream(spark, p["input"], ev.schema)
        ST.stream_event_windows(s, f"{WINDOW_HOURS} hours", f"{LATE_HOURS} hours", p["out"], p["ckpt"], ["event_type"])

    ST.feed_batches(ev.withColumn("_b", late_batch(n)), p["input"], "_b", STREAM_RANGES + 2, drive)
    out = spark.read.parquet(p["out"])
    us = lambda a, b: F.unix_micros(a).alias(b)
    return out.select(us("window_start", "window_us"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"), "max_value",
                      us("first_ts", "first_us"), us("last_ts", "last_us"))


SEGMENTS, SEGMENTS_A_BATCH = 8, 5


def q_stream_epochs(spark, sf_dir):
    """Documents as an endless stream in (source_idx, doc_id) order, taken until EPOCHS epochs are through. A batch is
    SEGMENTS_A_BATCH segments, so batches end inside epochs and go over their ends; each is a restart from the checkpoint."""
    p = ST.fresh(spark, "epochs")
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", source_index().alias("source_idx"))
    EP.write_segments(docs, p["input"], ["source_idx", "doc_id"], max(1, -(-docs.count() // SEGMENTS)))
    batches = -(-EPOCHS * EP.n_segments(spark, p["input"]) // SEGMENTS_A_BATCH)
    each = lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{p['out']}/batch_id={batch_id}")
    EP.stream_epochs(spark, p["input"], each, p["ckpt"], SEGMENTS_A_BATCH, batches)
    taken = spark.read.schema("epoch long, pos long, doc_id long, source string, batch_id long").parquet(p["out"])
    return taken.filter(F.col("epoch") < EPOCHS)


TRAIN_WORLD = 2


def q_training_view_words(spark, sf_dir):
    """C6 with SQL-reproducible ids: registry (allocated caps) -> examples -> interleave -> epochs -> batches -> ranks."""
    reg = allocated_registry(spark, sf_dir)
    tv = CP.training_view(spark, reg, WORDS, SEQ_LEN, EPOCHS, BATCH_SIZE, MICRO_BATCH, TRAIN_WORLD)
    return tv.select(F.col("epoch").cast("long"), "pos", "doc_id", "source", "batch_id", "micro_id",
                     F.col("rank").cast("long"), F.array_join("input_ids", ",").alias("input_ids"))


def flagship(spark, sf_dir):
    """Documents -> whitespace tokens -> per-source budget -> mixture profile."""
    d = docs_with_counts(spark, sf_dir).select("source", "doc_id", "n_tokens")
    kept = O.token_budget(d, BUDGET_CAP)
    return R.mixture_profile(kept)


QUERIES = {
    "registry_scan_filter": q_registry_scan_filter,
    "nested_field_filter": q_nested_field_filter,
    "variant_field_filter": q_variant_field_filter,
    "variant_text_resolution": q_variant_text_resolution,
    "skip_missing_source": q_skip_missing_source,
    "source_readiness": q_source_readiness,
    "source_split_config": q_source_split_config,
    "token_counts": q_token_counts,
    "distinct_token_set_size": q_distinct_token_set_size,
    "strip_nonblank_lines": q_strip_nonblank_lines,
    "resolve_text_presence": q_resolve_text_presence,
    "resolve_text_first_nonempty": q_resolve_text_first_nonempty,
    "token_budget": q_token_budget,
    "registry_token_budget": q_registry_token_budget,
    "row_cap": q_row_cap,
    "interleave_first_exhausted": q_interleave_first_exhausted,
    "interleave_partial_round": q_interleave_partial_round,
    "interleave_all_exhausted": q_interleave_all_exhausted,
    "interleave_weighted": q_interleave_weighted,
    "interleave_weighted_all": q_interleave_weighted_all,
    "epochs": q_epochs,
    "rank_split": q_rank_split,
    "batch_plan": q_batch_plan,
    "rank_resume": q_rank_resume,
    "sql_token_counts": q_sql_token_counts,
    "sql_examples": q_sql_examples,
    "sql_line_chunks": q_sql_line_chunks,
    "mixture_profile": q_mixture_profile,
    "mixture_allocation": q_mixture_allocation,
    "step_plan": q_step_plan,
    "step_rollup": q_step_rollup,
    "best_loss_flags": q_best_loss_flags,
    "minhash_signature": q_minhash_signature,
    "lsh_buckets": q_lsh_buckets,
    "near_dedup": q_near_dedup,
    "fixed_length_ids": q_fixed_length_ids,
    "chunk_ids": q_chunk_ids,
    "count_shards": q_count_shards,
    "shard_metadata": q_shard_metadata,
    "sequence_files": q_sequence_files,
    "shard_names": q_shard_names,
    "global_index_lookup": q_global_index_lookup,
    "global_index_points": q_global_index_points,
    "pack_lengths": q_pack_lengths,
    "pack_ids": q_pack_ids,
    "token_shards_balanced": q_token_shards_balanced,
    "token_shards_reset": q_token_shards_reset,
    "token_shards_drop_tail": q_token_shards_drop_tail,
    "text_line_scan": q_text_line_scan,
    "sequence_shard_round_trip": q_sequence_shard_round_trip,
    "jsonl_round_trip": q_jsonl_round_trip,
    "jsonl_shard_files": q_jsonl_shard_files,
    "build_text_shards": q_build_text_shards,
    "bpe_token_counts": q_bpe_token_counts,
    "bpe_fixed_length": q_bpe_fixed_length,
    "bpe_chunked_sequences": q_bpe_chunked_sequences,
    "training_view": q_training_view,
    "training_view_words": q_training_view_words,
    "stream_fixed_length": q_stream_fixed_length,
    "stream_bpe_fixed_length": q_stream_bpe_fixed_length,
    "stream_token_budget": q_stream_token_budget,
    "stream_token_budget_batches": q_stream_token_budget_batches,
    "stream_near_dedup": q_stream_near_dedup,
    "stream_step_rollup": q_stream_step_rollup,
    "stream_event_windows": q_stream_event_windows,
    "stream_epochs": q_stream_epochs,
    "flagship_mixture": flagship,
}
