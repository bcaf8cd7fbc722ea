"""Registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, decontam, langid, linedup, merkle, neardup, pack, quality, repair, shard, simhash, tokens, warc
from quarry.sources.tables import table_path


def vocabulary(name: str) -> str:
    """Place of a file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


PROBE = "\\### Assistant: </turn> ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat windows of all conversations and of one more, whose texts hold control strings, read back."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)],
                                  "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(turns.unionByName(probe), budget=1024, history=256)
    return chat.read_back(windows)


def pack_whole(docs: DataFrame) -> DataFrame:
    """Documents packed into sequences of 1024 ids; a row per piece."""
    import public_tokenizers

    sequences = pack.pack_documents(docs, vocabulary("byte_bpe_50k.json"), length=1024, end_id=0,
                                    ranks=vocabulary("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    return pack.piece_table(sequences)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids; a row per piece."""
    return pack_whole(_read(spark, sf_dir, "documents"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendezvous shards of all documents; doc_id and the shard count decide."""
    rows = shard.shard_table(_read(spark, sf_dir, "documents"), [1.0] * 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_BITS = "(('0x' || substr(md5(coalesce(cast(doc_id as varchar), chr(0)) || ':' || s), 1, 13))::bigint + 0.5)"
OP3_SQL = f"""
with scored as (select doc_id, cast(s as integer) as s, -ln({_BITS} / 4503599627370496.0) as score
                from documents, range(17) r(s)),
best as (select doc_id, arg_min(s, (score, s)) filter (s < 16) as shard, arg_min(s, (score, s)) as grown_shard
         from scored group by doc_id)
select d.doc_id, cast(strlen(coalesce(text, '')) + 1 as bigint) as size, b.shard, b.grown_shard
from documents d join best b on d.doc_id is not distinct from b.doc_id
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and every record read back through the index. The length and digest of
    a response come from the payload read; those of a revisit from its record."""
    pages = _read(spark, sf_dir, "pages")
    back = warc.read_records(warc.write_archive(pages, min_revisit=1000))
    kind = pages.schema["page_id"].dataType.simpleString()
    read = F.col("payload").isNotNull()
    return back.select(
        F.col("page_id").cast(kind).alias("page_id"),
        F.when(read, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(read, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP4_SQL = """
with p as (select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as keeper from pages)
select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as payload_digest,
       case when strlen(html) >= 1000 and page_id <> keeper then 'revisit' else 'response' end as record_type,
       case when strlen(html) >= 1000 and page_id <> keeper then keeper end as refers_to
from p
"""


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, up to a fifth of its words edited; all documents, all items."""
    return decontam.contaminated(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all whole documents."""
    counts = tokens.count_tokens(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), ["doc_id"])
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def held_out(key: str = "doc_id"):
    """The fold that no language is learned from."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 5 == 0


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all whole documents; learned from at most 4,000 labelled documents outside the held-out fold."""
    docs = _read(spark, sf_dir, "documents")
    fold = F.coalesce(held_out(), F.lit(False))
    model = langid.train(docs.select("doc_id", "text", "lang"), ~fold, sample=4000)
    return langid.identify(docs.withColumn("held_out", fold), model, ["doc_id", "held_out"])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts of all documents by distribution divergence."""
    return quality.quality(_read(spark, sf_dir, "documents"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on two-word shingles, similarity 0.8 or more."""
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), width=2, percent=80)


OP9_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
         else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
  from words),
flat as (select doc_id, unnest(s) as g from sets),
inter as (select a.doc_id as a, b.doc_id as b, count(*) as i from flat a join flat b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from inter join sets x on x.doc_id = a join sets y on y.doc_id = b
          where 100 * i >= 80 * (len(x.s) + len(y.s) - i)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as r from sets union select reach.doc_id, b from reach join both_ways on r = a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, c.r as component_id, s.doc_id = c.r as kept
from sets s join (select doc_id, min(r) as r from reach group by doc_id) c on c.doc_id = s.doc_id
"""


def op10_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the line chunks that an earlier place has; what was removed and what is left."""
    out = linedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    left = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return out.select("doc_id", "removed_chunks", "removed_lines", "removed_words", F.length("text").cast("long").alias("kept_chars"),
                      F.crc32(left).alias("kept_crc32"), (F.col("removed_words") > 0).alias("changed"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents, checked against rows some of which were tampered with."""
    docs = _read(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0, F.lit(False))
    return merkle.manifest(docs, {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string in DuckDB: one byte after the other, eight shifts each."""
    shifts = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)"
    chars = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {chars}), lambda c, b: {shifts}), 4294967295)"


def _leaf(n_chars: str) -> str:
    parts = [f"coalesce(strlen({v}::varchar) || ':' || {v}::varchar, '-')" for v in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(parts)})"


OP11_SQL = f"""
with recursive leaves as materialized (
  select doc_id, lang, dense_rank() over (order by lang nulls first) - 1 as g, {_leaf('n_chars')} as leaf,
         {_leaf(f"case when {_crc32('doc_id::varchar')} % 7 = 0 then n_chars + 1 else n_chars end")} as found
  from documents),
slots as materialized (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as slot from leaves),
nodes as (
  select g, 0 as level, slot, leaf as h, count(*) over (partition by g) as n from slots
  union all
  select g, any_value(level) + 1, slot // 2, sha256(string_agg(h, '' order by slot)), (any_value(n) + 1) // 2
  from nodes where n > 1 group by g, slot // 2),
tops as (
  select 0 as level, g as slot, h, count(*) over () as n from nodes where n = 1
  union all
  select any_value(level) + 1, slot // 2, sha256(string_agg(h, '' order by slot)), (any_value(n) + 1) // 2
  from tops where n > 1 group by slot // 2),
proof as (
  select doc_id, g, slot, slot as at, 0 as level, false as above, leaf, found as node, '' as siblings from slots
  union all
  select p.doc_id, p.g, p.slot, case when last then p.g else p.at // 2 end, case when last then 0 else p.level + 1 end, p.above or last,
         p.leaf, case when last then p.node when p.at % 2 = 1 then sha256(s.h || p.node) else sha256(p.node || coalesce(s.h, '')) end,
         p.siblings || case when last then '' else coalesce(s.h, '') end
  from (select p.*, o.n, o.n = 1 as last from proof p
        join (select false as above, g, level, slot, n from nodes union all select true, null, level, slot, n from tops) o
        on o.above = p.above and (o.above or o.g = p.g) and o.level = p.level and o.slot = p.at
        where not (p.above and o.n = 1)) p
  left join (select false as above, g, level, slot, h from nodes union all select true, null, level, slot, h from tops) s
  on not last and s.above = p.above and (s.above or s.g = p.g) and s.level = p.level and s.slot = xor(p.at, 1::bigint))
select p.doc_id, p.leaf, sub.h as subroot, top.h as root, sha256(p.siblings) as proof_sha256, p.node as folded_root, p.node = top.h as verified
from (select p.* from proof p join tops t on p.above and t.level = p.level and t.slot = p.at and t.n = 1) p
join (select g, h from nodes where n = 1) sub on sub.g = p.g, (select h from tops where n = 1) top
"""


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired at the least cost."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.report(repair.damage(turns), turns)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: three-word shingles, at most three different bits."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


QUERIES = {"op12_repair": op12_repair, "op13_simhash": op13_simhash, "op11_merkle": op11_merkle, "op5_decontam": op5_decontam, "op10_linedup": op10_linedup, "op7_langid": op7_langid, "op8_quality": op8_quality, "op9_neardup": op9_neardup, "op1_chat": op1_chat, "op2_pack": op2_pack, "op3_shards": op3_shards, "op4_warc": op4_warc, "op6_tokens": op6_tokens}
SQL = {"op9_neardup": OP9_SQL, "op4_warc": OP4_SQL, "op11_merkle": OP11_SQL}
