"""DuckDB SQL twins of the registered queries (same column names, integer types and rounding).

They are written independently of the Spark code paths: plain windows, recursive CTEs and
``lambda`` list functions, the way one would state each operator's meaning in SQL. Tables are the
pre-registered views named after the parquet files.
"""

from __future__ import annotations

from quarry.functions.text import WS_CLASS
from quarry.plans import catalog as C

WS = WS_CLASS + "+"


def ntok(text: str) -> str:
    """Whitespace token count, Python ``len(str.split())``."""
    return f"len(list_filter(regexp_split_to_array({text}, '{WS}'), lambda x: x <> ''))::BIGINT"


def tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}'), lambda x: x <> '')"


def src_idx(col: str = "source") -> str:
    return f"CAST(regexp_extract({col}, '(\\d+)$', 1) AS INTEGER)"


SQL: dict[str, str] = {}

SQL["registry_scan_filter"] = f"""
SELECT source, {src_idx()}::BIGINT AS source_idx, doc_id, lang, length(text)::BIGINT AS n_chars
FROM documents
WHERE (source = 'src0' AND lang = 'en') OR (source = 'src1' AND lang IN ('de', 'fr')) OR {src_idx()} >= 2
"""

SQL["nested_field_filter"] = """
SELECT event_id, user_id, event_type FROM events
WHERE coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) = 29, false)
"""

SQL["variant_field_filter"] = """
SELECT event_id, user_id, event_type FROM events
WHERE event_id % 3 <> 1 AND json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
  AND CAST(json_extract_string(props, '$.k') AS DOUBLE) = 29
"""

SQL["skip_missing_source"] = f"""
SELECT source, count(*)::BIGINT AS docs FROM documents GROUP BY source
"""

SQL["source_readiness"] = """
WITH per AS (
  SELECT 'documents' AS source, count(*) > 0 AS ok, count(*)::BIGINT AS verified_rows FROM (SELECT 1 FROM documents LIMIT 100)
  UNION ALL SELECT 'pages', count(*) > 0, count(*)::BIGINT FROM (SELECT 1 FROM pages LIMIT 100)
  UNION ALL SELECT 'conversations', count(*) > 0, count(*)::BIGINT FROM (SELECT 1 FROM conversations LIMIT 100)
  UNION ALL SELECT 'empty_docs', count(*) > 0, count(*)::BIGINT FROM (SELECT 1 FROM documents WHERE doc_id < 0 LIMIT 100)
  UNION ALL SELECT 'absent', false, 0::BIGINT
)
SELECT source, ok, verified_rows,
       (sum(ok::BIGINT) OVER ())::BIGINT AS successful,
       count(*) OVER ()::BIGINT AS total,
       (SELECT string_agg(source, ',' ORDER BY source) FROM per WHERE NOT ok) AS failed
FROM per
"""

SQL["source_split_config"] = """
SELECT 'german' AS source, count(*)::BIGINT AS docs, NULL::VARCHAR AS error FROM documents WHERE lang = 'de'
UNION ALL SELECT 'no_split', NULL, 'ValueError' UNION ALL SELECT 'no_config', NULL, 'PATH_NOT_FOUND'
"""

SQL["token_counts"] = f"SELECT doc_id, {ntok('text')} AS n_tokens FROM documents"

SQL["distinct_token_set_size"] = f"SELECT doc_id, len(list_distinct({tokens('text')}))::BIGINT AS n_distinct FROM documents"

SQL["strip_nonblank_lines"] = f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents),
u AS (SELECT doc_id, unnest(range(len(arr))) AS line_no, unnest(arr) AS line FROM l),
s AS (SELECT doc_id, line_no, regexp_replace(line, '^{WS}|{WS}$', '', 'g') AS line FROM u)
SELECT doc_id, line_no::BIGINT AS line_no, length(line)::BIGINT AS line_chars, md5(line) AS line_md5
FROM s WHERE length(line) > 0
"""

_SHAPES = """
WITH shapes AS (
  SELECT 'documents' AS shape, CAST(doc_id AS VARCHAR) AS rid, text, NULL::VARCHAR AS content, NULL::VARCHAR AS instruction, NULL::VARCHAR AS response FROM documents
  UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), NULL, text, NULL, NULL FROM benchmark
  UNION ALL SELECT 'conversations', conv_id || ':' || turn, NULL, NULL,
                   CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'assistant' THEN text END FROM conversations
  UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), NULL, NULL, NULL, NULL FROM pages
)"""

SQL["resolve_text_presence"] = _SHAPES + """,
r AS (SELECT shape, rid, CASE shape WHEN 'documents' THEN coalesce(text, '') WHEN 'benchmark' THEN coalesce(content, '') ELSE '' END AS t
      FROM shapes)
SELECT shape, rid, length(t)::BIGINT AS text_chars, md5(t) AS text_md5 FROM r
"""

SQL["resolve_text_first_nonempty"] = _SHAPES + """,
r AS (SELECT shape, rid, coalesce(CASE WHEN text <> '' THEN text END, CASE WHEN content <> '' THEN content END,
                                  CASE WHEN instruction <> '' THEN instruction END, CASE WHEN response <> '' THEN response END, '') AS t
      FROM shapes)
SELECT shape, rid, length(t)::BIGINT AS text_chars, md5(t) AS text_md5 FROM r
"""

SQL["variant_text_resolution"] = f"""
SELECT shape, rid, p.text_md5 AS presence_md5, f.text_chars, f.text_md5
FROM ({SQL["resolve_text_presence"]}) p JOIN ({SQL["resolve_text_first_nonempty"]}) f USING (shape, rid)
"""

SQL["token_budget"] = f"""
WITH d AS (SELECT source, doc_id, {ntok('text')} AS n_tokens FROM documents),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM d)
SELECT source, doc_id, n_tokens FROM c WHERE cum <= {C.BUDGET_CAP}
"""

_CAP = f"(4000 + 1000 * ({src_idx()} % 3))"
SQL["registry_token_budget"] = f"""
WITH d AS (SELECT source, doc_id, {ntok('text')} AS n_tokens FROM documents),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM d)
SELECT source, doc_id, n_tokens FROM c WHERE cum <= {_CAP}
"""

SQL["row_cap"] = f"""
SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
WHERE rn <= {C.ROW_CAP}
"""

_INTERLEAVE_BASE = f"""
WITH d AS (SELECT doc_id, source, {src_idx()} AS source_idx FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source_idx ORDER BY doc_id) AS r FROM d),
c AS (SELECT source_idx, count(*) AS cnt, row_number() OVER (ORDER BY source_idx) - 1 AS srank FROM d GROUP BY source_idx),
s AS (SELECT count(*) AS nsrc, min(cnt) AS minc, max(cnt) AS maxc FROM c)"""

SQL["interleave_first_exhausted"] = _INTERLEAVE_BASE + """
SELECT r.doc_id, r.source, r.r::BIGINT AS rn, ((r.r - 1) * s.nsrc + c.srank)::BIGINT AS pos
FROM r JOIN c USING (source_idx), s WHERE r.r <= s.minc
"""

SQL["interleave_partial_round"] = _INTERLEAVE_BASE + """,
z AS (SELECT min(c.srank) AS stop FROM c, s WHERE c.cnt = s.minc)
SELECT r.doc_id, r.source, r.r::BIGINT AS rn, ((r.r - 1) * s.nsrc + c.srank)::BIGINT AS pos
FROM r JOIN c USING (source_idx), s, z WHERE r.r < s.minc OR (r.r = s.minc AND c.srank <= z.stop)
"""

SQL["interleave_all_exhausted"] = _INTERLEAVE_BASE + """,
e AS (SELECT r.doc_id, r.source, unnest(range(r.r, s.maxc + 1, c.cnt)) AS rn, c.srank, s.nsrc FROM r JOIN c USING (source_idx), s)
SELECT doc_id, source, rn::BIGINT AS rn, ((rn - 1) * nsrc + srank)::BIGINT AS pos FROM e
"""

# the draw of a position: the first 32 bits of md5("seed:position") against the cumulative probabilities, as 32-bit thresholds in the
# order of the sources
_WEIGHTED = f"""
WITH d AS (SELECT doc_id, source, {src_idx()} AS source_idx FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source_idx ORDER BY doc_id) AS r FROM d),
c AS (SELECT source_idx, count(*) AS cnt, 1 + source_idx % 3 AS w FROM d GROUP BY source_idx),
t AS (SELECT source_idx, cnt, round(sum(w) OVER (ORDER BY source_idx) / sum(w) OVER () * 4294967296.0::DOUBLE)::BIGINT AS upto FROM c),
u AS (SELECT p, ('0x' || substr(md5('{C.MIX_SEED}:' || p), 1, 8))::BIGINT AS x FROM (SELECT unnest(range((SELECT 60 * count(*) + 1000 FROM d))) AS p)),
g AS (SELECT u.p, t.source_idx, t.cnt FROM u ASOF JOIN t ON u.x < t.upto),
n AS (SELECT *, row_number() OVER (PARTITION BY source_idx ORDER BY p) AS draw FROM g),
dry AS (SELECT source_idx, min(p) AS p FROM n WHERE draw = cnt GROUP BY source_idx),
stop AS (SELECT @STOP@(p) AS p FROM dry)
SELECT n.p::BIGINT AS pos, r.doc_id, r.source, n.draw::BIGINT AS draw
FROM n JOIN stop ON n.p <= stop.p JOIN r ON r.source_idx = n.source_idx AND r.r = (n.draw - 1) % n.cnt + 1
"""
SQL["interleave_weighted"] = _WEIGHTED.replace("@STOP@", "min")
SQL["interleave_weighted_all"] = _WEIGHTED.replace("@STOP@", "max")

SQL["epochs"] = f"""
WITH d AS (SELECT doc_id, source, text, {src_idx()} AS source_idx FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source_idx ORDER BY doc_id) AS r FROM d),
c AS (SELECT source_idx, count(*) AS cnt, row_number() OVER (ORDER BY source_idx) - 1 AS srank FROM d GROUP BY source_idx),
s AS (SELECT count(*) AS nsrc, min(cnt) AS minc FROM c),
i AS (SELECT r.doc_id, r.text, ((r.r - 1) * s.nsrc + c.srank)::BIGINT AS pos FROM r JOIN c USING (source_idx), s WHERE r.r <= s.minc)
SELECT e.epoch::BIGINT AS epoch, i.pos, i.doc_id FROM i, (SELECT unnest(range({C.EPOCHS})) AS epoch) e
WHERE len({tokens('i.text')}) > 0
"""

SQL["rank_split"] = f"""
SELECT doc_id, (('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % {C.WORLD_SIZE})::BIGINT AS rank FROM documents
"""

_OWN = C.RANK_BATCH // C.WORLD_SIZE
SQL["rank_resume"] = f"""
WITH r AS ({SQL["rank_split"]}),
p AS (SELECT rank, doc_id, (row_number() OVER (PARTITION BY rank ORDER BY doc_id) - 1)::BIGINT AS local_pos FROM r),
s AS (SELECT *, (local_pos // {_OWN})::BIGINT AS step, ((local_pos % {_OWN}) // {C.RANK_MICRO})::BIGINT AS micro FROM p)
SELECT rank, step, micro, local_pos, doc_id, source FROM s JOIN documents USING (doc_id)
QUALIFY step >= max(step) OVER (PARTITION BY rank) // 2
"""

SQL["batch_plan"] = f"""
WITH p AS (SELECT doc_id, (row_number() OVER (ORDER BY {src_idx()}, doc_id) - 1)::BIGINT AS pos FROM documents)
SELECT doc_id, pos, (pos // {C.BATCH_SIZE})::BIGINT AS batch_id, ((pos % {C.BATCH_SIZE}) // {C.MICRO_BATCH})::BIGINT AS micro_id FROM p
"""

_MIX = f"""
WITH d AS (SELECT source, doc_id, {ntok('text')} AS n_tokens FROM documents @WHERE@),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM d),
k AS (SELECT * FROM c WHERE cum <= {C.BUDGET_CAP}),
per AS (SELECT source, count(*) AS docs, sum(n_tokens) AS tokens, @CAP@::BIGINT AS cap_tokens FROM k GROUP BY source),
ro AS (SELECT source, sum(docs)::BIGINT AS docs, sum(tokens)::BIGINT AS tokens, sum(cap_tokens)::BIGINT AS cap_tokens
       FROM per GROUP BY ROLLUP (source))
SELECT coalesce(source, '__all__') AS source, docs, tokens, cap_tokens,
       round(tokens / sum(CASE WHEN source IS NOT NULL THEN tokens END) OVER (), 6) AS share,
       (cap_tokens - tokens)::BIGINT AS remaining
FROM ro
"""

SQL["mixture_profile"] = _MIX.replace("@WHERE@", "").replace("@CAP@", str(C.BUDGET_CAP))
SQL["flagship_mixture"] = _MIX.replace("@WHERE@", "").replace("@CAP@", "NULL")



def _fill(rows: str, by: str, name: str) -> str:
    """Water-filling of (by, name, w, lim, quota): a row is full if its group can be filled up to that row's level, seen from every row."""
    return f"""(
WITH r AS (SELECT *, lim::HUGEINT AS l, w::HUGEINT AS v FROM {rows}),
f AS (SELECT a.{by} AS g, a.{name} AS n, any_value(a.quota) * any_value(a.v) >= sum(least(b.l * a.v, b.v * a.l)) AS is_full
      FROM r a JOIN r b ON a.{by} = b.{by} GROUP BY ALL),
h AS (SELECT r.*, is_full, sum(l) FILTER (is_full) OVER (PARTITION BY {by}) AS taken, sum(v) FILTER (NOT is_full) OVER (PARTITION BY {by}) AS open
      FROM r JOIN f ON f.g = r.{by} AND f.n = r.{name}),
p AS (SELECT *, CASE WHEN is_full THEN l ELSE (v * (quota - coalesce(taken, 0))) // open END AS part FROM h),
o AS (SELECT *, least(quota, sum(l) OVER (PARTITION BY {by})) - sum(part) OVER (PARTITION BY {by}) AS rest,
             sum((part < l)::INT) OVER (PARTITION BY {by} ORDER BY {name}) AS turn FROM p)
SELECT * EXCLUDE (l, v, is_full, taken, open, part, rest, turn), (part + (part < l AND turn <= rest)::INT)::BIGINT AS got FROM o)"""


SQL["mixture_allocation"] = f"""
WITH d AS (SELECT source, doc_id, {ntok('text')} AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS available, {src_idx()} % 7 AS i, 1 + {src_idx()} % 2 AS w FROM d GROUP BY source),
s2 AS (SELECT source, available, CASE WHEN i < 3 THEN 'core' ELSE 'general' END AS part_name, w,
              CASE i WHEN 1 THEN available // 3 WHEN 4 THEN available // 10 ELSE available END AS lim FROM s),
t AS (SELECT (sum(available) * {C.ALLOC_TARGET} // 100)::BIGINT AS target FROM s),
parts AS (SELECT 1 AS g0, part_name, sum(lim) AS lim, CASE part_name WHEN 'core' THEN {C.ALLOC_SHARES['core']} ELSE {C.ALLOC_SHARES['general']} END AS w,
                 (SELECT target FROM t) AS quota FROM s2 GROUP BY part_name),
q AS (SELECT part_name, got FROM {_fill('parts', 'g0', 'part_name')}),
src AS (SELECT s2.*, q.got AS quota FROM s2 JOIN q USING (part_name)),
c AS (SELECT source, part_name, available, got FROM {_fill('src', 'part_name', 'source')}),
k AS (SELECT d.source, n_tokens, sum(n_tokens) OVER (PARTITION BY d.source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM d),
kept AS (SELECT k.source, count(*) AS docs, sum(n_tokens) AS tokens FROM k JOIN c USING (source) WHERE cum <= got GROUP BY k.source)
SELECT c.source, part_name AS part, available, got AS cap_tokens, coalesce(docs, 0)::BIGINT AS docs, coalesce(tokens, 0)::BIGINT AS tokens,
       ((SELECT target FROM t) - sum(got) OVER ())::BIGINT AS target_gap
FROM c LEFT JOIN kept USING (source)
"""

_TPS_REF = C.STEP_BATCH * C.STEP_SEQ * C.STEP_WORLD
_TPS_GLOB = C.STEP_BATCH * C.STEP_SEQ
SQL["step_plan"] = f"""
WITH t AS (SELECT sum({ntok('text')})::BIGINT AS total_tokens FROM documents),
s AS (SELECT total_tokens, {_TPS_REF}::BIGINT AS tokens_per_step_reference, (total_tokens // {_TPS_REF})::BIGINT AS steps_reference,
             {_TPS_GLOB}::BIGINT AS tokens_per_step_global, (total_tokens // {_TPS_GLOB})::BIGINT AS steps_global FROM t)
SELECT *, floor(steps_reference * {C.WARMUP}::DOUBLE)::BIGINT AS warmup_reference,
          floor(steps_global * {C.WARMUP}::DOUBLE)::BIGINT AS warmup_global FROM s
"""

_TOK_IV = C.LOG_INTERVAL * C.STEP_BATCH * C.STEP_SEQ * C.STEP_WORLD
# the log step of every run: the first multiple of the interval at or after it that was run
_ROLLUP = f"""
WITH lg AS (SELECT event_id + 1 AS step, ts, value / 50.0::DOUBLE AS loss,
                   3e-4::DOUBLE / (1.0::DOUBLE + event_id::DOUBLE / 1000.0::DOUBLE) AS lr, event_id // {C.EPOCH_STEPS} AS epoch
            FROM (SELECT *, unnest(range(CASE WHEN (event_id + 1) % 89 = 0 THEN 2 ELSE 1 END)) AS run FROM events)
            WHERE (event_id + 1) % 97 <> 0),
lines AS (SELECT DISTINCT step AS log_step FROM lg WHERE step % {C.LOG_INTERVAL} = 0),
a AS (SELECT lg.*, lines.log_step FROM lg ASOF JOIN lines ON lg.step <= lines.log_step),
per AS (SELECT log_step, avg(loss) AS train_loss, arg_max(lr, step) AS learning_rate, min(ts) AS t0, max(ts) AS t1, max(epoch) AS epoch
        FROM a GROUP BY 1),
j AS (SELECT *, epoch_us(t1) - epoch_us(coalesce(lag(t1) OVER (ORDER BY log_step), t0)) AS el FROM per),
roll AS (SELECT log_step::BIGINT AS log_step, train_loss, exp(train_loss) AS train_perplexity, learning_rate,
                CASE WHEN el > 0 THEN {float(_TOK_IV)}::DOUBLE / (el / 1e6::DOUBLE) END AS tokens_per_second,
                (log_step * {_TOK_IV // C.LOG_INTERVAL})::BIGINT AS tokens_seen, epoch::BIGINT AS epoch FROM j)"""

SQL["step_rollup"] = _ROLLUP + """
SELECT log_step, round(train_loss, 6) AS train_loss, round(train_perplexity, 4) AS train_perplexity,
       round(learning_rate * 1e6, 4) AS lr_micro, round(tokens_per_second, 2) AS tokens_per_second, tokens_seen, epoch FROM roll
"""

SQL["best_loss_flags"] = _ROLLUP + f""",
sv AS (SELECT DISTINCT step AS save_step FROM lg WHERE step % {C.SAVE_INTERVAL} = 0),
sl AS (SELECT sv.save_step, roll.train_loss FROM sv ASOF JOIN roll ON sv.save_step >= roll.log_step),
sb AS (SELECT *, min(train_loss) OVER (ORDER BY save_step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM sl)
SELECT save_step::BIGINT AS save_step, round(train_loss, 6) AS avg_loss, (best IS NULL OR train_loss < best) AS is_best FROM sb
"""


# ---------------------------------------------------------------- near-dedup
def _sketch_ctes(rel: str) -> str:
    """MinHash + band keys over ``rel(pos, text)`` as CTE definitions (no leading WITH)."""
    from quarry.operators.dedup import EMPTY_VALUE, PRIME, optimal_bands, perm_params

    a, b = perm_params(C.DEDUP_PERM, C.DEDUP_SEED)
    nb, r = optimal_bands(C.DEDUP_THRESHOLD, C.DEDUP_PERM)
    perms = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(zip(a, b)))
    return f"""perms AS (SELECT * FROM (VALUES {perms}) t(i, a, b)),
toks AS (SELECT pos, unnest(list_distinct({tokens('text')})) AS tok FROM {rel}),
h0 AS (SELECT pos, (('0x' || substr(md5(tok), 1, 8))::BIGINT) % {PRIME} AS h FROM toks),
sig0 AS (SELECT h0.pos, perms.i, min((perms.a * h0.h + perms.b) % {PRIME}) AS v FROM h0, perms GROUP BY 1, 2),
sig AS (SELECT d.pos, p.i, coalesce(s.v, {EMPTY_VALUE})::BIGINT AS v
        FROM (SELECT pos FROM {rel}) d CROSS JOIN perms p LEFT JOIN sig0 s ON s.pos = d.pos AND s.i = p.i),
bands AS (SELECT pos, (i // {r})::INTEGER AS band,
                 md5(((i // {r})::VARCHAR) || ':' || string_agg(v::VARCHAR, ',' ORDER BY i)) AS key
          FROM sig WHERE i < {nb * r} GROUP BY pos, i // {r})"""


def _sketch_sql() -> str:
    return "\nWITH docs_pos AS (SELECT doc_id AS pos, text FROM documents),\n" + _sketch_ctes("docs_pos")


SQL["minhash_signature"] = _sketch_sql() + """
SELECT pos AS doc_id, md5(string_agg(v::VARCHAR, ',' ORDER BY i)) AS sig_md5, min(v)::BIGINT AS sig_min FROM sig GROUP BY pos
"""

SQL["lsh_buckets"] = _sketch_sql() + """
SELECT band::BIGINT AS band, key, count(*)::BIGINT AS n_docs, min(pos)::BIGINT AS first_doc
FROM bands GROUP BY band, key HAVING count(*) > 1
"""


def _first_wins(rel: str) -> str:
    """The rule itself: walk the documents of ``rel`` in order and keep one iff no document kept before shares a band."""
    return f"""
g AS MATERIALIZED (SELECT pos, list(band || ':' || key) AS ks, row_number() OVER (ORDER BY pos) AS rn FROM bands GROUP BY pos),
walk(rn, pos, kept, seen) AS (
  SELECT 0::BIGINT, NULL::BIGINT, false, []::VARCHAR[]
  UNION ALL
  SELECT g.rn, g.pos, NOT list_has_any(walk.seen, g.ks), CASE WHEN list_has_any(walk.seen, g.ks) THEN walk.seen ELSE walk.seen || g.ks END
  FROM walk JOIN g ON g.rn = walk.rn + 1
),
kept_pos AS (SELECT pos FROM walk WHERE kept)"""


SQL["near_dedup"] = _sketch_sql().replace("WITH docs_pos", "WITH RECURSIVE docs_pos") + "," + _first_wins("docs_pos") + """
SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT pos FROM kept_pos)
"""


# ---------------------------------------------------------------- sequences, packing, shards
_L, _EOS = C.SEQ_LEN, C.EOS_ID


def _shapes_p6() -> str:
    return _SHAPES + """,
r AS (SELECT shape, rid, coalesce(CASE WHEN text <> '' THEN text END, CASE WHEN content <> '' THEN content END,
                                  CASE WHEN instruction <> '' THEN instruction END, CASE WHEN response <> '' THEN response END, '') AS t
      FROM shapes)"""


SQL["fixed_length_ids"] = _shapes_p6() + f""",
ids AS (SELECT shape, rid, t, list_transform({tokens('t')}, lambda x: length(x)::BIGINT) AS ids FROM r),
fx AS (SELECT shape, rid, CASE WHEN t = '' THEN list_resize([]::BIGINT[], {_L}, {_EOS})
                               ELSE list_resize(list_append(ids, {_EOS}::BIGINT), {_L}, {_EOS}) END AS input_ids FROM ids)
SELECT shape, rid, array_to_string(input_ids, ',') AS input_ids,
       array_to_string(list_transform(input_ids, lambda x: CASE WHEN x <> {_EOS} THEN 1 ELSE 0 END), ',') AS attention_mask
FROM fx WHERE len(input_ids) > 0
"""

_LINES = f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents),
u AS (SELECT doc_id, unnest(range(len(arr))) AS line_no, unnest(arr) AS line FROM l),
s0 AS (SELECT doc_id, line_no, regexp_replace(line, '^{WS}|{WS}$', '', 'g') AS line FROM u),
w AS (SELECT doc_id, line_no::BIGINT AS line_no, list_transform({tokens('line')}, lambda x: length(x)::BIGINT) AS ids
      FROM s0 WHERE length(line) > 0),
s AS (SELECT doc_id, line_no, CASE WHEN len(ids) > 0 AND ids[-1] <> {_EOS} THEN list_append(ids, {_EOS}::BIGINT) ELSE ids END AS ids
      FROM w)"""

_CHUNKS = _LINES + f""",
ch0 AS (SELECT doc_id, line_no, ids, unnest(range(0, greatest(len(ids), 1), {_L})) AS i FROM s),
ch AS (SELECT doc_id, line_no, (i // {_L})::BIGINT AS chunk_idx, ids[i + 1 : i + {_L}] AS chunk,
              (row_number() OVER (ORDER BY doc_id, line_no, i) - 1)::BIGINT AS pos FROM ch0),
cs AS (SELECT *, (pos // {C.SHARD_SIZE})::BIGINT AS shard, (pos % {C.SHARD_SIZE})::BIGINT AS local_idx FROM ch)"""

SQL["chunk_ids"] = _CHUNKS + """
SELECT doc_id, line_no, chunk_idx, pos, shard, local_idx, array_to_string(chunk, ',') AS ids, len(chunk)::BIGINT AS n_ids FROM cs
"""

SQL["sql_token_counts"] = SQL["token_counts"]
SQL["sql_line_chunks"] = _CHUNKS + """
SELECT doc_id, line_no, chunk_idx, array_to_string(chunk, ',') AS ids FROM cs
"""
SQL["sql_examples"] = f"""
WITH i AS (SELECT doc_id, list_transform({tokens("coalesce(text, '')")}, lambda x: length(x)::BIGINT) AS ids FROM documents),
e AS (SELECT doc_id, list_resize(list_append(ids, {_EOS}::BIGINT), {_L}, {_EOS}) AS ids FROM i)
SELECT doc_id, array_to_string(ids, ',') AS input_ids,
       array_to_string(list_transform(ids, lambda x: (x <> {_EOS})::INT), ',') AS attention_mask FROM e
"""

SQL["count_shards"] = _CHUNKS + """
SELECT shard, count(*)::BIGINT AS n_sequences FROM cs GROUP BY shard
"""

SQL["shard_metadata"] = _CHUNKS + f"""
SELECT count(*)::BIGINT AS total_sequences, count(DISTINCT shard)::BIGINT AS num_shards,
       {_L}::BIGINT AS seq_length, {C.SHARD_SIZE}::BIGINT AS shard_size FROM cs
"""

SQL["shard_names"] = _CHUNKS + """,
n AS (SELECT shard, count(*)::BIGINT AS n FROM cs GROUP BY shard)
SELECT shard, printf('shard_%06d', shard) AS name, n,
       (sum(n) OVER (ORDER BY shard) - n)::BIGINT AS lo, (sum(n) OVER (ORDER BY shard))::BIGINT AS hi FROM n
"""

SQL["sequence_files"] = _CHUNKS + """
SELECT pos, shard, local_idx, array_to_string(chunk, ',') AS ids FROM cs
"""

SQL["global_index_points"] = _CHUNKS + f"""
SELECT cs.pos::BIGINT AS idx, cs.shard, cs.local_idx, array_to_string(list_resize(cs.chunk[1:{_L}], {_L}, {_EOS}), ',') AS input_ids
FROM cs WHERE cs.pos % {C.LOOKUP_STRIDE} = 0
"""

SQL["global_index_lookup"] = _CHUNKS + f""",
q AS (SELECT unnest(range((SELECT max(pos) FROM cs) + 11)) AS idx)
SELECT q.idx::BIGINT AS idx, cs.shard, cs.local_idx,
       array_to_string(list_resize(coalesce(cs.chunk, [])[1:{_L}], {_L}, {_EOS}), ',') AS input_ids
FROM q LEFT JOIN cs ON cs.pos = q.idx
"""

# Packing, stated pack by pack over the prefix sums: a pack holds the sequences up to the last that still ends inside
# it; one that is longer than a pack stands alone.
_PL = C.PACK_LEN
_PACK = "WITH RECURSIVE" + _LINES[len("\nWITH"):] + f""",
p AS (SELECT ids, len(ids)::BIGINT AS n, (row_number() OVER (ORDER BY doc_id, line_no) - 1)::BIGINT AS pos FROM s),
e AS MATERIALIZED (SELECT pos, n, (sum(n) OVER (ORDER BY pos))::BIGINT AS x FROM p WHERE n > 0),
o AS (SELECT list(pos ORDER BY pos) AS ps, list(n ORDER BY pos) AS ns, list(x ORDER BY pos) AS xs FROM e),
f(i, j, pack) AS (
  SELECT 1::BIGINT, 1 + len(list_filter(xs, lambda v: v <= greatest(xs[1], {_PL})))::BIGINT, 0::BIGINT FROM o WHERE len(xs) > 0
  UNION ALL
  SELECT f.j, f.j + greatest(1, len(list_filter(xs[f.j : f.j + {_PL}], lambda v: v <= xs[f.j] - ns[f.j] + {_PL}))),
         f.pack + CASE WHEN ns[f.i] > {_PL} THEN (ns[f.i] + {_PL} - 1) // {_PL} ELSE 1 END
  FROM f, o WHERE f.j <= len(xs)
),
k AS (SELECT unnest(range(i, j)) AS r, i, pack FROM f),
z AS (SELECT ps[r] AS pos, ns[r] AS n, pack, xs[r] - ns[r] - (xs[i] - ns[i]) AS off,
             CASE WHEN ns[r] > {_PL} THEN (ns[r] + {_PL} - 1) // {_PL} ELSE 1 END AS n_packs FROM k, o)"""

SQL["pack_lengths"] = _PACK + """
SELECT pos::BIGINT AS pos, pack::BIGINT AS pack, off::BIGINT AS "offset", n_packs::BIGINT AS n_packs FROM z
"""

SQL["pack_ids"] = _PACK + f""",
pc0 AS (SELECT z.pack, z.off, p.ids, unnest(range(0, len(p.ids), {_PL})) AS i FROM z JOIN p USING (pos)),
pc AS (SELECT pack + i // {_PL} AS pack, off, ids[i + 1 : i + {_PL}] AS piece FROM pc0),
pk AS (SELECT pack, list_resize(flatten(list(piece ORDER BY off)), {_PL}, {_EOS}) AS ids FROM pc GROUP BY pack)
SELECT pack::BIGINT AS pack, array_to_string(ids, ',') AS input_ids, len(list_filter(ids, lambda x: x <> {_EOS}))::BIGINT AS n_real FROM pk
"""

_TS = C.SHARD_TOKENS
SQL["token_shards_balanced"] = f"""
WITH d AS (SELECT doc_id, {ntok('text')} AS n FROM documents),
c AS (SELECT doc_id, sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS s FROM d)
SELECT doc_id, (dense_rank() OVER (ORDER BY s // {_TS}) - 1)::BIGINT AS shard FROM c
"""

_RESET = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rn, doc_id, {ntok('text')} AS n FROM documents),
f(rn, doc_id, n, shard, buf) AS (
  SELECT rn, doc_id, n, 0::BIGINT, n FROM d WHERE rn = 1
  UNION ALL
  SELECT d.rn, d.doc_id, d.n, CASE WHEN f.buf >= {_TS} THEN f.shard + 1 ELSE f.shard END,
         CASE WHEN f.buf >= {_TS} THEN d.n ELSE f.buf + d.n END
  FROM f JOIN d ON d.rn = f.rn + 1
)"""

SQL["token_shards_reset"] = _RESET + """
SELECT doc_id, shard::BIGINT AS shard FROM f
"""

SQL["token_shards_drop_tail"] = _RESET + f""",
t AS (SELECT shard, sum(n) AS tot FROM f GROUP BY shard),
tail AS (SELECT shard FROM t WHERE shard = (SELECT max(shard) FROM t) AND tot < {_TS})
SELECT doc_id, shard::BIGINT AS shard FROM f WHERE shard NOT IN (SELECT shard FROM tail)
"""


# ---------------------------------------------------------------- sinks and round trips
SQL["text_line_scan"] = f"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT regexp_replace(line, '^{WS}|{WS}$', '', 'g') AS line FROM l)
SELECT length(line)::BIGINT AS line_chars, md5(line) AS line_md5 FROM s WHERE length(line) > 0
"""

SQL["sequence_shard_round_trip"] = _CHUNKS + """
SELECT shard, local_idx, array_to_string(chunk, ',') AS ids FROM cs
"""

SQL["jsonl_round_trip"] = _RESET + """
SELECT printf('shard_%05d', f.shard) AS shard_name, md5(documents.text) AS text_md5 FROM f JOIN documents USING (doc_id)
"""

SQL["jsonl_shard_files"] = _RESET + """
SELECT printf('shard_%05d.jsonl', f.shard) AS file, md5(documents.text) AS text_md5 FROM f JOIN documents USING (doc_id)
"""


# ---------------------------------------------------------------- streaming: the batch twins
SQL["stream_fixed_length"] = f"""
WITH ids AS (SELECT doc_id, coalesce(CASE WHEN text <> '' THEN text END, '') AS t,
                    list_transform({tokens('text')}, lambda x: length(x)::BIGINT) AS ids FROM documents),
fx AS (SELECT doc_id, CASE WHEN t = '' THEN list_resize([]::BIGINT[], {_L}, {_EOS})
                           ELSE list_resize(list_append(ids, {_EOS}::BIGINT), {_L}, {_EOS}) END AS input_ids FROM ids)
SELECT doc_id, array_to_string(input_ids, ',') AS input_ids,
       array_to_string(list_transform(input_ids, lambda x: CASE WHEN x <> {_EOS} THEN 1 ELSE 0 END), ',') AS attention_mask
FROM fx
"""
SQL["stream_token_budget"] = SQL["token_budget"]
SQL["stream_token_budget_batches"] = SQL["registry_token_budget"]
SQL["stream_near_dedup"] = SQL["near_dedup"]
SQL["stream_step_rollup"] = SQL["step_rollup"]


# ---------------------------------------------------------------- C2 end to end
_BS = C.BUILD_SHARD_TOKENS


def _allocated(rows: str) -> str:
    """CTEs down to al (source_idx, cap): the target over two parts and their sources, of the token counts in ``rows``. A source whose first
    document is over its cap gives nothing, and so ends the interleave of all."""
    return f"""al_s AS (SELECT source_idx, sum(n_tokens)::BIGINT AS lim, CASE WHEN source_idx % 7 < 3 THEN 'core' ELSE 'general' END AS part_name,
                1 + source_idx % 2 AS w FROM {rows} GROUP BY source_idx),
al_p AS (SELECT 1 AS g0, part_name, sum(lim) AS lim, CASE part_name WHEN 'core' THEN {C.ALLOC_SHARES['core']} ELSE {C.ALLOC_SHARES['general']} END AS w,
                (SELECT sum(lim) * {C.ALLOC_TARGET} // 100 FROM al_s)::BIGINT AS quota FROM al_s GROUP BY part_name),
al_q AS (SELECT part_name, got FROM {_fill('al_p', 'g0', 'part_name')}),
al_src AS (SELECT al_s.*, al_q.got AS quota FROM al_s JOIN al_q USING (part_name)),
al AS (SELECT source_idx, got AS cap FROM {_fill('al_src', 'part_name', 'source_idx')})"""


SQL["build_text_shards"] = f"""
WITH RECURSIVE d AS (SELECT source, {src_idx()} AS source_idx, doc_id,
                            coalesce(text, '') AS text, {ntok("coalesce(text, '')")} AS n_tokens
                     FROM documents),
bc AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM d),
{_allocated('d')},
bk AS (SELECT bc.* FROM bc JOIN al USING (source_idx) WHERE cum <= cap),
r AS (SELECT *, row_number() OVER (PARTITION BY source_idx ORDER BY doc_id) AS r FROM bk),
c AS (SELECT source_idx, count(bk.doc_id) AS cnt, row_number() OVER (ORDER BY source_idx) - 1 AS srank FROM al LEFT JOIN bk USING (source_idx) GROUP BY source_idx),
s AS (SELECT count(*) AS nsrc, min(cnt) AS minc FROM c),
il AS (SELECT ((r.r - 1) * s.nsrc + c.srank)::BIGINT AS pos, r.source, r.doc_id, r.n_tokens, r.text
       FROM r JOIN c USING (source_idx), s WHERE r.r <= s.minc),
{_sketch_ctes("il")},
{_first_wins("il")},
kept AS (SELECT *, row_number() OVER (ORDER BY pos) AS rn FROM il WHERE pos IN (SELECT pos FROM kept_pos)),
f(rn, pos, shard, buf) AS (
  SELECT rn, pos, 0::BIGINT, n_tokens FROM kept WHERE rn = 1
  UNION ALL
  SELECT k.rn, k.pos, CASE WHEN f.buf >= {_BS} THEN f.shard + 1 ELSE f.shard END,
         CASE WHEN f.buf >= {_BS} THEN k.n_tokens ELSE f.buf + k.n_tokens END
  FROM f JOIN kept k ON k.rn = f.rn + 1
)
SELECT kept.pos, kept.source, kept.doc_id, kept.n_tokens, f.shard::BIGINT AS shard FROM kept JOIN f USING (pos)
"""


# ---------------------------------------------------------------- C6 with word-length ids
SQL["training_view_words"] = f"""
WITH d AS (SELECT source, {src_idx()} AS source_idx, doc_id, text,
                  list_transform({tokens('text')}, lambda x: length(x)::BIGINT) AS ids
           FROM documents),
ex AS (SELECT *, len(ids)::BIGINT AS n_tokens,
              CASE WHEN text = '' THEN list_resize([]::BIGINT[], {_L}, {_EOS})
                   ELSE list_resize(list_append(ids, {_EOS}::BIGINT), {_L}, {_EOS}) END AS input_ids FROM d),
bc AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM ex),
{_allocated('ex')},
bk AS (SELECT bc.* FROM bc JOIN al USING (source_idx) WHERE cum <= cap),
r AS (SELECT *, row_number() OVER (PARTITION BY source_idx ORDER BY doc_id) AS r FROM bk),
c AS (SELECT source_idx, count(bk.doc_id) AS cnt, row_number() OVER (ORDER BY source_idx) - 1 AS srank FROM al LEFT JOIN bk USING (source_idx) GROUP BY source_idx),
s AS (SELECT count(*) AS nsrc, min(cnt) AS minc FROM c),
il AS (SELECT r.*, (r.r - 1) * s.nsrc + c.srank AS ipos FROM r JOIN c USING (source_idx), s WHERE r.r <= s.minc
       AND len(r.input_ids) > 0),
g AS (SELECT *, row_number() OVER (ORDER BY ipos) - 1 AS gpos FROM il),
n AS (SELECT count(*) AS n FROM g),
e AS (SELECT ep.epoch, g.*, ep.epoch * n.n + g.gpos AS p FROM g, n, (SELECT unnest(range({C.EPOCHS})) AS epoch) ep)
SELECT epoch::BIGINT AS epoch, p::BIGINT AS pos, doc_id, source, (p // {C.BATCH_SIZE})::BIGINT AS batch_id,
       ((p % {C.BATCH_SIZE}) // {C.MICRO_BATCH})::BIGINT AS micro_id,
       (('0x' || substr(md5(CAST(p AS VARCHAR)), 1, 8))::BIGINT % {C.TRAIN_WORLD})::BIGINT AS rank,
       array_to_string(input_ids, ',') AS input_ids
FROM e
"""


# ---------------------------------------------------------------- T5: event-time windows behind a watermark
# An event is late if its window had ended by the watermark after the batches before its own; a window is out once the last
# watermark has passed it.
_W, _LATE = C.WINDOW_HOURS, C.LATE_HOURS
SQL["stream_event_windows"] = f"""
WITH e AS (SELECT ts, event_type, value, floor(event_id * {C.STREAM_RANGES} / (SELECT max(event_id) + 1 FROM events))::INTEGER
                  + CASE WHEN event_id % 97 = 0 THEN 2 WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS b,
                  time_bucket(INTERVAL {_W} HOUR, ts, TIMESTAMP '1970-01-01') AS w FROM events),
m AS (SELECT b, max(max(ts)) OVER (ORDER BY b) - INTERVAL {_LATE} HOUR AS mark FROM e GROUP BY b),
k AS (SELECT e.* FROM e LEFT JOIN m ON m.b = (SELECT max(b) FROM m x WHERE x.b < e.b)
      WHERE m.mark IS NULL OR w + INTERVAL {_W} HOUR > date_trunc('millisecond', m.mark))
SELECT epoch_us(w)::BIGINT AS window_us, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean_value, max(value) AS max_value,
       epoch_us(min(ts))::BIGINT AS first_us, epoch_us(max(ts))::BIGINT AS last_us
FROM k WHERE w + INTERVAL {_W} HOUR <= (SELECT date_trunc('millisecond', max(mark)) FROM m) GROUP BY w, event_type
"""

SQL["stream_epochs"] = f"""
WITH p AS (SELECT doc_id, source, (row_number() OVER (ORDER BY {src_idx()}, doc_id) - 1)::BIGINT AS pos FROM documents),
s AS (SELECT *, pos // greatest(1, ceil(count(*) OVER () / {C.SEGMENTS}::DOUBLE)::BIGINT) AS segment FROM p),
t AS (SELECT *, max(segment) OVER () + 1 AS total FROM s)
SELECT epoch, pos, doc_id, source, ((epoch * total + segment) // {C.SEGMENTS_A_BATCH})::BIGINT AS batch_id
FROM t, (SELECT unnest(range({C.EPOCHS}))::BIGINT AS epoch) e
"""
