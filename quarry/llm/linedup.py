r"""Line deduplication by content-defined chunks of lines.

Lines are the text's lines; every line of ``MIN_WORDS`` words and more is wrapped into pieces that end after words whose hash is 0
modulo ``WRAP``, so the same passage wraps alike wherever it stands; a shorter line is a piece of its own. A rolling hash over the
hashes of two pieces chooses the chunks' boundaries: a chunk begins where the rolling hash is a local minimum, and at the start and
after the end of every wrapped line, so a repeated line has the same chunks whatever lines stand around it. Inside these borders a
chunk of one piece joins the chunk before it, in a wrapped line also one of fewer than ``MIN_WORDS`` words; a first chunk that is as
short takes in the next one. Boundaries depend on the pieces around them only, so inserted or removed text shifts none beyond its
neighbours.

A chunk of at least ``MIN_WORDS`` words that occurs more than once in the corpus stays at its first place, by
(doc_id, place in the text), and elsewhere is removed, with the repeated chunks beside it, where these have ``MIN_RUN`` words
together; so a short phrase that two texts share by chance stays. Two chunks stand in one run only where the same two stand side by
side at an earlier place too; so a text that puts together lines of several others keeps them. A smaller chunk counts as repeated only where the chunks before
and after it are the same too, and the three have ``MIN_WORDS`` words. Chunks meet by a 64-bit hash; all bytes of those that meet are
compared, and where bytes differ, each text decides for itself. Pairs of neighbours meet by a hash of their two hashes.

Scale: what is grouped are narrow rows (document, chunk, hash), with partial aggregation, so a chunk that a third of all documents
hold is no hot key. A bitmap of fixed size of the repeated hashes lets most other chunks go before they are shuffled. Texts
move once, to meet the lists of their repeated chunks.

Edge cases. Null text: stays null. Empty or blank text: as it is. A text that loses all its words: "" (``clean``
drops the row). Rows with the same doc_id and text count as one document and get the same result. Rows with one doc_id
and other texts: ordered by a hash of the text. Null doc_id: before all others. Very long texts: hashed in blocks. Empty table: no rows. Extra
columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, fresh, write_table
from quarry.llm.hashing import buffer_of, mix, words

WRAP, MIN_WORDS, MIN_RUN = 2, 5, 16
BITS = 24  # the bitmap of repeated hashes that is sent to all tasks has 2^BITS bits (2 MB)
_K = np.uint64(0x9FB21C651E98DF25)


def _spread(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` places the value of the group it is in; groups begin at ``starts``."""
    return np.repeat(values, np.diff(np.append(starts, n)))


def chunks(data: np.ndarray, offsets: np.ndarray):
    """The chunks of several texts: (text number, chunk number in the text, hash, first byte, end byte, words, lines, whether it
    can be found repeated)."""
    hashes, begin, end, firsts = words(data, offsets, fold=False)
    n = len(hashes)
    if not n:
        return (*(np.empty(0, np.int64) for _ in range(7)), np.empty(0, bool))
    doc = np.searchsorted(firsts, np.arange(n), "right") - 1
    newlines = np.cumsum(data == 10)
    after = np.ones(n, bool)  # the word begins a line
    after[1:] = (newlines[begin[1:]] != newlines[begin[:-1]]) | (doc[1:] != doc[:-1])
    line = np.flatnonzero(after)
    size = np.diff(np.append(line, n))
    wrapped = _spread(size >= MIN_WORDS, line, n)
    cut = after.copy()
    cut[1:] |= wrapped[:-1] & (hashes[:-1] % np.uint64(WRAP) == 0)
    # units: short lines, and the pieces of wrapped ones
    unit = np.flatnonzero(cut)
    at = np.arange(n) - _spread(unit, unit, n)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + at.astype(np.uint64) * _K))])
    bounds = np.append(unit, n)
    own = mix(total[bounds[1:]] - total[bounds[:-1]])
    m = len(unit)
    long_unit = wrapped[unit]
    hard = np.ones(m, bool)  # a segment begins: a text, a wrapped line, or what follows one
    hard[1:] = (doc[unit[1:]] != doc[unit[:-1]]) | (after[unit[1:]] & (long_unit[1:] | long_unit[:-1]))
    roll = own.copy()
    roll[1:] = np.where(hard[1:], own[1:], mix(own[:-1] * _K + own[1:]))
    low = hard.copy()
    if m > 2:
        inner = ~hard[1:-1] & ~hard[2:] & (roll[1:-1] < roll[:-2]) & (roll[1:-1] < roll[2:])
        low[1:-1] |= inner
    first = np.flatnonzero(low)
    n_units = np.diff(np.append(first, m))
    n_words = np.diff(np.append(unit[first], n))
    joins = ~hard[first] & ((n_units < 2) | ((n_words < MIN_WORDS) & long_unit[first]))
    first = first[~joins]
    # a line's first chunk can't join one before it, so the next one joins it
    n_words = np.diff(np.append(unit[first], n))
    joins = np.zeros(len(first), bool)
    joins[1:] = ~hard[first[1:]] & hard[first[:-1]] & (n_words[:-1] < MIN_WORDS)
    first = first[~joins]
    last = np.append(first[1:], m)
    a, b = unit[first], np.append(unit, n)[last]
    place = np.arange(m) - _spread(first, first, m)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(own + place.astype(np.uint64) * _K))])
    code = mix(total[last] - total[first])
    text = doc[a]
    number = np.arange(len(first)) - np.searchsorted(text, text, "left")
    size, lines = b - a, last - first
    # a small chunk goes by itself and its neighbours in the text
    small = size < MIN_WORDS
    inside = text[1:] == text[:-1]
    before, behind = np.zeros_like(code), np.zeros_like(code)
    before[1:], behind[:-1] = np.where(inside, code[:-1], np.uint64(0)), np.where(inside, code[1:], np.uint64(0))
    around = size.copy()
    around[1:] += np.where(inside, size[:-1], 0)
    around[:-1] += np.where(inside, size[1:], 0)
    code = np.where(small, mix(mix(before * _K + code) * _K + behind), code)
    return text, number, code.view(np.int64), begin[a], end[b - 1], size, lines, ~small | (around >= MIN_WORDS)


def _chunk_rows(batches):
    """The chunks that can be found repeated, each with a short hash of the one behind it (null: none such)."""
    for batch in batches:
        text, number, code, _, _, _, _, keep = chunks(*buffer_of(batch.column(2)))
        rows = pa.array(text[keep])
        alone = np.ones(len(text), bool)
        alone[:-1] = (text[1:] != text[:-1]) | ~keep[1:]
        behind = np.roll(code, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number[keep], pa.int32()), pa.array(code[keep], pa.int64()),
             pa.array(behind[keep], pa.int32(), mask=alone[keep])], ["id", "th", "chunk", "h", "behind"])


def _evidence(bitmap: np.ndarray):
    """The bytes of the chunks whose hashes are in the bitmap."""

    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(batch.column(2))
            text, number, code, a, b, _, _, keep = chunks(data, offsets)
            bit = code.view(np.uint64) >> np.uint64(64 - BITS)
            keep = np.flatnonzero(keep & ((bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool))
            rows = pa.array(text[keep])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number[keep], pa.int32()), pa.array(code[keep], pa.int64()),
                 pa.array([data[a[k]:b[k]].tobytes() for k in keep], pa.binary())], ["id", "th", "chunk", "h", "bytes"])

    return run


def _bits(hashes: DataFrame) -> DataFrame:
    """(word, bits): a bitmap of 2^BITS bits of the hashes' first bits, 64 a row; its size doesn't grow with the data."""
    place = F.shiftrightunsigned("h", 64 - BITS)
    return hashes.select(F.shiftrightunsigned(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITS}) & 63 as int))").alias("bit")) \
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))


def long_runs(listed: set, linked: set, numbers: list, sizes: list) -> set:
    """The listed chunks that stand in runs of at least ``MIN_RUN`` words; a run goes on behind the linked chunks."""
    out, run, total = set(), [], 0
    for number, size in [*zip(numbers, sizes), (None, 0)]:
        if run and (number not in listed or run[-1] not in linked):
            out.update(run if total >= MIN_RUN else ())
            run, total = [], 0
        if number in listed:
            run.append(number)
            total += size
    return out


def _cut(batches):
    """Texts without the listed chunks (2 x number; 2 x number + 1: linked to the next); with them the counts of what went."""
    for batch in batches:
        n = batch.num_columns
        column, lists = batch.column(n - 2), batch.column(n - 1).to_pylist()
        hit = [i for i, cs in enumerate(lists) if cs]
        out, removed = column.to_pylist(), [[0, 0, 0] for _ in lists]
        if hit:
            data, offsets = buffer_of(column.take(pa.array(hit)))
            text, number, _, a, b, n_words, n_lines, _ = chunks(data, offsets)
            edges = np.searchsorted(text, np.arange(len(hit) + 1))
            for k, i in enumerate(hit):
                x, y = edges[k], edges[k + 1]
                listed, linked = {c >> 1 for c in lists[i] if not c & 1}, {c >> 1 for c in lists[i] if c & 1}
                gone = long_runs(listed, linked, number[x:y].tolist(), n_words[x:y].tolist())
                parts, at = [], offsets[k]
                for j in range(x, y):
                    if int(number[j]) in gone:
                        stop = a[j + 1] if j + 1 < y else offsets[k + 1]
                        parts.append(data[at:a[j]].tobytes())
                        at = stop
                        removed[i][0] += 1
                        removed[i][1] += int(n_lines[j])
                        removed[i][2] += int(n_words[j])
                parts.append(data[at:offsets[k + 1]].tobytes())
                rest = b"".join(parts).decode()
                out[i] = rest if rest.strip() else ""
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:n - 2], pa.array(out, pa.string()), *[pa.array([r[c] for r in removed], pa.int64()) for c in range(3)]],
            [*batch.schema.names[:n - 2], "text", "chunks", "lines", "words"])


def _bitmap(words: DataFrame) -> np.ndarray:
    out = np.zeros(1 << (BITS - 6), np.uint64)
    for r in words.collect():  # at most 2^(BITS - 6) rows
        out[r["word"]] = r["bits"] & (1 << 64) - 1
    return out


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the repeated chunks cut out of ``text``, and three more columns: the
    number of chunks, lines and words that were removed (removed_chunks, removed_lines, removed_words)."""
    arrow_rows(docs.sparkSession, 256)
    kind = docs.schema[key].dataType.simpleString()
    body = F.col(text).cast("string")
    th = F.xxhash64(F.coalesce(body, F.lit("")))
    rows = docs.select(F.col(key).alias("id"), th.alias("th"), body.alias("t")).filter("t is not null")
    table = write_table(rows.mapInArrow(_chunk_rows, f"id {kind}, th long, chunk int, h long, behind int"), "chunks")
    place = F.struct("id", "th", "chunk")
    many = write_table(table.groupBy("h").count().filter("count > 1").select("h"), "repeated")
    bits = write_table(_bits(many), "bitmap")
    word = F.shiftrightunsigned(F.shiftrightunsigned("h", 64 - BITS), 6) == F.col("word")
    hit = F.expr(f"shiftright(bits, cast(shiftrightunsigned(h, {64 - BITS}) & 63 as int)) & 1 = 1")
    maybe = table.join(F.broadcast(bits), word).filter(hit).select("id", "th", "chunk", "h", "behind")  # most others go before the shuffle
    met = write_table(maybe.join(many, "h", "left_semi"), "met")
    # rows that repeat in full give the same places
    first = met.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select("h", "first")
    hits = write_table(met.join(first, "h").select("id", "th", "chunk", "h", "behind", (place == F.col("first")).alias("stays")), "hits")
    # pairs of neighbours that stand side by side at an earlier place
    pairs = hits.filter("behind is not null").select("id", "th", "chunk", "stays", F.xxhash64("h", "behind").alias("pair"))
    earliest = pairs.groupBy("pair").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select("pair", "first")
    links = pairs.filter("not stays").join(earliest, "pair").filter(place != F.col("first")) \
        .select("id", "th", (F.col("chunk").cast("long") * 2 + 1).alias("mark"))
    marks = lambda frame: frame.select("id", "th", (F.col("chunk").cast("long") * 2).alias("mark")).unionByName(links)
    listed = lambda frame: marks(frame).groupBy("id", "th").agg(F.collect_set("mark").alias("chunks"))
    i, h, got = fresh(docs, "id", "th", "chunks")
    mine = lambda frame: listed(frame).select(F.col("id").alias(i), F.col("th").alias(h), F.col("chunks").alias(got))
    meets = lambda a, b: a[key].eqNullSafe(b[i]) & (th == b[h])

    proof = rows.mapInArrow(_evidence(_bitmap(bits)), f"id {kind}, th long, chunk int, h long, bytes binary")
    false = write_table(proof.groupBy("h").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b")).filter("a != b").select("h"), "collisions")
    gone = hits.filter("not stays").select("id", "th", "chunk", "h")
    if not false.isEmpty():  # hashes that met by chance: by their bytes
        proof = rows.mapInArrow(_evidence(_bitmap(_bits(false))), f"id {kind}, th long, chunk int, h long, bytes binary")
        apart = proof.join(false, "h", "left_semi")
        first = apart.groupBy("h", "bytes").agg(F.min(place).alias("first"))
        more = apart.join(first, ["h", "bytes"]).filter(place != F.col("first")).select("id", "th", "chunk", "h")
        gone = gone.join(false, "h", "left_anti").unionByName(more)
    there = mine(gone)
    names = fresh(docs, "removed_chunks", "removed_lines", "removed_words")
    others = [c for c in docs.columns if c != text]
    joined = docs.join(there, meets(docs, there), "left").select(*[docs[c] for c in others], body.alias("t"), F.col(got))
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]
    # inside the function columns go by position
    plain = joined.toDF(*[f"c{k}" for k in range(len(others))], "t", "chunks")
    schema = ", ".join([f"c{k} {f.rpartition('` ')[2]}" for k, f in enumerate(fields)] + ["text string", "chunks long", "lines long", "words long"])
    out = plain.mapInArrow(_cut, schema).toDF(*others, text, *names)
    return out.select(*docs.columns, *names)


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``dedup_lines`` with the columns of ``docs``; documents that lost all their words are dropped."""
    out = dedup_lines(docs, key, text)
    name = [c for c in out.columns if c not in docs.columns][2]
    return out.filter((F.col(name) == 0) | (F.col(text) != "")).select(*docs.columns)
