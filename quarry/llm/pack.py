"""Bounded-space online packing of token sequences.

Each task reads its documents once, in order, and keeps at most ``open_windows`` windows open. A document's ids (with
``end_id`` after them) are cut into whole windows, which are complete at once, and a rest. The rest goes to the open
window that it fills best; when none has room, the fullest is emitted and a new one opened. What is still open
at the end of a task is left over. Leftovers are merged by the same rule, fullest first, in groups of at most ``MERGE``
windows, round by round until one group is left; its open windows are emitted too.

Scale: documents and ids aren't shuffled, and a task holds ``open_windows`` windows and one document. Only leftovers
move, a bounded number per task. ``sequence_id`` is gapless: per task, the sum of what earlier tasks emitted, plus
a counter; the table of sums has a row per task.

Edge cases. Null or empty text: one piece, the end id alone. Repeated rows and null keys: a row each. Very long texts:
whole windows. Empty table: no sequences. Extra columns: ignored.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, write_table

MERGE = 4096
#: Characters for which the two libraries' patterns are known to agree (tested); other texts take the slower one.
_COMMON = re.compile("[\t\n\r\x20-\x7e¡-ɏ‐-‧‰-⁞]*")
_loaded: dict = {}


class Encoder:
    """Ids of a ``tokenizers`` file. Where ``ranks`` names the same vocabulary's merge ranks (and ``pattern`` its
    pre-tokenizer), texts of common characters without special strings take the faster ``tiktoken``."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and (text.isascii() or _COMMON.fullmatch(text)) and not any(s in text for s in self.special):
            if text.isascii() and re.search("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text):
                return self._slow(text)
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.int32)
        return self._slow(text)

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int32)


class _Emitter:
    """Rows of finished windows as Arrow batches."""

    def __init__(self, kind, stage):
        self.kind, self.stage, self.part = kind, stage, TaskContext.get().partitionId()
        self.rows, self.n, self.held = [], [0, 0], 0

    def put(self, window, is_open=False):
        self.rows.append((self.n[is_open], is_open, window))
        self.n[is_open] += 1
        self.held += window[1]

    def batch(self):
        rows, self.rows, self.held = self.rows, [], 0
        pieces = [[p for p in w[2]] for _, _, w in rows]
        at = np.cumsum([0] + [len(p) for p in pieces]).astype(np.int32)
        ids = np.cumsum([0] + [w[1] for _, _, w in rows]).astype(np.int32)
        lists = lambda i, kind: pa.ListArray.from_arrays(at, pa.array([x[i] for p in pieces for x in p], kind))
        flat = np.concatenate([a for _, _, w in rows for a in w[3]]) if rows else np.empty(0, np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.stage] * len(rows), pa.int32()), pa.array([self.part] * len(rows), pa.int64()),
             pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()),
             lists(0, self.kind), lists(1, pa.int64()), lists(2, pa.int64()), lists(3, pa.int64()),
             pa.ListArray.from_arrays(ids, pa.array(flat, pa.int32()))],
            ["stage", "part", "n", "open", "keys", "starts", "lengths", "totals", "ids"])


class _Packer:
    """Best fit into a bounded number of open windows. A window is [order, used, pieces, arrays of ids]."""

    def __init__(self, length: int, limit: int, out: _Emitter):
        self.length, self.limit, self.out = length, limit, out
        self.sizes: list[tuple[int, int]] = []  # (used, order), ascending
        self.windows: dict[int, list] = {}
        self.made = 0

    def add(self, used: int, pieces: list, arrays: list) -> None:
        if used == self.length:
            self.out.put([0, used, pieces, arrays])
            return
        at = bisect_left(self.sizes, (self.length - used + 1, -1)) - 1  # the fullest with room
        if at >= 0:
            size, order = self.sizes.pop(at)
            window = self.windows.pop(order)
            window[1] += used
            window[2] += pieces
            window[3] += arrays
            if window[1] == self.length:
                self.out.put(window)
                return
        else:
            if len(self.sizes) >= self.limit:
                self.out.put(self.windows.pop(self.sizes.pop()[1]))
            window = [self.made, used, list(pieces), list(arrays)]
            self.made += 1
        self.windows[window[0]] = window
        insort(self.sizes, (window[1], window[0]))

    def leave(self) -> None:
        for _, order in reversed(self.sizes):
            self.out.put(self.windows[order], True)


def _pack_documents(encoder: tuple, length: int, limit: int, end_id: int):
    def run(batches):
        if encoder not in _loaded:
            _loaded[encoder] = Encoder(*encoder)
        encode, out = _loaded[encoder].ids, None
        for batch in batches:
            if out is None:
                out = _Emitter(batch.schema.field(0).type, 0)
                packer = _Packer(length, limit, out)
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.int32(end_id))
                for start in range(0, len(ids), length):
                    part = ids[start:start + length]
                    packer.add(len(part), [(key, start, len(part), len(ids))], [part])
                    if out.held > 1 << 19:
                        yield out.batch()
        if out is not None:
            packer.leave()
            yield out.batch()

    return run


def _pack_windows(stage: int, length: int, limit: int):
    def run(batches):
        out = None
        for batch in batches:
            if out is None:
                out = _Emitter(batch.schema.field("keys").type.value_type, stage)
                packer = _Packer(length, limit, out)
            lists = [batch.column(c).to_pylist() for c in ("keys", "starts", "lengths", "totals")]
            ids = batch.column("ids")
            for i, pieces in enumerate(zip(*lists)):
                array = np.array(ids[i].values, np.int32)
                packer.add(len(array), list(zip(*pieces)), [array])
                if out.held > 1 << 19:
                    yield out.batch()
        if out is not None:
            packer.leave()
            yield out.batch()

    return run


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = 1024, end_id: int = 0,
                   open_windows: int = 64, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(sequence_id, n_tokens, keys, starts, lengths, totals, ids)``: a row per sequence of at most ``length`` ids,
    as a stored table. The four lists have a sequence's pieces in order: document key, ids of the document before
    the piece, length, ids of the whole document (with the end id)."""
    spark = docs.sparkSession
    arrow_rows(spark)
    kind = docs.schema[key].dataType.simpleString()
    schema = (f"stage int, part long, n long, open boolean, keys array<{kind}>, starts array<long>, lengths array<long>, "
              "totals array<long>, ids array<int>")
    rows = write_table(docs.select(key, text).mapInArrow(
        _pack_documents((path, ranks, pattern), length, open_windows, end_id), schema), "packed")
    tables, stage = [rows.filter("not open")], 0
    left, n = rows.filter("open"), rows.filter("open").count()
    while n:
        stage += 1
        groups = -(-n // MERGE)
        size = F.size("ids")
        dealt = left.repartition(1) if groups == 1 else left.repartition(groups, "part", "n")
        merged = write_table(dealt.sortWithinPartitions(size.desc(), "part", "n")
                             .mapInArrow(_pack_windows(stage, length, open_windows), schema), "packed")
        if groups == 1:
            # the last group's open windows are numbered after its complete ones
            done = merged.filter("not open").count()
            tables.append(merged.withColumn("n", F.col("n") + F.when(F.col("open"), done).otherwise(0)))
            break
        tables.append(merged.filter("not open"))
        left = merged.filter("open")
        n = left.count()
    table = tables[0]
    for t in tables[1:]:
        table = table.unionByName(t)
    counts = table.groupBy("stage", "part").agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("stage", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("stage", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("at"))
    return (table.join(F.broadcast(starts), ["stage", "part"])  # a row per task
            .select((F.col("at") + F.col("n")).alias("sequence_id"), F.size("ids").alias("n_tokens"), "keys", "starts",
                    "lengths", "totals", "ids"))


def _pieces(batches):
    import zlib

    for batch in batches:
        rows = []
        cols = [batch.column(c).to_pylist() for c in ("sequence_id", "keys", "starts", "lengths", "totals")]
        ids = batch.column("ids")
        for i, (seq, keys, starts, lengths, totals) in enumerate(zip(*cols)):
            data, at = np.array(ids[i].values, "<u4"), 0
            for key, start, length, total in zip(keys, starts, lengths, totals):
                rows.append((key, start, length, zlib.crc32(data[at:at + length].tobytes()), total, seq, at))
                at += length
        kinds = [batch.schema.field("keys").type.value_type] + [pa.int64()] * 6
        cols = list(zip(*rows)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def piece_table(sequences: DataFrame) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32 (of the sequence's ids there), doc_tokens, sequence_id, offset."""
    arrow_rows(sequences.sparkSession)
    kind = sequences.schema["keys"].dataType.elementType.simpleString()
    return sequences.mapInArrow(_pieces, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                                         "sequence_id long, offset long")
