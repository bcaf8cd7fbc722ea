r"""Chat formatting with budgeted windows.

A conversation becomes windows of whole turns. Prefix sums of the turns' tokens choose the spans: a
window takes turns while system turn + repeated history + new turns stay within ``budget`` tokens.
Each window after the first repeats the conversation's system turn (its first turn, where its role is
``system``) and the last turns of at most ``history`` tokens before its span. The loss mask covers the
text of new assistant turns only, so a repeated target is masked and each target counts once.

Template: ``### role: text</turn>\n``. Inside texts ``\`` becomes ``\\``, a ``#`` that two more follow
becomes ``\h`` and the ``<`` of ``</turn>`` becomes ``\l``; so no control string is left in a text, and
undoing it gives back each text exactly. Roles also escape ``:`` (``\c``) and newline (``\n``).

Scale: turns are dealt by (conversation, block of ``block`` turn numbers), so a conversation of any
length is split over tasks; a block begins a new window and gets the system turn and the history as
copied rows. Tasks stream sorted rows and hold one window.

Edge cases. Null text or role: empty. Null conv_id: one conversation of its own. Null turn: before the
others. Turns with equal numbers: by role, then text. Repeated rows: repeated turns. A turn longer than
the budget: a window of its own beside the system turn, ``over_budget`` true, nothing cut. Empty table:
no windows. Extra columns: ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows

TARGET = "assistant"
SYSTEM = "system"
MARK_TOKENS = 3  # tokens that a turn's marks are counted as
HEAD, END = "### ", "</turn>\n"
_UNDO = {"\\": "\\", "h": "#", "l": "<", "c": ":", "n": "\n"}


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    text = re.sub("#(?=##)", r"\\h", text)
    return text.replace("</turn>", "\\l/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _UNDO[m[1]], text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\c").replace("\n", "\\n")


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    out = []
    for part in text.split(END)[:-1]:
        role, _, body = part[len(HEAD):].partition(": ")
        out.append((unescape(role), unescape(body)))
    return out


class _Span:
    """The window being built: context turns first, then new ones."""

    def __init__(self, context):
        self.parts, self.loss, self.chars, self.tokens, self.new = [], [], 0, 0, 0
        for role, text, n in context:
            self._put(role, text, n)
        self.context = len(self.parts)

    def _put(self, role, text, n):
        head = f"{HEAD}{role}: "
        start = self.chars + len(head)
        self.parts.append(head + text + END)
        self.chars = start + len(text) + len(END)
        self.tokens += n
        return start, start + len(text)

    def add(self, role, text, n, target):
        span = self._put(role, text, n)
        self.new += 1
        if target:
            self.loss.append(list(span))


def _windows(budget: int, history: int):
    def run(batches):
        key, system, past, span, index = None, None, deque(), None, 0
        rows = []

        def flush():
            nonlocal span, index
            if span is not None and span.new:
                rows.append((key[0], key[1], index, span.context, span.new, "".join(span.parts), span.loss,
                             span.tokens, span.tokens > budget))
                index += 1
            span = None

        def out():
            nonlocal rows
            cols = list(zip(*rows)) if rows else [[]] * 9
            rows = []
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                ["conv_id", "block", "window", "n_context", "n_new", "text", "loss", "n_tokens", "over_budget"])

        types = None
        for batch in batches:
            if types is None:
                types = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                         pa.string(), pa.list_(pa.list_(pa.int64())), pa.int64(), pa.bool_()]
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for conv, blk, kind, first, role, text, n in zip(*cols):
                if key is None or key != (conv, blk):
                    flush()
                    key, system, past, index, fresh_conv = (conv, blk), None, deque(), 0, first
                turn = (escape_role(role), escape(text), n)
                if kind == 0:
                    system = turn
                elif kind == 1:
                    past.append(turn)
                else:
                    if span is not None and span.new and span.tokens + n > budget:
                        flush()
                    if span is None:
                        left = min(history, budget - n - (system[2] if system else 0))
                        context = []
                        for old in reversed(past):
                            left -= old[2]
                            if left < 0:
                                break
                            context.append(old)
                        span = _Span(([system] if system else []) + context[::-1])
                    span.add(*turn, role == TARGET)
                    if fresh_conv and role == SYSTEM and system is None:
                        system = turn
                    else:
                        past.append(turn)
                        kept = sum(t[2] for t in past)
                        while past and kept > history:
                            kept -= past.popleft()[2]
                    fresh_conv = False
                if len(rows) >= 256:
                    yield out()
        flush()
        if types is not None:
            yield out()

    return run


def format_windows(df: DataFrame, budget: int = 1024, history: int = 256, block: int = 256) -> DataFrame:
    """``(conv_id, block, window, n_context, n_new, text, loss, n_tokens, over_budget)``.

    ``df`` has conv_id, turn, role, text. ``loss`` lists [start, end) code points of ``text`` that are
    targets. ``(block, window)`` orders a conversation's windows; ``n_context`` leading turns are repeats.
    """
    arrow_rows(df.sparkSession)
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    turns = df.select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / block).cast("long"), F.lit(-(2**62))).alias("blk"), "turn",
        role.alias("role"), text.alias("text"),
        (F.size(F.split(F.trim(text), r"\s+")) + MARK_TOKENS).cast("long").alias("n"))
    blocks = turns.groupBy("conv_id", "blk").agg(F.count(F.lit(1)).alias("rows"))
    by_conv = Window.partitionBy("conv_id")
    long_ones = (blocks.withColumn("first_blk", F.min("blk").over(by_conv))
                 .withColumn("next_blk", F.lead("blk").over(by_conv.orderBy("blk")))
                 .withColumn("n_blk", F.count(F.lit(1)).over(by_conv)).filter("n_blk > 1")
                 .select(F.col("conv_id").alias("c"), F.col("blk").alias("b"), "first_blk", "next_blk"))
    marked = turns.join(long_ones, turns.conv_id.eqNullSafe(F.col("c")) & (turns.blk == F.col("b")), "left")
    is_first = F.col("first_blk").isNull() | (F.col("blk") == F.col("first_blk"))
    order = ["turn", "role", "text"]
    in_block = Window.partitionBy("conv_id", "blk")
    rest = (marked.filter(F.col("first_blk").isNotNull())
            .withColumn("rn", F.row_number().over(in_block.orderBy(*order)))
            .withColumn("tail", F.sum("n").over(in_block.orderBy(*[F.desc(c) for c in order])
                                                .rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("is_sys", is_first & (F.col("rn") == 1) & (F.col("role") == SYSTEM)))
    cols = ["conv_id", "blk", "kind", "first", "turn", "role", "text", "n"]
    new = marked.withColumn("kind", F.lit(2)).withColumn("first", is_first).select(*cols)
    past = (rest.filter(~F.col("is_sys") & F.col("next_blk").isNotNull() & (F.col("tail") <= history))
            .withColumn("blk", F.col("next_blk")).withColumn("kind", F.lit(1)).withColumn("first", F.lit(False))
            .select(*cols))
    later = long_ones.filter("b > first_blk").select(F.col("c").alias("lc"), F.col("b").alias("lb"))
    system = rest.filter("is_sys").join(later, F.col("conv_id").eqNullSafe(F.col("lc")))
    system = (system.withColumn("blk", F.col("lb")).withColumn("kind", F.lit(0)).withColumn("first", F.lit(False))
              .select(*cols))
    rows = new.unionByName(past).unionByName(system)
    rows = (rows.repartition("conv_id", "blk").sortWithinPartitions("conv_id", "blk", "kind", *order)
            .select("conv_id", "blk", "kind", "first", "role", "text", "n"))
    kind = df.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(_windows(budget, history),
                           f"conv_id {kind}, block long, window long, n_context long, n_new long, text string, "
                           "loss array<array<bigint>>, n_tokens long, over_budget boolean")


def _digest(batches):
    key, turns, loss, n, chars, formatted, wins = None, None, None, 0, 0, 0, 0
    rows, kind = [], None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def out():
        nonlocal rows
        cols = list(zip(*rows)) if rows else [[]] * 7
        rows = []
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    def close():
        if turns is not None:
            rows.append((key[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted, wins))

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        cols = [batch.column(c).to_pylist() for c in ("conv_id", "n_context", "text", "loss")]
        for conv, skip, text, spans in zip(*cols):
            if key != (conv,):
                close()
                key, turns, loss = (conv,), hashlib.sha256(), hashlib.sha256()
                n = chars = formatted = wins = 0
            for role, body in parse(text)[skip:]:
                turns.update(f"{role}\n{body}\n".encode())
                n += 1
            for a, b in spans:
                target = unescape(text[a:b])
                loss.update(target.encode())
                chars += len(target)
            formatted += len(text)
            wins += 1
        if len(rows) >= 256:
            yield out()
    close()
    if kind is not None:
        yield out()


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, digests of its turns and of its loss text, read from the formatted windows.
    A digest runs over a conversation's windows in order, in constant memory."""
    arrow_rows(windows.sparkSession)
    kind = windows.schema["conv_id"].dataType.simpleString()
    ordered = (windows.select("conv_id", "block", "window", "n_context", "text", "loss").repartition("conv_id")
               .sortWithinPartitions("conv_id", "block", "window"))
    return ordered.mapInArrow(_digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                       "loss_sha256 string, formatted_chars long, n_windows long")
