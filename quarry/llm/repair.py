"""Conversation structure repair by an auction shortest-path algorithm.

A repaired conversation's role initials read ``(s?(ua)+)?``. Its rows are kept (0), given the role that fits, user or assistant (1), or
deleted (2; blank and duplicate rows must be), and empty turns are inserted anywhere (5); a truncated row that stays costs 5 more.
The cheapest edits are a shortest path in a lattice with a layer for each row and a node for each state of that grammar: start, after s, after
u, after a.

Each layer is solved by an auction. A path starts at a node and looks at its last node's cheapest arc, cost plus price of the
node it leads to: if the last node's price is lower it rises to that and the path contracts by a node, else the path extends along the arc, until it
meets a node whose price has converged. Layers are taken from the last one back, each a path for each of its nodes, with prices first set to the
least of the layer after it, so a layer takes a few steps at any length and cost. Converged prices are the
distances to the end, and arcs with price = cost + price are tight; every path of tight arcs is a cheapest one, and the path that takes the
ASCII-least edit (D, I, K, R) at every node is the least of them.

A conversation may hold any share of all rows. One sort by range (conversation, turn) numbers the rows; ``2 ** BLOCK_BITS`` consecutive numbers
are a block. Blocks of a conversation with several are solved for each state they may end in, which gives a matrix of costs; the matrices of up
to ``2 ** FAN_BITS`` neighbours combine to one by the same auction, tier by tier, and on the way back each block gets the prices of its
last layer. In the same way the states that blocks lead to combine, and each gets the state that it starts in. Only the final digest of a
conversation runs over its rows in order in one task, with constant memory beside the list of edits: SHA-256 has no parallel form.

Order of rows: by turn (nulls first); ties by role, then by the MD5 of role and text, so equal rows are neighbours.

Edge cases. Null role or text: one space. Null conv_id: a conversation, before all others. Roles are told by their first
character; others than s, u, a can't be kept. Empty texts are blank. Repeated rows: duplicates. All rows deleted: an empty conversation. Empty table: no
rows. Extra columns: ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batches_of, write_table

START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {START: "user", AFTER_S: "user", AFTER_U: "assistant", AFTER_A: "user"}  # the role that an R or I takes
LEADS = {"user": AFTER_U, "assistant": AFTER_A}
INITIALS, FAULTS = "sua?", ("", "truncated", "blank", "duplicate")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 1 << 50  # no way
BLOCK_BITS, FAN_BITS = 8, 10
PART_BITS, IN_PART = 33, (1 << 33) - 1
SPACE = " \t\n\x0b\x0c\r"
NO_ID = -(2**63)
LEGAL = {"su", "ua", "au"}


def damage(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults by the CRC-32 of ``conv_id:turn``, modulo 20 (nulls: one space)."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(F.encode(key, "UTF-8")) % 20).alias("case"))
    text = F.when(F.col("case") == 1, F.lit("")).when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("case") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("case != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("again")).drop("again")


def conversation(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("long"), F.lit(NO_ID))


# ---- the auction


def auction(arcs: list[list[tuple[int, int, bool, str]]], after: tuple[int, ...]) -> list[int]:
    """Prices of a layer's nodes. ``arcs[q]``: (cost, node, whether the node is in this layer, edit); ``after``: converged prices of the
    next layer."""
    low = min(after)
    # no price of a node with a way is higher than that of the dearest simple path; what rises beyond has none
    most = max((x for x in after if x < FAR), default=-1) + sum(a[0] for own in arcs for a in own)
    price, done = [low] * len(arcs), [False] * len(arcs)
    for origin in range(len(arcs)):
        path = [origin]
        while not done[origin]:
            here = path[-1]
            best, to, inside = FAR, -1, False
            for cost, node, same, _ in arcs[here]:
                x = cost + (price[node] if same else after[node])
                if x < best and x <= most:
                    best, to, inside = x, node, same
            if price[here] < best:
                price[here] = best  # it rises, the path contracts
                if best == FAR:
                    done[here] = True
                if len(path) > 1:
                    path.pop()
            elif best == FAR:
                done[here] = True
            elif inside and not done[to]:
                path.append(to)
            else:  # met a converged node: so are all nodes of the path
                for node in path:
                    done[node] = True
    return price


def row_arcs(kind: int) -> list[list[tuple[int, int, bool, str]]]:
    """The edits at a row (initial x fault) in each state; in the order of their letters."""
    initial, fault = INITIALS[kind // 4], FAULTS[kind % 4]
    out = []
    for state in range(4):
        arcs = [(DELETE, state, False, "D"), (INSERT, LEADS[NEXT[state]], True, "I")]
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            if initial == NEXT[state][0]:
                arcs.append((more, LEADS[NEXT[state]], False, "K"))
            elif initial == "s" and state == START:
                arcs.append((more, AFTER_S, False, "K"))
            arcs.append((REROLE + more, LEADS[NEXT[state]], False, "R"))
        out.append(arcs)
    return out


#: After the last row: nodes start and after a lead to the end (node 0 of the next layer); turns may still be inserted.
END_ARCS = [([(0, 0, False, "")] if q in (START, AFTER_A) else []) + [(INSERT, LEADS[NEXT[q]], True, "I")] for q in range(4)]
ARCS = [row_arcs(kind) for kind in range(16)]
_LAYERS: dict = {}


def tight(arcs, price, after) -> list[tuple[str, int, bool]]:
    """Of each node, the least edit of a tight arc, the node it leads to and whether that is in the same layer."""
    out = []
    for q, own in enumerate(arcs):
        found = [(edit, node, same) for cost, node, same, edit in own if price[q] < FAR and price[q] == cost + (price[node] if same else after[node])]
        out.append(min(found) if found else ("", -1, False))
    return out


def layer(kind: int, after: tuple[int, ...]):
    """(prices, tight arcs) of a row's layer. Layers of one kind whose next prices differ by a constant are solved once."""
    base = min(after)
    key = kind, tuple(x - base if x < FAR else FAR for x in after)
    if key not in _LAYERS:
        price = auction(ARCS[kind], key[1])
        _LAYERS[key] = price, tight(ARCS[kind], price, key[1])
    price, arcs = _LAYERS[key]
    return tuple(x + base if x < FAR else FAR for x in price), arcs


END = tuple(auction(END_ARCS, (0,)))
END_TIGHT = tight(END_ARCS, END, (0,))


def walk(kinds, after: tuple[int, ...], state: int, last: bool) -> tuple[str, int]:
    """The edits of a block from ``state`` on, and the state that they lead to."""
    choices = []
    for kind in reversed(kinds):
        after, arcs = layer(kind, after)
        choices.append(arcs)
    edits = []
    for arcs in reversed(choices):
        inside = True
        while inside:
            edit, state, inside = arcs[state]
            if state < 0:
                return "", -1  # no way from here
            edits.append(edit)
    while last and END_TIGHT[state][0]:
        edit, state, _ = END_TIGHT[state]
        edits.append(edit)
    return "".join(edits), state


def matrix(kinds) -> list[int]:
    """Costs from each state before a block to each state after it."""
    columns = []
    for to in range(4):
        after = tuple(0 if q == to else FAR for q in range(4))
        for kind in reversed(kinds):
            after, _ = layer(kind, after)
        columns.append(after)
    return [columns[to][state] for state in range(4) for to in range(4)]


def _matrix_arcs(m: list[int]):
    return [[(m[4 * q + r], r, False, "") for r in range(4) if m[4 * q + r] < FAR] for q in range(4)]


def combine_costs(parts: list[list[int]]) -> list[int]:
    columns = []
    for to in range(4):
        after = tuple(0 if q == to else FAR for q in range(4))
        for m in reversed(parts):
            after = tuple(auction(_matrix_arcs(m), after))
        columns.append(after)
    return [columns[to][state] for state in range(4) for to in range(4)]


def push_prices(parts: list[list[int]], after: list[int]) -> list[list[int]]:
    """Prices after each part."""
    out = []
    for m in reversed(parts):
        out.append(list(after))
        after = auction(_matrix_arcs(m), tuple(after))
    return out[::-1]


def combine_states(parts: list[list[int]]) -> list[int]:
    out = list(range(4))
    for states in parts:
        out = [states[q] if q >= 0 else -1 for q in out]
    return out


def push_state(parts: list[list[int]], start: list[int]) -> list[list[int]]:
    """The state before each part."""
    out, q = [], start[0]
    for states in parts:
        out.append([q])
        q = states[q]
    return out


# ---- blocks and tiers


def _map(df: DataFrame, schema: str, fn) -> DataFrame:
    """Small rows in, small rows out: ``fn`` gives the rows of one."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [r for row in batch.to_pylist() for r in fn(row)]
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(names)}, schema=kept)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kept = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def _up(items: DataFrame, combine, fan_bits: int) -> list[DataFrame]:
    """Tiers (cid, id, parts, item) above ``items`` (cid, id, item): up to ``2 ** fan_bits`` neighbours each; the last has one row
    a conversation."""
    tiers = []
    while True:
        kids = items.groupBy("cid", F.shiftright("id", fan_bits).alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "item"))).alias("parts"))
        tier = write_table(_map(kids, "cid long, id long, parts array<struct<id:long,item:array<long>>>, item array<long>",
                                lambda r: [(r["cid"], r["id"], r["parts"], combine([p["item"] for p in r["parts"]]))]), "tier")
        tiers.append(tier)
        items = tier.select("cid", "id", "item")
        if items.groupBy("cid").count().filter("count > 1").isEmpty():
            return tiers


def _down(tiers: list[DataFrame], first: list[int], push) -> DataFrame:
    """``(cid, id, value)`` of the items below the tiers; ``first``: the value of a whole conversation."""
    above = None
    for tier in reversed(tiers):
        rows = tier.withColumn("value", F.array(*[F.lit(x).cast("long") for x in first])) if above is None else tier.join(above, ["cid", "id"])
        above = _map(rows.select("cid", "parts", "value"), "cid long, id long, value array<long>",
                     lambda r: [(r["cid"], p["id"], v) for p, v in zip(r["parts"], push([p["item"] for p in r["parts"]], r["value"]))])
    return above


def _solved(blocks: DataFrame, fan_bits: int) -> DataFrame:
    """``(cid, at, kinds, state, edits)`` of all blocks (cid, id, at, kinds)."""
    ends = blocks.groupBy("cid").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    blocks = write_table(blocks.join(ends, "cid"), "blocks")
    end, start = (F.array(*[F.lit(x).cast("long") for x in v]) for v in (END, [START]))
    whole = blocks.filter("low = high").select("cid", "at", "kinds", F.lit(True).alias("last"), end.alias("after"), start.alias("state"))
    many = blocks.filter("low != high")
    top = many.agg(F.max(F.col("id").bitwiseAND(F.lit(IN_PART)))).first()[0]
    if top is not None:
        bits = top.bit_length()  # numbers without a gap between partitions need fewer tiers
        many = many.withColumn("was", F.col("id")).withColumn("id", F.shiftleft(F.shiftright("id", PART_BITS), bits).bitwiseOR(F.col("id").bitwiseAND(F.lit(IN_PART))))
        costs = _map(many.select("cid", "id", "kinds"), "cid long, id long, item array<long>", lambda r: [(r["cid"], r["id"], matrix(r["kinds"]))])
        after = _down(_up(costs, combine_costs, fan_bits), list(END), push_prices).withColumnRenamed("value", "after")
        many = write_table(many.join(after, ["cid", "id"]), "priced")
        states = _map(many.select("cid", "id", "kinds", "after"), "cid long, id long, item array<long>",
                      lambda r: [(r["cid"], r["id"], [walk(r["kinds"], tuple(r["after"]), q, False)[1] for q in range(4)])])
        state = _down(_up(states, combine_states, fan_bits), [START], push_state).withColumnRenamed("value", "state")
        whole = whole.unionByName(many.join(state, ["cid", "id"]).select("cid", "at", "kinds", (F.col("high") == F.col("was")).alias("last"), "after", "state"))
    return _map(whole, "cid long, at long, kinds array<int>, state int, edits string",
                lambda r: [(r["cid"], r["at"], r["kinds"], r["state"][0], walk(r["kinds"], tuple(r["after"]), r["state"][0], r["last"])[0])])


EDIT = "cid long, turn long, was string, fault string, edit string, role string, text string"


def _apply(batches):
    """Rows sorted by conversation and number, each block's edits before its rows -> a row for each edit, in order."""
    kinds, edits, state, at, i = [], "", START, 0, 0

    for batch in batches:
        out = {n: [] for n in ("cid", "turn", "was", "fault", "edit", "role", "text")}

        def put(*row):
            for column, value in zip(out.values(), row):
                column.append(value)

        columns = [batch.column(c).to_pylist() for c in ("cid", "turn", "role", "text", "kinds", "state", "edits")]
        for cid, turn, role, text, block, begin, labels in zip(*columns):
            if block is not None:
                kinds, edits, state, at, i = block, labels, begin, 0, 0
                continue
            while edits[at] == "I":
                put(cid, None, None, None, "I", NEXT[state], "")
                state, at = LEADS[NEXT[state]], at + 1
            edit, new = edits[at], role
            if edit == "D":
                new = None
            elif edit == "R":
                new = NEXT[state]
            if edit != "D":
                state = AFTER_S if new[0] == "s" else LEADS[NEXT[state]]
            put(cid, turn, role, FAULTS[kinds[i] % 4] or None, edit, new, text)
            at, i = at + 1, i + 1
            if i == len(kinds):  # inserted after the last row of the conversation
                for _ in edits[at:]:
                    put(cid, None, None, None, "I", NEXT[state], "")
                    state = LEADS[NEXT[state]]
        yield pa.RecordBatch.from_pydict(out, schema=_EDIT)


_EDIT = pa.schema([("cid", pa.int64()), ("turn", pa.int64()), *[(n, pa.string()) for n in ("was", "fault", "edit", "role", "text")]])


def repair(turns: DataFrame, block_bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """A row for each edit of each conversation (conv_id, turn, role, text): cid (conv_id; nulls ``NO_ID``), turn, was (the role before), fault
    (the first one: blank, duplicate, truncated, or null), edit (D, I, K, R), role (after; null if deleted), text. A
    conversation's rows follow each other in one partition, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(conversation(F.col("conv_id")).alias("cid"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("same", F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))
    order = ["cid", "turn", "role", "same"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    core = F.rtrim("text", F.lit(SPACE))
    rows = write_table(rows.withColumn("blank", core == "").withColumn("ended", F.right(core, F.lit(1)).isin(".", "!", "?")), "turns")
    firsts = rows.groupBy("cid", "same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), 2).when(F.col("new").isNull(), 3).when(~F.col("ended"), 1).otherwise(0)
    initial = F.left(F.col("role"), F.lit(1))
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    kinds = rows.select("cid", "at", number.alias("number"), "blank", "ended").join(firsts, "at", "left")
    kinds = kinds.select("cid", "at", block_id("at", block_bits).alias("id"), number_of(F.col("number"), fault).alias("kind"))
    blocks = kinds.groupBy("cid", "id").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "kind"))).alias("rows"))
    solved = _solved(blocks.select("cid", "id", "at", F.col("rows.kind").alias("kinds")), fan_bits)
    none = lambda t: F.lit(None).cast(t)
    marks = solved.select("cid", "at", F.lit(0).alias("k"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"),
                          "kinds", "state", "edits")
    turns = rows.select("cid", "at", F.lit(1).alias("k"), "turn", "role", "text", none("array<int>").alias("kinds"), none("int").alias("state"),
                        none("string").alias("edits"))
    dealt = marks.unionByName(turns).repartition("cid").sortWithinPartitions("cid", "at", "k")
    return dealt.mapInArrow(_apply, EDIT)


def block_id(at: str, bits: int) -> Column:
    """Partition and block in it, from the row's partition and number in it (33 bits)."""
    inside = F.shiftright(F.col(at).bitwiseAND(F.lit(IN_PART)), bits)
    return F.shiftleft(F.shiftright(at, PART_BITS), PART_BITS).bitwiseOR(inside)


def number_of(initial: Column, fault: Column) -> Column:
    return (initial * 4 + fault).cast("int")


REPORT = ("cid long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


class _Tally:
    """What one conversation's edits add up to."""

    def __init__(self, cid):
        self.cid, self.turns, self.low, self.high, self.faults, self.illegal, self.cost = cid, 0, None, None, dict.fromkeys(FAULTS, 0), 0, 0
        self.before, self.audit, self.hash, self.any = None, [], sha256(), False

    def add(self, turn, was, fault, edit, role, text):
        self.audit.append(edit)
        self.cost += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[edit]
        if was is not None:
            self.faults[fault or ""] += 1
            self.cost += TRUNCATED if fault == "truncated" and edit != "D" else 0
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
            if self.before is not None and self.before + was[:1] not in LEGAL:
                self.illegal += 1
            self.before = was[:1]
        if role is not None:
            self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True

    def row(self):
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.cid, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, self.cost, "".join(self.audit),
                self.hash.hexdigest())


def _report(batches):
    tally = None
    names = [f.split()[0] for f in REPORT.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])
    table = lambda rows: pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(names)}, schema=schema)
    for batch in batches:
        done = []
        for cid, *row in zip(*[c.to_pylist() for c in batch.columns]):
            if tally is None or cid != tally.cid:
                done += [tally.row()] if tally else []
                tally = _Tally(cid)
            tally.add(*row)
        yield table(done)
    if tally:
        yield table([tally.row()])


def report(turns: DataFrame, ids: DataFrame | None = None, block_bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of each conversation of ``ids`` (conv_id;
    default: of ``turns``)."""
    ids = (turns if ids is None else ids).select("conv_id").distinct().withColumn("cid", conversation(F.col("conv_id")))
    with batches_of(turns.sparkSession, 256):
        found = write_table(repair(turns, block_bits, fan_bits).mapInArrow(_report, REPORT), "repaired")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(found, "cid", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))
