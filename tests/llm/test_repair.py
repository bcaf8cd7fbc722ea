import random
import re
import zlib
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from quarry.llm import repair
from quarry.llm.queries import op12_repair
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]")
ROW = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 1:
            text = ""
        elif case == 2:
            text = re.sub("[.!?]", "", text)
        elif case == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) by a forward search that keeps the least of each state; rows: (role, text, fault)."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def close(best):  # insertions
        while True:
            more = {}
            for q, (cost, audit, out) in best.items():
                n = after[q]
                x = cost + 5, audit + "I", out + [names[n] + ":"]
                if n not in best or x[:2] < best[n][:2]:
                    more[n] = min(x, more.get(n, x))
            if not more:
                return best
            best = {**best, **more}

    best = close({"": (0, "", [])})
    for role, text, fault in rows:
        new = {}

        def put(q, x):
            new[q] = min(x, new.get(q, x))

        for q, (cost, audit, out) in best.items():
            put(q, (cost + 2, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                more, n = 5 if fault == "truncated" else 0, after[q]
                if role[:1] == n or (role[:1] == "s" and q == ""):
                    put(role[:1], (cost + more, audit + "K", out + [f"{role}:{text}"]))
                put(n, (cost + 1 + more, audit + "R", out + [f"{names[n]}:{text}"]))
        best = close(new)
    return min(best[q] for q in ("", "a") if q in best)


def brute(rows, ids):
    out = []
    for conv in ids:
        own = [(turn, role, text) for c, turn, role, text in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            core = WORD.findall(text)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, texts = cheapest([(r, t, f) for (_, r, t), f in zip(own, faults)])
        out.append((conv, gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                    sha256("\n".join(texts).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(damaged(rows), {r[0] for r in rows})
    assert got(op12_repair(spark, SF_SMALL)) == want
    assert {x for r in want for x in r[7]} == set("DKR")  # two neighbours deleted are cheaper than one turn inserted


def random_rows(rng, conv, n):
    texts = ["Yes.", "No!", "Why?", "cut off", " \t", "", "two\nlines. ", "Ends with a break.\n", "ça va…"]
    return [(conv, rng.choice([k, k, k + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
             rng.choice(texts + [f"Text {rng.random()}."] * 8 + [None])) for k in range(n)]


@pytest.mark.parametrize("block_bits,fan_bits", [(8, 10), (2, 2)])
def test_random_conversations(spark, block_bits, fan_bits):
    """Long and short ones, null ids, turns, roles and texts; small blocks give many tiers, a long conversation has most rows."""
    rng = random.Random(block_bits)
    rows = [r for conv, n in [(None, 7), (1, 150), *[(c, rng.randrange(1, 14)) for c in range(2, 50)]] for r in random_rows(rng, conv, n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ROW).repartition(4).withColumn("at", F.lit(1)).withColumn("id", F.lit("x")).withColumn("kinds", F.lit(2))
    damage = damaged(rows)
    assert sorted(map(str, damage)) == sorted(str(tuple(r)) for r in repair.damage(df).collect())
    assert got(repair.report(repair.damage(df), df, block_bits, fan_bits)) == brute(damage, {r[0] for r in rows})


def test_real_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 1, "user", "Hello."), (1, 2, "user", "Go on."), (2, 5, "assistant", "")]
    out = {c: [] for c in (1, 2)}
    for r in repair.repair(spark.createDataFrame(rows, ROW)).collect():
        out[r.cid].append((r.edit, r.was, r.role, r.text, r.fault))
    assert out[1] == [("K", "system", "system", "Be kind.", None), ("K", "user", "user", "Hello.", None), ("D", "user", None, "Hello.", "duplicate"),
                      ("R", "user", "assistant", "Go on.", None)]
    assert out[2] == [("D", "assistant", None, "", "blank")]


def test_empty(spark):
    none = spark.createDataFrame([], ROW)
    assert repair.report(none).collect() == []
    ids = spark.createDataFrame([(5,), (None,)], "conv_id long")
    assert got(repair.report(none, ids)) == brute([], [5, None])


def test_layers_are_exact():
    """Prices of the auction equal distances by relaxation, on random layers with cycles and nodes without a way."""
    rng = random.Random(4)
    for _ in range(500):
        arcs = [[(rng.randrange(0, 9), rng.randrange(4), False, "") for _ in range(rng.randrange(3))] for _ in range(4)]
        for own in arcs:
            own += [(rng.randrange(1, 6), rng.randrange(4), True, "") for _ in range(rng.randrange(3))]
        after = tuple(rng.choice([rng.randrange(30), repair.FAR]) for _ in range(4))
        want = [repair.FAR] * 4
        for _ in range(20):
            want = [min([repair.FAR, *[c + (want[n] if same else after[n]) for c, n, same, _ in own]]) for own in arcs]
        assert repair.auction(arcs, after) == want
