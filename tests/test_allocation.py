"""Allocation of the target (A3): against a loop that closes what is full, round by round."""

import random
from fractions import Fraction

import pytest

from quarry.operators.allocation import allocate, water_fill


def fill(rows, quota):
    """{name: part} of [(name, limit, weight)], by closing full rows until none is."""
    rows = [(n, max(l or 0, 0), w) for n, l, w in rows]
    out, left, alive = {}, min(quota, sum(l for _, l, _ in rows)), list(rows)
    while alive:
        level = Fraction(left, sum(w for *_, w in alive))
        full = [r for r in alive if r[1] <= level * r[2]]
        if not full:
            out.update((n, int(level * w)) for n, _, w in alive)
            break
        for n, l, _ in full:
            out[n] = l
            left -= l
        alive = [r for r in alive if r not in full]
    rest = min(quota, sum(l for _, l, _ in rows)) - sum(out.values())
    for n, l, _ in sorted(rows):
        if rest and out[n] < l:
            out[n] += 1
            rest -= 1
    return out


def test_water_fill_equals_the_loop(spark):
    rng = random.Random(3)
    groups, data = {}, []
    for g in range(120):
        big = 10 ** rng.choice((1, 2, 13))
        rows = [(f"s{i:02d}", rng.choice((None, -1, 0, rng.randrange(big), rng.randrange(big), big)), rng.randint(1, 9)) for i in range(rng.randint(1, 9))]
        quota = rng.choice((0, rng.randrange(4 * big), sum(max(l or 0, 0) for _, l, _ in rows)))
        groups[g] = fill(rows, quota)
        data += [(g, *r, quota) for r in rows]
    df = spark.createDataFrame(data, "g int, name string, limit long, weight int, quota long")
    got = water_fill(df, ["g"], "name", "limit", "weight", "quota", "got")
    assert got.columns == [*df.columns, "got"]
    assert {(r.g, r.name): r.got for r in got.collect()} == {(g, n): v for g, parts in groups.items() for n, v in parts.items()}


def test_shortfalls_go_to_sources_with_room(spark):
    src = spark.createDataFrame([("a", "math", 50, None), ("b", "math", 900, 100), ("c", "web", 1_000, None), ("d", "web", 20, None), ("e", None, 7, None),
                                 (None, "web", 0, None)], "source string, part string, available long, declared long")
    caps = lambda target: {r.source: r.cap for r in allocate(src, target, {"math": 80, "web": 20}, declared="declared").collect()}
    assert caps(100) == {"a": 40, "b": 40, "c": 10, "d": 10, "e": 0, None: 0}
    assert caps(500) == {"a": 50, "b": 100, "c": 330, "d": 20, "e": 0, None: 0}  # math is 250 short of its 400
    assert caps(10_000) == {"a": 50, "b": 100, "c": 1_000, "d": 20, "e": 0, None: 0}
    assert caps(0) == {"a": 0, "b": 0, "c": 0, "d": 0, "e": 0, None: 0}
    assert allocate(src.limit(0), 10, {"math": 1}).count() == 0
    for target, shares in ((-1, {"math": 1}), (5, {}), (5, {"math": 0})):
        with pytest.raises(ValueError):
            allocate(src, target, shares)


def _sources(spark, tmp_path, sizes):
    """A JSON source of one-word documents for each (part, documents, declared cap, weight)."""
    from pyspark.sql import functions as F
    from quarry.sources.registry import SourceSpec

    specs = []
    for i, (part, n, cap, weight) in enumerate(sizes):
        path = str(tmp_path / f"s{i}")
        spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"w{i}_"), F.col("id")).alias("text")).write.parquet(path)
        specs.append(SourceSpec(name=f"s{i}", path=path, part=part, cap_tokens=cap, weight=weight))
    return specs


def test_registry_with_allocated_caps(spark, tmp_path):
    from quarry.plans import corpus as CP
    from quarry.sources.registry import SourceSpec

    reg = _sources(spark, tmp_path, [("core", 10, None, 1), ("core", 100, 20, 1), ("rest", 200, None, 1), ("rest", 200, None, 3),
                                     (None, 50, None, 1), ("rest", 0, 7, 1)])
    caps = lambda **kw: [s.cap_tokens for s in CP.allocated(spark, reg, {"core": 80, "rest": 20}, **kw)]
    assert caps(target=110) == [10, 20, 20, 60, 0, 0]  # the core gives 30 of its 88, the rest takes over
    assert caps(target=10) == [4, 4, 1, 1, 0, 0]  # 8 in two; 2 as 0.5 to 1.5, rounded down, one more to the first
    assert caps(percent=100) == [10, 20, 200, 200, 0, 0]
    assert caps(target=0) == [0] * 6
    gone = [*reg, SourceSpec(name="gone", path=str(tmp_path / "gone"), part="rest")]
    assert CP.allocated(spark, gone, {"core": 80, "rest": 20}, 110, on_error="skip")[-1].cap_tokens == 0
    for kw in ({}, {"target": 1, "percent": 1}, {"target": -1}):
        with pytest.raises(ValueError):
            CP.allocated(spark, reg, {"core": 80, "rest": 20}, **kw)


def test_command_line_shares_out_a_target(spark, tmp_path):
    import json

    from quarry.__main__ import main

    reg = _sources(spark, tmp_path, [("core", 30, None, 1), ("rest", 30, None, 1)])
    listed = tmp_path / "registry.json"
    listed.write_text(json.dumps([{"name": s.name, "path": s.path, "part": s.part} for s in reg]))
    assert main(["build-text-shards", str(listed), str(tmp_path / "out"), "--target-tokens", "20", "--shares", "core=3,rest=1"]) == 0
    texts = [r.text for r in spark.read.schema("text string").json(f"{tmp_path}/out/*").collect()]
    # 15 and 5 by the caps; the interleave ends with the shorter source
    assert sorted(texts) == sorted([f"w0_{i}" for i in range(5)] + [f"w1_{i}" for i in range(5)])
    with pytest.raises(SystemExit):
        main(["build-text-shards", str(listed), str(tmp_path / "x"), "--target-tokens", "20"])
