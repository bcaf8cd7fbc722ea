import random

import numpy as np
import pytest
import xxhash

from quarry.llm import simhash
from quarry.llm.queries import op13_simhash
from tests.conftest import SF_SMALL
from tests.llm.helpers import WORD, awkward, empty


def print_of(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(ids, prints, distance=3):
    """The least id reachable from each, by comparing all pairs."""
    prints, label = np.array(prints, np.uint64), np.array(ids)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= distance
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label.tolist()
        label = new


def check(df):
    rows = [(-1 if r.doc_id is None else r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    prints = [print_of(t) for _, t in rows]
    want = sorted((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, brute([i for i, _ in rows], prints)))
    no = lambda x: -1 if x is None else x
    assert sorted((no(r.doc_id), r.fingerprint, no(r.component_id)) for r in simhash.near_duplicates(df).collect()) == want
    return want


def test_query_equals_brute_force(spark):
    want = check(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    assert sorted(tuple(r) for r in op13_simhash(spark, SF_SMALL).collect()) == want


def test_awkward_rows(spark):
    check(awkward(spark))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_blocks_of_a_long_text(monkeypatch):
    text = " ".join(f"Wort{i * i % 1013}" for i in range(3000))
    want = print_of(text)
    monkeypatch.setattr(simhash, "_BLOCK", 50)
    assert simhash.fingerprint(text) == want == simhash.fingerprint("\n " + text + "\t")


def connected(spark, prints, limit):
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, c long").repartition(6)
    found = [(r.u, r.v) for r in simhash.links(df, limit=limit).collect()]
    assert all((prints[u] ^ prints[v]).bit_count() <= 3 for u, v in found)
    label = list(range(len(prints)))
    for _ in range(len(prints)):
        changed = False
        for u, v in found:
            low = min(label[u], label[v])
            changed |= label[u] != low or label[v] != low
            label[u] = label[v] = low
        if not changed:
            break
    assert label == brute(range(len(prints)), prints)
    return found


@pytest.mark.parametrize("limit", [4096, 8])
def test_dense_balls_chains_and_common_values(spark, limit):
    """A ball around one fingerprint, chains of links, values of parts that nearly all share, and random ones. With a small limit most buckets
    are divided down to the last bits."""
    rng = random.Random(limit)
    flip = lambda p, n: p ^ sum(1 << b for b in rng.sample(range(64), n))
    center = rng.getrandbits(64)
    prints = [center] + [flip(center, rng.randrange(1, 7)) for _ in range(400)]
    at = rng.getrandbits(64)
    for _ in range(60):
        prints.append(at := flip(at, 3))
    shared = rng.getrandbits(48) << 16
    prints += [shared | rng.getrandbits(16) for _ in range(300)]
    prints += [rng.getrandbits(64) for _ in range(200)]
    found = connected(spark, prints, limit)
    assert len(found) < 12 * len(prints)  # not all pairs of the ball


def test_allocation():
    """The cheapest thresholds, as by trying all; the sum is kept."""
    rng = np.random.default_rng(1)
    costs = [[np.zeros(50)] + list(np.cumsum(rng.integers(0, 100, (4, 50)), 0).astype(float)) for _ in range(4)]
    got = simhash.allocate(costs, 3)
    assert (got.sum(1) == 0).all()
    options = [(a, b, c, -a - b - c) for a in range(-1, 4) for b in range(-1, 4) for c in range(-1, 4) if -1 <= -a - b - c <= 3]
    for q in range(50):
        price = lambda t: sum(costs[i][t[i] + 1][q] for i in range(4))
        assert price(got[q]) == min(price(t) for t in options)


def test_counts_within_a_distance():
    rng = np.random.default_rng(2)
    held = np.zeros(1 << 16, np.int64)
    own = rng.integers(0, 1 << 16, 500)
    np.add.at(held, own, 1)
    near = simhash.within(held, 3)
    for v in (0, int(own[0]), 77):
        d = np.bitwise_count(own ^ v)
        assert [near[t][v] for t in range(4)] == [(d <= t).sum() for t in range(4)]


def test_correlated_bits_fall_together():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (4000, 4))
    bits = np.concatenate([base[:, [k % 4]] ^ (rng.random((4000, 1)) < 0.05) for k in range(64)], 1).astype(float)
    parts = simhash.correlated_parts(bits.T @ bits, len(bits))
    assert sorted(sorted(p) for p in parts) == [list(range(k, 64, 4)) for k in range(4)]
