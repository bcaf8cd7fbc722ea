import random

import pytest

from quarry.llm import neardup
from quarry.llm.components import components
from tests.conftest import SF_SMALL
from tests.llm.helpers import WORD, awkward, documents, empty


def shingles(text, width):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)}


def brute(rows, width=2, percent=80):
    """{doc_id: component} with null ids as -1, by comparing all pairs."""
    own = [(-1 if i is None else i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            common = len(a & b)
            if a and b and 100 * common >= percent * (len(a) + len(b) - common):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def same(df, width=2, **more):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = neardup.near_duplicates(df, width=width, **more).collect()
    want, no = brute(rows, width), lambda x: -1 if x is None else x
    assert len(got) == len(rows)
    assert {no(r.doc_id): no(r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t, width)) for _, t in rows)


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def family(rng, size, n_words=120, edits=4):
    base = [f"w{rng.randrange(5000)}" for _ in range(n_words)]
    return [edited(base, rng.randrange(edits + 1), rng) for _ in range(size)]


@pytest.mark.parametrize("width", [2, 5])
def test_equals_brute_force(spark, width):
    same(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), width)


def test_awkward_rows(spark):
    same(awkward(spark))
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_large_groups_are_whole(spark, monkeypatch):
    """Groups far beyond a small node: dense ones with outliers, chains, unlike texts that share most minwise tokens' words."""
    monkeypatch.setattr(neardup, "SMALL", 4)
    rng = random.Random(3)
    texts = family(rng, 60) + family(rng, 25, edits=9) + ["same text here again"] * 30
    chain = [f"c{k}" for k in range(100)]
    for k in range(12):  # each is like the next, not like all
        texts.append(" ".join(chain))
        at = rng.randrange(0, 90)
        chain = chain[:at] + [f"d{k}.{i}" for i in range(6)] + chain[at + 6:]
    rng.shuffle(texts)
    same(documents(spark, texts))


def test_branching_to_the_last_level(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "DEEPEST", 1)
    rng = random.Random(5)
    same(documents(spark, [t for _ in range(6) for t in family(rng, 7, edits=14)]), depth=1, trees=6)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 77), (8, 8)]
    got = {r.u: r.v for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 50, 77: 50}


def test_folding_keeps_every_link(spark):
    """A long chain isn't one star after the rounds of a fold; what comes out must still join all that the links join."""
    rng = random.Random(11)
    ids = list(range(200))
    rng.shuffle(ids)
    links = list(zip(ids, ids[1:]))
    join = neardup._Join(documents(spark, ["a b"]), 2, 80, 4, 3, 4)
    whole = spark.createDataFrame(links, "u long, v long")
    for part in (whole.filter("u % 2 = 0"), whole.filter("u % 2 = 1")):
        join.links.append(part)
        labels = {r.u: r.v for r in join._fold().collect()}
        assert join.links == [] and len(labels) == join.labels.count()  # one label a class
    assert {r.u: r.v for r in components(join._known()).collect()} == {i: 0 for i in range(1, 200)}
