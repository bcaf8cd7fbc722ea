import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quarry.llm import merkle
from quarry.llm.queries import op11_merkle
from tests.conftest import SF_SMALL
from tests.llm.helpers import DOCS, awkward, empty

NAMES = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, names=NAMES):
    return h(*["-" if row[n] is None else f"{len(str(row[n]).encode())}:{row[n]}" for n in names])


def tree(nodes, arity):
    """(root, [siblings (left, right) of each node, level by level]) by plain loops."""
    proofs, groups, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        parents, below = [], []
        for a in range(0, len(level), arity):
            run = level[a:a + arity]
            for k in range(len(run)):
                for i in groups[a + k]:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            parents.append(h(*run))
            below.append([i for g in groups[a:a + arity] for i in g])
        level, groups = parents, below
    return level[0], proofs


def brute(rows, arity=2, tamper=lambda r: r):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified)."""
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    first = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))
    trees = {x: tree([leaf_of(r) for r in sorted(by[x], key=first)], arity) for x in langs}
    root, tops = tree([trees[x][0] for x in langs], arity) if langs else (None, [])
    out = []
    for x, top in zip(langs, tops):
        for r, proof in zip(sorted(by[x], key=first), trees[x][1]):
            steps, node = proof + top, leaf_of(tamper(r))
            for left, right in steps:
                node = h(left, node, right)
            out.append((r["doc_id"], leaf_of(r), trees[x][0], root, h(*[a + b for a, b in steps]), node, node == root))
    return sorted(out, key=str)


def tampered(r):
    if r["doc_id"] is None or r["n_chars"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7:
        return r
    return {**r, "n_chars": r["n_chars"] + 1}


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = brute(rows, tamper=tampered)
    assert got(op11_merkle(spark, SF_SMALL)) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("arity,levels", [(2, 2), (3, 2)])
def test_tiers_and_arities(spark, arity, levels):
    """Groups of 1 to 70 rows, so of many tiers, and 11 groups, so several tiers above the subroots."""
    rows = [(i, f"t{i}", f"l{g}" if g else None, "s", i) for g, n in enumerate([70, 1, 2, 3, 4, 7, 8, 9, 27, 33, 64]) for i in range(n)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    found = merkle.manifest(df, arity=arity, levels=levels)
    assert got(found) == brute([r.asDict() for r in df.collect()], arity)


def test_awkward_rows(spark):
    df = awkward(spark).withColumn("g", F.lit("x")).withColumn("slot", F.lit(1)).withColumn("node", F.lit("y"))
    assert got(merkle.manifest(df, levels=2)) == brute([r.asDict() for r in df.collect()])
    one = df.filter("doc_id = 4")
    assert got(merkle.manifest(one)) == brute([r.asDict() for r in one.collect()])
    assert merkle.manifest(empty(spark)).collect() == []


def test_every_field_counts(spark):
    rows = spark.createDataFrame([(i, f"text {i}", "en", "s", 5) for i in range(9)], DOCS)
    changed = {"text": F.concat("text", F.lit("!")), "source": F.lit(None).cast("string"), "n_chars": F.col("n_chars") + 1, "lang": F.lit("de"),
               "doc_id": F.col("doc_id") + 1}
    at = {name: i for i, name in enumerate(changed)}
    later = {name: F.when(F.col("doc_id") == at[name], v).otherwise(F.col(name)) for name, v in changed.items()}
    assert {r.doc_id for r in merkle.manifest(rows, later, levels=2).filter("verified").collect()} == set(range(5, 9))
