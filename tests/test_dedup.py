"""First-wins near-dedup (H4-H6) and equality with the sequential walk on sf0.01."""

import numpy as np
import pytest

from quarry.operators import dedup as D
from tests.conftest import SF_MID


def sequential_dedup(texts, num_perm=128, threshold=0.9, seed=1):
    """The reference rule as a plain loop: drop a record if any band matches a *kept* record."""
    bands, rows = D.optimal_bands(threshold, num_perm)
    a, b = (np.array(x, dtype=np.int64) for x in D.perm_params(num_perm, seed))
    index, kept = set(), []
    for i, t in enumerate(texts):
        keys = [(j, k) for j, k in enumerate(D.band_keys_of(D.signature_of(sorted(set(t.split())), a, b), bands, rows))]
        if any(k in index for k in keys):
            continue
        index.update(keys)
        kept.append(i)
    return kept


def members(spark, edges):
    """Bucket memberships from explicit buckets: {bucket: [pos, ...]}."""
    data = [(0, f"b{bk}", p) for bk, ps in edges.items() for p in ps]
    return spark.createDataFrame(data, "band int, key string, pos long")


def test_chain_needs_two_rounds_h4(spark):
    # a(0)-b(1) share bucket x, b(1)-c(2) share bucket y; a and c do not
    dropped = D.peel(members(spark, {"x": [0, 1], "y": [1, 2], "z": [0], "w": [2]}))
    assert sorted(r[0] for r in dropped.collect()) == [1]


def test_dropped_rows_are_not_indexed_h6(spark):
    # b is dropped by a; c only near b -> c kept
    dropped = D.peel(members(spark, {"x": [0, 1], "y": [1, 2]}))
    assert sorted(r[0] for r in dropped.collect()) == [1]


def test_longer_chain_and_hot_bucket_path(spark):
    chain = {f"e{i}": [i, i + 1] for i in range(9)}  # 0-1-2-...-9 path: keep the even ones
    chain["hot"] = [20, 21, 22, 23, 24]
    for hot in (100, 2):
        dropped = sorted(r[0] for r in D.peel(members(spark, chain), hot_bucket_rows=hot).collect())
        assert dropped == [1, 3, 5, 7, 9, 21, 22, 23, 24]


def test_ties_copies_and_empties_h5(spark):
    texts = ["a b c d e f", "a b c d e f", "f e d c b a", "", "   ", "x y z"]
    df = spark.createDataFrame(list(enumerate(texts)), "pos long, text string")
    kept = sorted(r["pos"] for r in D.near_dedup(df, "pos").collect())
    assert kept == [0, 3, 5]
    assert kept == sequential_dedup(texts)


@pytest.mark.parametrize("threshold", [0.9, 0.5])
def test_equals_sequential_walk_on_documents(spark, threshold):
    d = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text")
    local = sorted((r["doc_id"], r["text"]) for r in d.collect())  # test oracle only
    expect = [local[i][0] for i in sequential_dedup([t for _, t in local], threshold=threshold)]
    got = sorted(r["doc_id"] for r in D.near_dedup(d.repartition(5), "doc_id", threshold=threshold).collect())
    assert got == expect


def test_band_parameters():
    assert D.optimal_bands(0.9, 128) == (5, 25)
    assert D.optimal_bands(0.8, 128) == (9, 13)
    assert D.optimal_bands(0.5, 128) == (25, 5)


def test_signature_in_spark_equals_numpy(spark):
    df = spark.createDataFrame([(0, "x y z x"), (1, "")], "pos long, text string")
    got = {r["pos"]: list(r["signature"]) for r in D.minhash(df, with_signature=True).select("pos", "signature").collect()}
    a, b = (np.array(x, dtype=np.int64) for x in D.perm_params(128, 1))
    assert got[0] == D.signature_of(["x", "y", "z"], a, b).tolist()
    assert got[1] == [D.EMPTY_VALUE] * 128
