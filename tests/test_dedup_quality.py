"""Dedup quality on sf0.01 against brute force (test only; the library never emits pairs).

Exact Jaccard of the token sets for every pair whose sizes allow J >= 0.9 (size filter), versus the
LSH candidates (pairs sharing a band) and the kept set.
"""

import numpy as np

from quarry.operators import dedup as D
from tests.conftest import SF_MID


def test_quality_against_exact_jaccard(spark):
    d = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text")
    docs = sorted((r["doc_id"], frozenset(r["text"].split())) for r in d.collect())
    bands, rows = D.optimal_bands(0.9, 128)
    a, b = (np.array(x, dtype=np.int64) for x in D.perm_params(128, 1))
    keys = {i: set(enumerate(D.band_keys_of(D.signature_of(list(s), a, b), bands, rows))) for i, s in docs}
    by_size = sorted(docs, key=lambda t: len(t[1]))
    high, exact_same = [], []
    for x in range(len(by_size)):
        i, si = by_size[x]
        for y in range(x + 1, len(by_size)):
            j, sj = by_size[y]
            if len(si) < 0.9 * len(sj):
                break
            inter = len(si & sj)
            union = len(si | sj) or 1
            jac = inter / union if (si or sj) else 1.0
            if jac >= 0.9:
                high.append((min(i, j), max(i, j), jac))
            if si == sj:
                exact_same.append((min(i, j), max(i, j)))
    cand = lambda i, j: bool(keys[i] & keys[j])
    # identical token sets always collide in every band
    assert all(cand(i, j) for i, j in exact_same)
    # near pairs collide with the S-curve probability 1 - (1 - s^r)^b; count the expected hits
    expect = sum(1 - (1 - jac ** rows) ** bands for _, _, jac in high)
    got = sum(cand(i, j) for i, j, _ in high)
    assert got >= 0.5 * expect - 3
    kept = {r["doc_id"] for r in D.near_dedup(d, "doc_id").collect()}
    # no two kept documents share a band; identical token sets are never both kept
    kept_keys = [k for i in kept for k in keys[i]]
    assert len(kept_keys) == len(set(kept_keys))
    assert not any(i in kept and j in kept for i, j in exact_same)
