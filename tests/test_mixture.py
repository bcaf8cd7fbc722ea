"""W2 with probabilities: the draws against a plain loop."""

import hashlib
import random

import pytest

from quarry.operators import ordered as O
from tests.conftest import rows


def mixed(sizes, probabilities, seed, strategy):
    """(position, source, key) by drawing one source after the other."""
    total, marks, so_far = sum(probabilities.values()), [], 0.0
    for s, p in sorted(probabilities.items()):
        so_far += p / total
        if p > 0:
            marks.append((s, round(so_far * 2**32)))
    marks[-1] = marks[-1][0], 2**32
    out, given, dry, at = [], dict.fromkeys(sizes, 0), set(), 0
    while not (dry if strategy == "first_exhausted" else dry >= set(s for s, _ in marks)):
        x = int(hashlib.md5(f"{seed}:{at}".encode()).hexdigest()[:8], 16)
        s = next(s for s, m in marks if x < m)
        out.append((at, s, given[s] % sizes[s]))
        given[s] += 1
        at += 1
        if given[s] >= sizes[s]:
            dry.add(s)
    return out


@pytest.mark.parametrize("strategy", ["first_exhausted", "all_exhausted"])
@pytest.mark.parametrize("probabilities", [{0: 0.2, 1: 0.5, 2: 0.3}, {0: 1, 1: 0, 2: 7}, {1: 3.0}])
def test_draws_equal_a_loop(spark, strategy, probabilities):
    sizes = {0: 40, 1: 300, 2: 7}
    data = [(s, k) for s, n in sizes.items() for k in range(n)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "source_idx int, doc_id long").repartition(5)
    got = O.interleave_weighted(df, probabilities, 9, strategy=strategy)
    assert rows(got, "pos", "source_idx", "doc_id") == mixed(sizes, probabilities, 9, strategy)


def test_shares_follow_the_probabilities(spark):
    df = spark.range(20_000).selectExpr("cast(id % 2 as int) as source_idx", "id as doc_id")
    got = {r.source_idx: r["count"] for r in O.interleave_weighted(df, {0: 0.8, 1: 0.2}).groupBy("source_idx").count().collect()}
    assert got[0] == 10_000 and abs(got[1] - 2_500) < 200


def test_sources_without_rows(spark):
    df = spark.createDataFrame([(0, 1), (0, 2)], "source_idx int, doc_id long")
    assert O.interleave_weighted(df, {0: 0.5, 1: 0.5}).count() == 0  # exhausted before it starts
    assert O.interleave_weighted(df, {0: 1.0, 1: 0.0}).count() == 2
    assert O.interleave_weighted(df.limit(0), {0: 1.0}, strategy="all_exhausted").count() == 0
    for wrong in ({0: 0.0}, {0: -1.0, 1: 3.0}):
        with pytest.raises(ValueError):
            O.interleave_weighted(df, wrong)
