"""Every operator accepts an empty input and returns an empty (or all-zero) result."""

from quarry.operators import dedup as D
from quarry.operators import ordered as O
from quarry.operators import report as R
from quarry.operators import shards as SH


def test_empty_inputs(spark):
    docs = spark.createDataFrame([], "source string, source_idx int, doc_id long, n_tokens long, text string")
    assert O.token_budget(docs, 10).count() == 0
    assert O.row_cap(docs, 3).count() == 0
    assert O.interleave(docs).count() == 0
    assert O.global_position(docs, "doc_id").count() == 0
    assert D.near_dedup(docs, "doc_id").count() == 0
    assert SH.token_shards(docs, 10, "doc_id", mode="balanced").count() == 0
    assert SH.token_shards(docs, 10, "doc_id", mode="reset").count() == 0
    seqs = spark.createDataFrame([], "grp long, pos long, ids array<bigint>")
    assert SH.pack_sequences(seqs, "ids", 4, 0, 9, "pos").count() == 0
    assert O.ordered_position(docs, ["source_idx", "doc_id"]).count() == 0
    assert O.interleave(docs, strategy="all_exhausted").count() == 0
    m = R.mixture_profile(docs).collect()  # Spark's rollup of no rows has no total row either
    assert len(m) <= 1 and all(not r["docs"] for r in m)
