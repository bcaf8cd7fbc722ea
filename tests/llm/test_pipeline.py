import zlib

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.helpers import DOCS, documents, empty
from tests.llm.test_linedup import brute as lines_brute
from tests.llm.test_neardup import brute as near_brute


def test_stages_agree_with_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        if name == "pack":
            rows = out.collect()
            assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
            break
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        before, after = ({r.doc_id: r for r in x.collect()} for x in (docs, out))
        if name == "language":
            assert set(after) == set(before)
        elif name == "lines":
            want = lines_brute([(i, r.text) for i, r in before.items()])
            assert {i: r.text for i, r in after.items()} == {i: t for i, t in want.items() if t or not before[i].text}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near_duplicates":
            parts = near_brute([(i, r.text) for i, r in before.items()], width=5)
            assert set(after) == {i for i, c in parts.items() if i == c}
        docs = corpus_pipeline.write_table(out, "test-stage")


def test_decisions(spark):
    """Junk, copies, near copies, leaks: each goes in its stage; clean documents pass every stage."""
    base = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").first().text
    stages = dict(corpus_pipeline.STAGES)
    own = [r.text for r in base.filter("lang = 'en'").orderBy("doc_id").limit(3).collect()]
    long = " ".join(f"w{zlib.crc32(str(i).encode()) % 9999}" for i in range(200))
    near = documents(spark, [long, long.replace("w", "W", 1), long + " x", own[0]])
    assert sorted(r.doc_id for r in stages["near_duplicates"](spark, near, SF_SMALL).collect()) == [0, 3]
    leak = documents(spark, [own[1] + " " + item + " " + own[2], own[0]])
    assert [r.doc_id for r in stages["benchmark"](spark, leak, SF_SMALL).collect()] == [1]
    mixed = base.select(*DOCS.fieldNames()).unionByName(documents(spark, ["1234 5678", None, "..."], ids=[-1, -2, -3]))
    kept = {r.doc_id for r in stages["language"](spark, mixed, SF_SMALL).select("doc_id").collect()}
    assert kept == {r.doc_id for r in base.select("doc_id").collect()}


def test_empty(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF_SMALL).count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert rows and all(a == b for a, b in seen.values())
