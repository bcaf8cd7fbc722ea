import numpy as np
from pyspark.sql import functions as F

from quarry.llm import langid
from quarry.llm.queries import held_out, op7_langid
from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward, documents, empty


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = op7_langid(spark, SF_SMALL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(own) > 20
    assert np.mean([r.lang_pred == r.lang for r in own]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_nothing_is_learned_from_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    wrong = docs.withColumn("lang", F.when(held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = (langid.train(d, ~held_out(), sample=60) for d in (docs, wrong))
    assert a.labels == b.labels and np.array_equal(a.table, b.table) and a.temperature == b.temperature


def test_awkward_rows(spark):
    model = langid.train(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), F.lit(True), sample=100)
    rows = langid.identify(awkward(spark), model, ["doc_id", "lang", "id"], "text").collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert len(rows) == 11 and rows[0].id == "id"
    for i in (0, 1, 2, 7):
        assert got[i] == ("und", 0.0)
    assert all(got[i][0] != "und" for i in (3, 4, 5, 6, 8, None))
    assert langid.identify(empty(spark), model, ["doc_id"]).count() == 0


def test_few_labels(spark):
    none = langid.train(documents(spark, ["a b"], langs=[None]), F.lit(True))
    assert none.predict("some text") == ("und", 0.0)
    one = langid.train(documents(spark, ["a b", None], langs=["en", "en"]), F.lit(True))
    assert one.predict("some text") == ("en", 1.0) and one.predict("12") == ("und", 0.0)
    assert langid.train(empty(spark), F.lit(True)).labels == []


def test_blocks_and_sparsity(monkeypatch):
    whole = [np.concatenate(x) for x in [list(langid.buckets("déjà vu " * 40))]][0]
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert sorted(whole) == sorted(np.concatenate(list(langid.buckets("déjà vu " * 40))))
    rng = np.random.default_rng(0)
    rows = [("ab"[i % 2], [int(x) for x in {i % 2 + 2, *rng.integers(10, 900, 5)}], None) for i in range(200)]
    model = langid.fit([(a, b, [1] * len(b)) for a, b, _ in rows], l1=1.0)
    assert (model.table == 0).mean() > 0.98 and (model.table[:, 2] != 0).all()


def test_rare_languages_are_in_the_sample(spark, monkeypatch):
    texts = [("the cat and the dog", "le chat et le chien")[i % 2] + f" {i}" for i in range(400)] + ["kato kaj hundo estas", "hundo kaj kato iras"]
    langs = [("en", "fr")[i % 2] for i in range(400)] + ["eo", "eo"]
    docs, seen = documents(spark, texts, langs=langs), {}
    real = langid.fit

    def fit(rows, **more):
        seen.update(rows=rows, **more)
        return real(rows, **more)

    monkeypatch.setattr(langid, "fit", fit)
    for sample in (20, 2):  # the second holds fewer rows than there are languages
        model = langid.train(docs, F.lit(True), sample=sample)
        assert model.labels == ["en", "eo", "fr"] and len(seen["rows"]) == max(sample, 3)
        want = np.zeros((1 << langid.BITS) + 1)
        for t in texts:
            want[np.unique(np.concatenate(list(langid.buckets(t))))] += 1
        want[-1] = len(texts)
        assert np.array_equal(seen["frequencies"], want)
    alike = documents(spark, texts, ids=[None] * len(texts), langs=langs)
    assert langid.train(alike, F.lit(True), sample=20).labels == ["en", "eo", "fr"]
