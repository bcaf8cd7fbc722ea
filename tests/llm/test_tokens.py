from tokenizers import Tokenizer

from quarry.llm import tokens
from quarry.llm.queries import vocabulary
from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward, empty

PATH = vocabulary("word_bpe_49k.json")
ODD = ["", "a", "<|endoftext|> x<|startoftext|>y", "<|ENDOFTEXT|> ABC", "ΣΑΣ σας é é\n\t\x1c b\x85c", "x" * 3000 + "12ab" * 300, "日本語" * 500,
       "don't we'll I'M", "\x0b\x0c a", "İ É.x É.. 's don't. x.'s a.<|endoftext|>", "é́. x", "\x00 \x7f", "a b c　d"]


def library(texts):
    return [len(e) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library_for_any_chunking():
    counter = tokens.Counter(PATH)
    for chunk, overlap in ((65536, 2048), (50, 8), (7, 1), (3, 2)):
        assert counter.counts(ODD, chunk, overlap) == library(ODD)


def test_memo_may_forget(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 3)
    texts = [" ".join(f"w{i}{j}" for j in range(9)) for i in range(5)]
    assert tokens.Counter(PATH).counts(texts, 12, 4) == library(texts)


def test_tables(spark):
    df = awkward(spark)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(df, PATH, ["doc_id"], chunk=1000, overlap=16).collect())
    rows = [(r.doc_id or -1, r.text or "") for r in df.collect()]
    assert got == sorted((i, len(t.encode()), n) for (i, t), n in zip(rows, library([t for _, t in rows])))
    assert tokens.count_tokens(empty(spark), PATH, ["doc_id"]).count() == 0


def test_documents(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, PATH, ["doc_id"], chunk=700, overlap=40).collect()}
    assert [got[r.doc_id] for r in rows] == library([r.text for r in rows])


def test_only_proven_vocabularies():
    assert tokens.stable_at_space(PATH) and not tokens.stable_at_space(vocabulary("byte_bpe_50k.json"))
