"""BPE ids (F3) against direct tokenizer calls; C3 / C4 by what defines them."""

import pytest

from quarry.functions import tokenize as TK
from quarry.functions.tokenize import TokenizerSpec, encode
from quarry.plans import corpus as CP
from tests.conftest import SF_SMALL

tokenizers = pytest.importorskip("tokenizers")
SPEC = TokenizerSpec()


@pytest.fixture(scope="module")
def tok():
    return SPEC.load()


def test_bpe_ids_equal_direct_calls(spark, tok):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: list(r["ids"]) for r in encode(d, SPEC, "text", ["doc_id"]).collect()}
    for r in d.collect():
        assert got[r["doc_id"]] == tok.encode(r["text"], add_special_tokens=False).ids


def test_fixed_length_examples_equal_fold(spark, tok):
    eos = SPEC.eos()
    L = 32
    df = spark.createDataFrame([(0, "hello world", None), (1, "", "some content"), (2, "", ""), (3, "x " * 100, None)],
                               "doc_id long, text string, content string")
    got = {r["doc_id"]: (list(r["input_ids"]), list(r["attention_mask"]))
           for r in CP.fixed_length_examples(df, SPEC, L, ["doc_id"]).collect()}

    def fold(text):
        if not text:
            return [eos] * L, [0] * L
        ids = (tok.encode(text, add_special_tokens=False).ids + [eos])[:L]
        ids = ids + [eos] * (L - len(ids))
        return ids, [1 if i != eos else 0 for i in ids]

    assert got[0] == fold("hello world")
    assert got[1] == fold("some content")
    assert got[2] == fold("")
    assert got[3] == fold("x " * 100)


def test_chunked_sequences_are_the_lines_ids(spark, tok):
    """Joined in order, a line's chunks are its ids and one EOS; only a line's last chunk is short."""
    eos = SPEC.eos()
    lines = ["  first line  ", "", "second " * 40, "   ", "third"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_pos long, value string")
    got = CP.chunked_sequences(df, SPEC, seq_length=16, shard_size=5).orderBy("pos").collect()
    assert [(r["pos"], r["shard"], r["local_idx"]) for r in got] == [(i, i // 5, i % 5) for i in range(len(got))]
    for k, line in enumerate(lines):
        own = [list(r["input_ids"]) for r in got if r["line_pos"] == k]
        assert [x for c in own for x in c] == (tok.encode(line.strip()).ids + [eos] if line.strip() else [])
        assert all(len(c) == 16 for c in own[:-1])


def test_special_tokens_follow_the_path(spark, tmp_path):
    """Counts use the tokenizer's default (specials added); fixed-length examples switch them off."""
    import public_tokenizers as P
    from tokenizers import Tokenizer
    from tokenizers.processors import TemplateProcessing

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    s, e = t.token_to_id("<|startoftext|>"), t.token_to_id("<|endoftext|>")
    t.post_processor = TemplateProcessing(single="<|startoftext|> $A <|endoftext|>",
                                          special_tokens=[("<|startoftext|>", s), ("<|endoftext|>", e)])
    path = str(tmp_path / "with_specials.json")
    t.save(path)
    spec = TokenizerSpec(path=path)
    df = spark.createDataFrame([(0, "hello world")], "doc_id long, text string")
    plain = t.encode("hello world", add_special_tokens=False).ids
    assert t.encode("hello world").ids == [s] + plain + [e]
    assert list(encode(df, spec, "text", ["doc_id"]).first()["ids"]) == [s] + plain + [e]  # default: on
    ex = CP.fixed_length_examples(df, spec, 8, ["doc_id"]).first()
    assert list(ex["input_ids"])[:len(plain) + 1] == plain + [e]  # off, then EOS appended
    forced = TokenizerSpec(path=path, add_special_tokens=False)
    assert list(encode(df, forced, "text", ["doc_id"]).first()["ids"]) == plain


def test_a_large_batch_is_encoded_in_slices(tok):
    """Whatever the rows of an Arrow batch, what is encoded at once is bounded by bytes and rows; long, empty and null texts included."""
    import pyarrow as pa

    texts = ["word " * 200, None, "", "été"] * 2_000 + ["long text " * 200_000] + ["tail"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "_text"])
    got = list(TK._encode_fn(SPEC, 1, False)([batch.slice(0, 0), batch]))
    at = 0
    for part in got:
        own = texts[at:at + part.num_rows]
        at += part.num_rows
        assert len(own) == 1 or (len(own) <= TK.SLICE_ROWS and sum(len((t or "").encode()) for t in own) <= TK.SLICE_BYTES)
    assert at == len(texts) and [x for p in got for x in p.column(0).to_pylist()] == list(range(len(texts)))
    ids = [x for p in got for x in p.column(1).to_pylist()]
    assert all(ids[i] == tok.encode(texts[i] or "", add_special_tokens=False).ids for i in (0, 1, 2, 3, 4_001, 8_000, 8_003))
