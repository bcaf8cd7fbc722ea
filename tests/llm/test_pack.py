import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import pack
from quarry.llm.queries import vocabulary
from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward, documents, empty

PATH, RANKS = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")


def packed(df, **more):
    return pack.pack_documents(df, PATH, ranks=RANKS, pattern=public_tokenizers.PATTERN, **more)


def check(rows, texts, length):
    """Pieces are a partition of each document's ids; sequences are gapless and within their length."""
    library = Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for key, text in texts.items():
        ids, at = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4"), 0
        copies = sum(r.start == 0 for r in pieces[key])
        for r in sorted(pieces[key], key=lambda r: r.start)[::copies]:
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return sequences


def test_awkward_rows(spark):
    df = awkward(spark)
    check(pack.piece_table(packed(df)).collect(), {r.doc_id: r.text for r in df.collect()}, 1024)
    assert pack.piece_table(packed(empty(spark))).count() == 0


@pytest.mark.parametrize("merge", [4096, 5])
def test_merging_in_rounds(spark, monkeypatch, merge):
    monkeypatch.setattr(pack, "MERGE", merge)
    df = documents(spark, [f"word{i} " * (i % 23) for i in range(300)]).repartition(7, "doc_id")
    rows = pack.piece_table(packed(df, length=64, open_windows=2)).collect()
    check(rows, {r.doc_id: r.text for r in df.collect()}, 64)


def test_little_padding(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = pack.piece_table(packed(df)).collect()
    sequences = check(rows, {r.doc_id: r.text for r in df.collect()}, 1024)
    used = sum(n for parts in sequences.values() for _, n in parts)
    assert used / (1024 * len(sequences)) > 0.9


def test_fast_ids_equal_the_library():
    encoder = pack.Encoder(PATH, RANKS, public_tokenizers.PATTERN)
    odd = ["", " ", "a  b\n\n c\t", "don't I'LL 's", "é È ÿ ɏ ¡¿", "<|endoftext|> x", "日本", "x\x0by\x0cz\x1c\x85 ", "“quoted” – dash…", "1234½ ²³", "​ zero", "\xa0nbsp\xad"]
    library = Tokenizer.from_file(PATH)
    for t in odd:
        assert encoder.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids
