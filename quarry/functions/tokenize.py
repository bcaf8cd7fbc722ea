"""text -> token ids with a pluggable tokenizer, in Arrow batches (``mapInArrow``).

A ``TokenizerSpec`` is shipped to the workers by value and instantiated once per Python worker
process (cached), then ``encode_batch`` runs over each Arrow batch. The whitespace tokenizer needs no
Python at all: its ids are the JVM expression of :mod:`quarry.functions.text`.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

_CACHE: dict = {}


def _default_bpe_path() -> str | None:
    try:
        import public_tokenizers  # installed vocabularies, no network

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return None


@dataclass(frozen=True)
class TokenizerSpec:
    kind: str = "byte_bpe"  # byte_bpe (a tokenizers JSON file) | word_length (JVM; ids = lengths of the
    #                         whitespace tokens, reproducible in SQL)
    path: str | None = None
    eos_token: str = "<|endoftext|>"
    eos_id: int | None = None  # resolved from the vocabulary when None
    pad_id: int | None = None  # None -> EOS (the reference's fallback)
    add_special_tokens: bool | None = None  # None: the path's default (counts and text-file shards: on;
    #                                          fixed-length examples: off), as the reference calls the tokenizer

    def resolved_path(self) -> str:
        p = self.path or _default_bpe_path()
        if not p or not os.path.exists(p):
            raise FileNotFoundError("no tokenizer file: pass TokenizerSpec(path=...)")
        return p

    def load(self):
        key = (self.kind, self.path)
        tok = _CACHE.get(key)
        if tok is None:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(self.resolved_path())
            _CACHE[key] = tok
        return tok

    def eos(self) -> int:
        if self.eos_id is not None:
            return self.eos_id
        if self.kind == "word_length":
            raise ValueError("the word_length tokenizer needs an explicit eos_id")
        return int(self.load().token_to_id(self.eos_token))

    def pad(self) -> int:
        return self.eos() if self.pad_id is None else self.pad_id


SLICE_BYTES, SLICE_ROWS = 1 << 20, 512  # of the texts that are encoded at once; the library needs some hundred bytes a token meanwhile


def _slices(texts):
    """(first, rows) of the stretches of an Arrow column of texts that hold at most ``SLICE_BYTES`` and ``SLICE_ROWS``, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = min(int(np.searchsorted(ends, before + SLICE_BYTES, "right")), at + SLICE_ROWS)
        yield at, max(stop, at + 1) - at
        at = max(stop, at + 1)


def _encode_fn(spec: TokenizerSpec, n_keys: int, add_special_tokens: bool):
    def run(batches):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tok = spec.load()
        for batch in batches:  # as many rows as the session says: whatever that is, a slice of them is encoded and sent on
            for part in (batch.slice(*s) for s in _slices(batch.column(n_keys))):
                texts = [t if t is not None else "" for t in part.column(n_keys).to_pylist()]
                ids = [np.array(e.ids, np.int64) for e in tok.encode_batch_fast(texts, add_special_tokens=add_special_tokens)]
                at = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keys], lists], [*part.schema.names[:n_keys], "ids"])

    return run


def encode(df: DataFrame, spec: TokenizerSpec, text: str = "text", keys: list[str] | None = None,
           out: str = "ids", add_special_tokens: bool = True) -> DataFrame:
    """``keys + [out array<bigint>]`` for every row. Put filters and projections before this call:
    Catalyst cannot push them through the Python boundary. ``spec.add_special_tokens``, when set,
    overrides the caller's default."""
    keys = keys if keys is not None else [c for c in df.columns if c != text]
    if spec.kind == "word_length":  # no Python: the ids are a JVM expression
        from quarry.functions.sequences import word_length_ids
        from quarry.functions.text import py_split

        return df.select(*keys, word_length_ids(py_split(text)).alias(out))
    narrow = df.select(*keys, F.col(text).alias("_text"))
    schema = ST.StructType([f for f in narrow.schema.fields if f.name != "_text"]
                           + [ST.StructField("ids", ST.ArrayType(ST.LongType()))])
    specials = add_special_tokens if spec.add_special_tokens is None else spec.add_special_tokens
    res = narrow.mapInArrow(_encode_fn(spec, len(keys), specials), schema)
    return res.withColumnRenamed("ids", out) if out != "ids" else res


def token_count(df: DataFrame, spec: TokenizerSpec, text: str = "text", keys: list[str] | None = None,
                out: str = "n_tokens") -> DataFrame:
    """A1 with a BPE tokenizer: ``len(encode(text))``."""
    enc = encode(df, spec, text, keys, "_ids")
    return enc.withColumn(out, F.size("_ids").cast("long")).drop("_ids")

