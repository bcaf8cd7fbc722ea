"""Token counts of whole texts, by pieces between proven boundaries.

This replaces overlap resynchronisation: no two encodings are aligned. A text is taken in chunks of ``chunk`` characters and cut
at boundaries that are stable by proof, so that counts add up: an ASCII white-space character before a character that is none. No
pre-token, normalisation or special token of the vocabulary reaches across such a place, so the tokens on either side don't depend on what
lies beyond. A chunk ends at a boundary in the ``overlap`` characters that it shares with the next; where they hold none, the
overlap is doubled, at last up to the end of the text. A document of any length is thus counted exactly while
holding the pieces of one chunk.

The library encodes each distinct piece once, and a worker remembers the
count of up to ``MEMO`` pieces. A Latin letter before symbols that end a word is such a boundary too, as the
pre-tokenizer parts letters from symbols; pieces over 256 characters are cut further between ASCII letters and
digits, where it always cuts.

The vocabulary must drop white space (``word_bpe_49k.json`` does); ``stable_at_space`` checks the file.

Edge cases. Null or empty text: 0 bytes, 0 tokens. Repeated rows, null keys: a row each. Empty table: no rows. Extra
columns: ignored. A text without white space: its overlaps widen up to the whole text.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows

MEMO = 300_000
_L, _CUT = "A-Za-zÀ-ÖØ-öø-ɏ", r"""[.,!?;:*&$%#"()]"""
# what white space parts; letters before a run of these symbols that ends the word are a piece of their own
_PIECE = re.compile(rf"[{_L}]+(?={_CUT}+(?:[ \t\n\r]|\Z))|[^ \t\n\r]+")
_INNER = re.compile(r"(?<=[0-9])(?=[A-Za-z0-9])|(?<=[A-Za-z])(?=[0-9])")
_loaded: dict = {}


def stable_at_space(path: str) -> bool:
    """Whether the file's vocabulary is of the kind for which the boundaries above are proven: white space is never
    part of a pre-token, digits stand alone, and no special token takes in its neighbours."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = next((p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"), {})
    return (split.get("invert") is True and split.get("behavior") == "Removed" and "[\\p{N}]|" in split["pattern"]["Regex"]
            and r"[^\s\p{L}\p{N}]+" in split["pattern"]["Regex"]
            and not any(t["lstrip"] or t["rstrip"] or re.search(r"[\s0-9]", t["content"]) for t in spec["added_tokens"]))


def folded(text: str) -> str:
    """Lower case, as the vocabulary's normaliser makes it anyway, where that is the same for each character by itself
    (Latin-1) and no special token can be made or unmade; fewer different pieces."""
    if "<" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class Counter:
    """Counts of one vocabulary in one worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if not stable_at_space(path):
            raise ValueError(f"{path}: no proof that white space is a stable boundary of this vocabulary")
        self.encode = Tokenizer.from_file(path).encode
        self.memo: dict[str, int] = {}

    def _learn(self, pieces: list) -> None:
        cut = {p: [x for x in _INNER.split(p) if x] for p in pieces if len(p) > 256}
        flat = [x for p in pieces for x in cut.get(p, (p,))] if cut else pieces
        counts: list[int] = []
        for at in range(0, len(flat), 1024):  # one text of many pieces; offsets tell whose each token is
            part = flat[at:at + 1024]
            starts = np.cumsum([0] + [len(x) + 1 for x in part[:-1]])
            offsets = self.encode(" ".join(part), add_special_tokens=False).offsets
            owner = np.searchsorted(starts, [o[0] for o in offsets], "right") - 1
            counts += np.bincount(owner.astype(np.int64), minlength=len(part)).tolist()
        if cut:
            it = iter(counts)
            counts = [sum(next(it) for _ in cut.get(p, (p,))) for p in pieces]
        self.memo.update(zip(pieces, counts))

    def know(self, pieces) -> None:
        """Learn what isn't known of ``pieces``; forget the rest when there is too much."""
        wanted = set(pieces)
        if unknown := wanted.difference(self.memo):
            if len(self.memo) + len(unknown) > MEMO:
                self.memo, unknown = {}, wanted
            self._learn(list(unknown))

    def total(self, pieces: list) -> int:
        """Tokens of a list of pieces."""
        self.know(pieces)
        return sum(map(self.memo.__getitem__, pieces))

    def counts(self, texts: list[str], chunk: int, overlap: int) -> list[int]:
        """Tokens of each text; the pieces of the shorter ones are learned together."""
        lists = [None if len(t) > chunk + overlap else _PIECE.findall(folded(t)) for t in texts]
        self.know(itertools.chain.from_iterable(x for x in lists if x))
        have = self.memo  # before a longer text makes the memo forget
        out = [x if x is None else sum(map(have.__getitem__, x)) for x in lists]
        return [self.count(t, chunk, overlap) if n is None else n for t, n in zip(texts, out)]

    def count(self, text: str, chunk: int, overlap: int) -> int:
        text = folded(text)
        done, at, wide = 0, 0, overlap  # [0, at) is counted; at is a proven boundary, or 0
        while True:
            stop = at + chunk + wide
            if stop >= len(text):
                return done + self.total(_PIECE.findall(text, at))
            mine = {m.start(): m.group() for m in _PIECE.finditer(text, at, stop)}
            nxt = at + chunk
            other = [m.start() for m in _PIECE.finditer(text, nxt, stop)]
            common = next((p for p in other if p > nxt and p in mine and text[p - 1] in " \t\n\r"), None)
            if common is None:
                wide *= 2
                continue
            done += self.total([w for p, w in mine.items() if p < common])
            at, wide = common, overlap


def _counts(path: str, chunk: int, overlap: int):
    def run(batches):
        if path not in _loaded:
            _loaded[path] = Counter(path)
        counter = _loaded[path]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n = counter.counts(texts.to_pylist(), chunk, overlap)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return run


def count_tokens(df: DataFrame, path: str, keys: list[str], text: str = "text", chunk: int = 1 << 16, overlap: int = 1 << 11) -> DataFrame:
    """``keys``, n_bytes (UTF-8) and n_tokens of every row."""
    arrow_rows(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(*keys, F.octet_length(body).cast("long").alias("n_bytes"), body.alias("n_tokens"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_counts(path, chunk, overlap), f"{fields}, n_tokens long")
