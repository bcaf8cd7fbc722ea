"""Benchmark decontamination by edit distance: CGK embedding, bit-sampling LSH, exact verification.

Items and documents are sequences of words (A-Z folded). A document is contaminated by an item of m words when some
stretch of it is within ``floor(max_edits * m)`` word insertions, deletions and substitutions of the item.

The CGK embedding walks over a window of m words: at step j it outputs the word under it and moves on or not by
a random bit of (repetition, j, word). Walks over two texts of small edit distance meet again soon, so edit distance
becomes Hamming distance. Each of ``repeats`` repetitions samples two steps of an item's embedding; a window collides
with the item when its own walk puts out the same words at these steps. Steps are sampled among an item's
rarer words, by counts over all documents, so few windows of other texts collide. A collision is confirmed by the exact
edit distance of the item to the best stretch around the window.

All windows (every start in every document) are covered, yet few are walked: a window can only collide where the word of
the first sampled step stands within as many words of its start, so only the windows before such words are walked.

Items of fewer than ``MIN_ITEM`` words have too few steps to sample. At less than one edit they meet the documents' word n-grams of
their length; if ``max_edits`` allows them edits, they are held against every document.

Scale: two passes over the texts, no shuffle of documents. Items are sent to the executors in parts of at most
``PART`` items, each with its own pass, so what is broadcast is bounded.

Edge cases. Null texts: no words. Items without words: not searched. Repeated rows, null keys: as any row; equal items
each match. Empty tables: no rows. A text of any length: words are hashed in blocks. Extra columns: ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, fresh
from quarry.llm.hashing import buffer_of, mix, words

PART, MIN_ITEM = 20_000, 5
_SEED = np.uint64(0xA0761D6478BD642F)


def _seeds(repeats: int, steps: int) -> np.ndarray:
    """An odd 64-bit multiplier for each repetition and step."""
    key = np.arange(repeats, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(steps, dtype=np.uint64)[None, :]
    return mix(key * np.uint64(0x9E3779B97F4A7C15) + np.full(key.shape, _SEED)) | np.uint64(1)


def _bit(symbols: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return ((symbols * seeds) >> np.uint64(63)).astype(np.int64)


def embed(item: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The place in ``item`` that a walk with these seeds stands at, for each step until it leaves the item."""
    at, out = 0, []
    while at < len(item) and len(out) < len(seeds):
        out.append(at)
        at += int(_bit(item[at:at + 1], seeds[len(out) - 1:len(out)])[0])
    return np.array(out, np.int64)


def _grams(text: np.ndarray, m: int) -> np.ndarray:
    """A hash of every ``m`` words in a row."""
    n = max(len(text) - m + 1, 0)
    out = text[:n].copy()
    for k in range(1, m):
        out = mix(out * _SEED) + text[k:k + n]
    return out


class Index:
    """The sampled steps of all items: by first word, entries (item, rep, step 1, step 2, word 2)."""

    def __init__(self, items: list[tuple], counts: dict[int, int], repeats: int):
        rng = np.random.default_rng(11)
        self.items, rows = items, []
        self.seeds = _seeds(repeats, 4 * max((len(own) for _, own in items), default=1))
        self.short: dict[int, list[tuple[int, int]]] = {}  # by length, (hash, item) of the items under MIN_ITEM words
        for number, (_, own) in enumerate(items):
            if len(own) < MIN_ITEM:
                self.short.setdefault(len(own), []).append((int(_grams(own, len(own))[0]), number))
                continue
            order = sorted(range(len(own)), key=lambda i: (counts.get(int(own[i]), 0), i))
            rare = np.zeros(len(own), bool)
            rare[order[: max(4, len(own) // 3)]] = True
            for rep in range(repeats):
                walk = embed(own, self.seeds[rep])
                first = np.flatnonzero(np.diff(walk, prepend=-1))  # the step at which the walk comes to a place
                first = first[rare[walk[first]]]
                if len(first) < 2:
                    continue
                a, b = np.sort(rng.choice(first, 2, replace=False))
                rows.append((int(own[walk[a]]), number, rep, int(a), int(b), int(own[walk[b]])))
        rows.sort()
        cols = list(zip(*rows)) if rows else [[]] * 6
        self.word = np.array(cols[0], np.uint64)
        self.item, self.rep, self.step1, self.step2 = (np.array(c, np.int64) for c in cols[1:5])
        self.word2 = np.array(cols[5], np.uint64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.word >> np.uint64(44)).astype(np.int64)] = True

    def collisions(self, text: np.ndarray, firsts: np.ndarray) -> set[tuple[int, int, int]]:
        """(text number, item, window start) of the windows that collide with an item. ``text`` holds the words of several
        texts, text i from ``firsts[i]``."""
        hits = np.flatnonzero(self.filter[(text >> np.uint64(44)).astype(np.int64)])
        low, high = np.searchsorted(self.word, text[hits], "left"), np.searchsorted(self.word, text[hits], "right")
        hits, low, n = hits[high > low], low[high > low], (high - low)[high > low]
        owner = np.searchsorted(firsts, hits, "right") - 1
        out: set[tuple[int, int, int]] = set()
        for at in range(0, len(hits), 1024):  # bounded memory for texts with very many hits
            k = n[at:at + 1024]
            entry = np.repeat(low[at:at + 1024], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            end, doc = np.repeat(hits[at:at + 1024], k), np.repeat(owner[at:at + 1024], k)
            span = self.step1[entry] + 1  # starts from which the place can be reached in time
            back = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
            entry, end, doc = np.repeat(entry, span), np.repeat(end, span), np.repeat(doc, span)
            keep = end - back >= firsts[doc]
            entry, end, doc = entry[keep], end[keep], doc[keep]
            pos = end - back[keep]
            start, step, waiting = pos, 0, []
            while len(entry):  # walk to the first sampled step; drop what passes its place or can't reach it
                left = self.step1[entry] - step
                fine = (pos <= end) & (end - pos <= left) & (left >= 0)
                if not fine.all():
                    entry, end, doc, start, pos, left = entry[fine], end[fine], doc[fine], start[fine], pos[fine], left[fine]
                on = left > 0
                if not on.any():
                    break
                pos = pos + np.where(on, _bit(text[pos], self.seeds[self.rep[entry], step]), 0)
                # what has arrived waits; its steps go on below
                arrived = ~on
                if arrived.any():
                    waiting.append((entry[arrived], doc[arrived], start[arrived], pos[arrived]))
                    entry, end, doc, start, pos = entry[on], end[on], doc[on], start[on], pos[on]
                step += 1
            waiting.append((entry, doc, start, pos))
            self._finish(text, firsts, *map(np.concatenate, zip(*waiting)), out)
        return out

    def _finish(self, text, firsts, entry, doc, start, pos, out) -> None:
        """Walk on from the first sampled step to the second and compare its word."""
        step, last = self.step1[entry].copy(), firsts[doc + 1]
        while len(entry):
            alive = pos < last
            there = alive & (step == self.step2[entry])
            same = there & (text[np.where(alive, pos, 0)] == self.word2[entry])
            out.update(zip(doc[same].tolist(), self.item[entry[same]].tolist(), start[same].tolist()))
            go = alive & ~there
            entry, doc, start, pos, step, last = entry[go], doc[go], start[go], pos[go], step[go], last[go]
            pos = pos + _bit(text[pos], self.seeds[self.rep[entry], step])
            step = step + 1

    def matches(self, text: np.ndarray, firsts: np.ndarray, max_edits: float) -> list[tuple]:
        """(text number, item number, first word, words, edits) of the best stretch of each item in each text."""
        by: dict[tuple[int, int], list[int]] = {}
        for doc, item, start in self.collisions(text, firsts):
            by.setdefault((doc, item), []).append(start)
        out = []
        for (doc, item), starts in sorted(by.items()):
            own = self.items[item][1]
            most = int(max_edits * len(own))
            best, spans = None, []
            for start in sorted(starts):
                # the stretch may begin before the window: the walk may have begun inside the item
                low, high = max(int(firsts[doc]), start - len(own) // 2 - most), min(int(firsts[doc + 1]), start + len(own) + most)
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = high
                else:
                    spans.append([low, high])
            for low, high in spans:
                part = text[low:high]
                if np.isin(own, part).sum() < len(own) - most:  # every word that is missing costs an edit
                    continue
                edits, a, b = nearest(own, part)
                if edits <= most and (best is None or edits < best[4]):
                    best = (doc, item, low + a - int(firsts[doc]), b - a, edits)
            if best:
                out.append(best)
        return out + self.short_matches(text, firsts, max_edits)

    def short_matches(self, text: np.ndarray, firsts: np.ndarray, max_edits: float) -> list[tuple]:
        """``matches`` of the items under ``MIN_ITEM`` words; of equal stretches the first."""
        out = []
        for m, pairs in sorted(self.short.items()):
            most = int(max_edits * m)
            if most:
                for doc in range(len(firsts) - 1):
                    for _, item in pairs:
                        edits, a, b = nearest(self.items[item][1], text[firsts[doc]:firsts[doc + 1]])
                        if edits <= most:
                            out.append((doc, item, a, b - a, edits))
                continue
            pairs = sorted(pairs)
            codes, grams = np.array([c for c, _ in pairs], np.uint64), _grams(text, m)
            low, high = np.searchsorted(codes, grams, "left"), np.searchsorted(codes, grams, "right")
            at = np.flatnonzero(high > low)
            doc = np.searchsorted(firsts, at, "right") - 1
            inside = at + m <= firsts[doc + 1]
            at, doc = at[inside], doc[inside]
            # the first place of each n-gram in each text
            _, once = np.unique(np.stack([doc, low[at]]), axis=1, return_index=True)
            for k in np.sort(once):
                i, d = int(at[k]), int(doc[k])
                out += [(d, item, i - int(firsts[d]), m, 0) for _, item in pairs[low[i]:high[i]]
                        if np.array_equal(self.items[item][1], text[i:i + m])]
        return out


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to a stretch of ``text``, and the stretch [a, b)."""
    n = len(text)
    cost, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    line = np.arange(n + 1)
    for i, word in enumerate(item):
        change = cost[:-1] + (text != word)
        new, origin = cost + 1, begin.copy()
        better = change <= new[1:]
        new[1:] = np.where(better, change, new[1:])
        origin[1:] = np.where(better, begin[:-1], origin[1:])
        least = np.minimum.accumulate(new - line)  # insertions run to the right
        source = np.maximum.accumulate(np.where(new - line == least, line, 0))
        cost, begin = least + line, origin[source]
    b = int(cost.argmin())
    return int(cost[b]), int(begin[b]), b


def _word_arrays(texts: list) -> list[np.ndarray]:
    hashes, _, _, firsts = words(*buffer_of(pa.array(texts, pa.string())))
    return [hashes[a:b] for a, b in zip(firsts[:-1], firsts[1:])]


def _counting(vocabulary: np.ndarray):
    def run(batches):
        total = np.zeros(len(vocabulary), np.int64)
        member = np.zeros(1 << 20, bool)
        member[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            hashes, _, _, _ = words(*buffer_of(batch.column(0)))
            hashes = hashes[member[(hashes >> np.uint64(44)).astype(np.int64)]]
            at = np.searchsorted(vocabulary, hashes)
            at = np.minimum(at, len(vocabulary) - 1)
            total += np.bincount(at[vocabulary[at] == hashes], minlength=len(vocabulary))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["i", "n"])

    return run


def _searching(index: Index, max_edits: float):
    def run(batches):
        for batch in batches:
            hashes, _, _, firsts = words(*buffer_of(batch.column(1)))
            found = index.matches(hashes, firsts, max_edits)
            at = [f[0] for f in found]
            rows = [(index.items[i][0], len(index.items[i][1]), start, n, edits) for _, i, start, n, edits in found]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, pa.int64()) for c in cols],
                [batch.schema.names[0], "item_id", "item_words", "start_word", "match_words", "edits"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", max_edits: float = 0.2,
                 repeats: int = 24) -> DataFrame:
    """``(key, item_id, item_words, start_word, match_words, edits)``: the best match of each item in each document."""
    spark = docs.sparkSession
    arrow_rows(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    parts = max(1, -(-items.count() // PART))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id long, item_words long, start_word long, match_words long, edits long"
    result = None
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        own = [(r["item_id"], a) for r, a in zip(rows, _word_arrays([r["text"] for r in rows])) if len(a)]
        if not own:
            continue
        vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *[a for _, a in own if len(a) >= MIN_ITEM]]))
        seen = [] if not len(vocabulary) else (docs.select(F.col(text).cast("string").alias("t")).mapInArrow(_counting(vocabulary), "i long, n long")
                .groupBy("i").agg(F.sum("n").alias("n")).collect())
        index = Index(own, {int(vocabulary[r["i"]]): r["n"] for r in seen}, repeats)
        found = docs.select(key, F.col(text).cast("string").alias(fresh(docs, "t")[0])).mapInArrow(_searching(index, max_edits), schema)
        result = found if result is None else result.unionByName(found)
    return spark.createDataFrame([], schema) if result is None else result


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no item; all columns. Rows that share a key with a contaminated one go too."""
    name = fresh(docs, "bad")[0]
    bad = contaminated(docs, benchmark, key, text).select(F.col(key).alias(name)).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad[name]), "left_anti")
