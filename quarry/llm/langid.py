"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features: the n-grams (1 to ``ORDER`` characters) of the lower-cased text, hashed into ``2^BITS`` buckets; the value of a
bucket is its share of the text's n-grams times the bucket's inverse document frequency, times ``SCALE``. The weights are
learned by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties, so most buckets keep weight 0. Then a
temperature is chosen on a part of the sample that wasn't learned from, to make the scores honest probabilities.

The model is fitted on a sample of ``sample`` labelled rows: of each language the ``EACH`` rows whose keys have the least md5 (fewer
where ``sample`` doesn't hold as many of all languages, at least one), and then those with the least md5 of all. With more than
``sample`` languages it holds one row of each. The document frequencies are those of all rows that may be learned from. What the
driver gets is a row's distinct buckets and counts, made on the executors: at most ``sample`` x ``2^BITS`` small numbers, in
practice about a thousand a row.

Prediction needs no bucket counts: the score of a class is the mean over all n-grams of the text of that n-gram's
weight, so a text of any length is summed block by block.

Edge cases. Null text, or no letters: ``und``, score 0. Repeated rows, null keys: a row each. Rows without a language
are predicted but not learned from. No labelled row at all: every text is ``und``. One language: that one, score 1.
Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, write_table

ORDER, BITS, SCALE = 3, 16, 10.0
EACH = 50  # rows of each language in the sample
BLOCK = 1 << 18
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def buckets(text: str):
    """The hashed n-grams of a lower-cased text, in blocks of positions."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    mul = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
    for at in range(0, len(codes), BLOCK):
        part = codes[at:at + BLOCK + ORDER - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(ORDER):
            own = len(part) - n
            if own <= 0:
                break
            h = (h[:own] if n else h) * mul[3] + part[n:] * mul[n]
            h ^= h >> np.uint32(15)
            yield ((h[:BLOCK] * mul[0]) >> np.uint32(32 - BITS)).astype(np.int64)


def _bag(batches):
    for batch in batches:
        at, counts = [], []
        for text in batch.column("text"):
            own = np.zeros(1 << BITS, np.int32)
            for b in buckets(text.as_py().lower()):
                own += np.bincount(b, minlength=1 << BITS).astype(np.int32)
            hit = np.flatnonzero(own)
            at.append(hit.astype(np.int32).tobytes())
            counts.append(own[hit].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(at, pa.binary()), pa.array(counts, pa.binary())], ["lang", "at", "counts"])


def _frequencies(batches):
    """How many of the texts have each bucket; the last entry counts the texts."""
    total = np.zeros((1 << BITS) + 1, np.int64)
    for batch in batches:
        for text in batch.column(0):
            own = np.zeros(1 << BITS, bool)
            for b in buckets(text.as_py().lower()):
                own[b] = True
            total[:-1] += own
            total[-1] += 1
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["i", "n"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """Labels, the weight of each bucket for each label (idf and scale included), biases and the temperature."""

    def __init__(self, labels, table, bias, temperature):
        self.labels, self.table, self.bias, self.temperature = labels, table, bias, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.labels)), 0
        for b in buckets(text.lower()):
            for k in range(len(self.labels)):
                total[k] += self.table[k][b].sum(dtype=np.float64)
            n += len(b)
        p = _softmax((total / max(n, 1) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1,
        epochs: int = 3, held: int = 5, frequencies: np.ndarray | None = None) -> Model:
    """FTRL-proximal over rows of (language, buckets, counts); every ``held``-th row calibrates the temperature. ``frequencies``: the
    number of texts with each bucket and, last, of all texts; without it those of the rows."""
    labels = sorted({r[0] for r in rows})
    k = len(labels)
    if k < 2:
        return Model(labels, np.zeros((k, 1 << BITS), np.float32), np.zeros(k), 1.0)
    if frequencies is None:
        frequencies = np.zeros((1 << BITS) + 1)
        for _, at, _ in rows:
            frequencies[np.asarray(at, np.int64)] += 1
        frequencies[-1] = len(rows)
    idf = np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])) + 1
    data = []
    for lang, at, counts in rows:
        at, counts = np.asarray(at, np.int32), np.asarray(counts, np.float64)
        if len(at):
            data.append((labels.index(lang), at, (SCALE * idf[at] * counts / counts.sum()).astype(np.float32)))
    # the last bucket of the state is the bias, whose feature is always 1 and which isn't penalised by l1
    z, n = np.zeros(((1 << BITS) + 1, k)), np.zeros(((1 << BITS) + 1, k))
    learn = [d for i, d in enumerate(data) if i % held] or data
    check = [d for i, d in enumerate(data) if not i % held]

    def weights(at):
        zz, penalty = z[at], np.where(at == 1 << BITS, 0.0, l1)[:, None]
        return np.where(np.abs(zz) <= penalty, 0.0, -(zz - np.sign(zz) * penalty) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for label, at, x in learn:
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)[:, None]
            w = weights(at)
            p = _softmax((x * w).sum(0))
            p[label] -= 1
            g = x * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    table = (w[:-1] * idf[:, None] * SCALE).T.astype(np.float32).copy()
    model = Model(labels, table, w[-1], 1.0)
    if check:
        logits = np.array([(x[:, None] * w[at]).sum(0) + w[-1] for _, at, x in check])
        truth = np.array([d[0] for d in check])
        grid = np.exp(np.linspace(np.log(0.2), np.log(5), 60))
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 4000) -> Model:
    """A model fitted on ``sample`` of the rows for which ``learn`` holds and language and text aren't null."""
    arrow_rows(docs.sparkSession)
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    place = F.struct(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("o"), F.xxhash64(F.col(text).cast("string")).alias("th"))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), place.alias("place"))
    total = np.zeros((1 << BITS) + 1)
    for r in rows.select("text").mapInArrow(_frequencies, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        total[r["i"]] = r["n"]
    ranked = rows.select("lang", "place", F.row_number().over(Window.partitionBy("lang").orderBy("place")).alias("rank")).filter(F.col("rank") <= EACH)
    first = write_table(ranked, "langid-first")  # at most EACH narrow rows a language
    languages = first.select("lang").distinct().count()
    each = min(EACH, max(1, sample // max(languages, 1)))
    last = first.filter(F.col("rank") <= each).groupBy("lang").agg(F.max("place").alias("last"))
    share = min(1.0, 1.25 * (sample + 200) / max(total[-1], 1))  # few more rows than needed are ordered
    own = F.col("place") <= F.col("last")
    near = F.conv(F.substring("place.o", 1, 8), 16, 10).cast("long") <= int(share * 2**32)
    chosen = rows.join(F.broadcast(last), "lang").select("lang", "text", "place", own.alias("own")).filter(F.col("own") | near) \
        .orderBy(F.desc("own"), "place", "lang", "text").limit(max(sample, languages))
    bags = chosen.select("lang", "text", "place").repartition(16, "place").select("lang", "text").mapInArrow(_bag, "lang string, at binary, counts binary")
    # a part at a time, as buffers of four bytes a number
    got = sorted((r["lang"], bytes(r["at"]), bytes(r["counts"])) for r in bags.toLocalIterator())
    return fit([(lang, np.frombuffer(at, np.int32), np.frombuffer(counts, np.int32)) for lang, at, counts in got], frequencies=total)


def _predictor(model: Model):
    def run(batches):
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score (0 to 1) of every whole text."""
    arrow_rows(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).cast("string").alias("lang_pred"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_predictor(model), f"{fields + ', ' if fields else ''}lang_pred string, score double")
