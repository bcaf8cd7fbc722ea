import math
from collections import Counter

import pytest

from quarry.llm import quality
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.helpers import WORD, awkward, documents, empty


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


def failed(b):
    return b[0] < 50 or 100 * b[4] > 50 * b[0]


def columns(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


ODD = ["a a a a a", "a b c a b c", "x\ny\nx\n\n\nx y", "a b a b a b a", "  lead\x0b\x0ctail\r\n", "one", "\n\n", "é#é *** $%&|<>",
       "a b c", "p q r s p q r t q r s"]


def test_base_columns(spark):
    df = documents(spark, ODD)
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    for i, text in enumerate(ODD):
        assert columns(got[i]) == base(text), text


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = quality.quality(df).collect()
    assert sorted(columns(r) for r in rows) == sorted(base(r.text) for r in df.collect())
    assert all(r.base_failed == failed(columns(r)) and not (r.kept and r.base_failed) for r in rows)
    assert quality.quality(empty(spark)).count() == 0


def test_verdicts_against_labels(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    rows = quality.quality(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert columns(r) == base(text[r.doc_id]) and r.base_failed == failed(base(text[r.doc_id]))
        if labels.get(r.doc_id) == 1 and not r.base_failed:
            assert r.kept
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0 and not r.base_failed]
    assert sum(bad) <= 0.2 * len(bad) + 1


def test_distances_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    text = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    totals = {}
    for t, lang in text.values():
        totals.setdefault(lang, Counter()).update(WORD.findall(t))
    tops = {lang: sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality.TOP] for lang, c in totals.items()}

    def js(p, q):
        part = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0
        return math.sqrt(max(0, sum(part(a, b) + part(b, a) for a, b in zip(p, q)) / 2))

    for r in quality.quality(docs).collect():
        own = Counter(WORD.findall(text[r.doc_id][0]))
        n, found = max(r.n_words, 1), []
        for lang, top in tops.items():
            p, q = [own[w] / n for w, _ in top], [c / sum(totals[lang].values()) for _, c in top]
            found.append((js([*p, 1 - sum(p)], [*q, 1 - sum(q)]), lang))
        assert r.word_distance == pytest.approx(min(found)[0], abs=1e-6) and r.language == min(found)[1]


def test_every_language_has_a_reference(spark):
    """More languages than any fixed number: the rare ones are held against their own words and character classes."""
    import random

    rng = random.Random(5)
    texts, langs = [], []
    for k in range(90):
        own = [f"{chr(0x4E00 + k)}{j}" if k % 3 else f"w{k}x{j}" for j in range(30)]
        for _ in range(3 if k < 70 else 2):
            texts.append(" ".join(rng.choices(own, range(30, 0, -1), k=120 if k < 70 else 60)))
            langs.append(f"l{k:02}")
    texts.append(" ".join(rng.choice("0123456789") + chr(0x3041 + rng.randrange(80)) + str(j) for j in range(80)))  # shares no word
    langs.append(None)
    rows = {r.doc_id: r for r in quality.quality(documents(spark, texts, langs=langs)).collect()}
    for i, lang in enumerate(langs[:-1]):
        assert rows[i].language == lang and rows[i].kept
    assert not any(r.base_failed for r in rows.values())
    alone = rows[len(texts) - 1]
    assert alone.language is not None and alone.word_distance > 0.9 and not alone.kept
