import random

import numpy as np
import pyarrow as pa

from quarry.llm import linedup
from quarry.llm.hashing import buffer_of
from tests.conftest import SF_SMALL
from tests.llm.helpers import WORD, awkward, documents, empty


def prose(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(4000)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


def run(df):
    return {r.doc_id: r for r in linedup.dedup_lines(df).collect()}


def brute(rows):
    """The kept text of each (doc_id, text), by grouping the chunks' bytes themselves."""
    seen, pairs = {}, {}
    cut = []
    for key, text in rows:
        data, offsets = buffer_of(pa.array([text], pa.string()))
        _, number, code, a, b, size, _, keep = linedup.chunks(data, offsets)
        found = [(data[x:y].tobytes(), int(h)) if k else None for x, y, h, k in zip(a, b, code, keep)]
        cut.append((data, a, found, size))
        for i, c in enumerate(found):
            if c is not None:
                seen.setdefault(c, []).append((key, i))
            if i and c is not None and found[i - 1] is not None:
                pairs.setdefault((found[i - 1], c), []).append((key, i))
    out = {}
    for (key, text), (data, a, found, size) in zip(rows, cut):
        parts, at, gone = [], 0, False
        again = [c is not None and min(seen[c]) != (key, i) for i, c in enumerate(found)]

        def joined(i):  # chunks i - 1 and i stand side by side earlier too
            return again[i - 1] and again[i] and min(pairs[found[i - 1], found[i]]) != (key, i)

        def run_words(i):
            low = high = i
            while low > 0 and joined(low):
                low -= 1
            while high + 1 < len(again) and joined(high + 1):
                high += 1
            return sum(size[low:high + 1])

        for i, c in enumerate(found):
            if again[i] and run_words(i) >= linedup.MIN_RUN:
                parts.append(data[at:a[i]].tobytes())
                at = a[i + 1] if i + 1 < len(found) else len(data)
                gone = True
        parts.append(data[at:].tobytes())
        rest = b"".join(parts).decode()
        out[key] = (rest if rest.strip() else "") if gone else text
    return out


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got, want = run(docs), brute(rows)
    assert {i: r.text for i, r in got.items()} == want
    for i, t in rows:
        assert len(WORD.findall(t)) - len(WORD.findall(want[i])) == got[i].removed_words


def test_passages_are_cut_and_clean_texts_stay(spark):
    rng = random.Random(1)
    passages = [prose(rng, 60) for _ in range(5)]
    clean = [prose(rng, 150) for _ in range(20)]
    inside = [prose(rng, 70) + " " + passages[i % 5] + " " + prose(rng, 70) for i in range(20)]
    lines = ["\n".join([prose(rng, 40), passages[i % 5], prose(rng, 8)]) for i in range(20)]
    got = run(documents(spark, clean + inside + lines))
    for i in range(20):
        assert got[i].text == clean[i]
    for p in passages:
        assert sum(p in r.text for r in got.values()) == 1
    for i in range(45, 60):  # a passage that is a line goes whole where an earlier one is
        assert not any(w in got[i].text.split() for w in passages[i % 5].split()[:3])


def test_copies_lose_all_but_the_first(spark):
    rng = random.Random(2)
    text = "\n".join(prose(rng, n) for n in (5, 60, 3, 3, 3, 90))
    got = run(documents(spark, [text, text, "x" + text[1:], text]))
    assert got[0].text == text and got[1].text == got[3].text == ""
    assert got[1].removed_words == 164
    kept = linedup.clean(documents(spark, [text, text])).collect()
    assert [r.doc_id for r in kept] == [0] and len(kept[0]) == 5


def test_boundaries_resist_shifts():
    rng = random.Random(4)
    body = prose(rng, 400)
    codes = lambda t: set(linedup.chunks(*buffer_of(pa.array([t])))[2].tolist())
    own = codes(body)
    for head in ("a", "one two three four five", prose(rng, 33)):
        assert len(own & codes(head + " " + body)) >= len(own) - 2


def test_chance_hashes_are_told_apart(spark, monkeypatch):
    rng = random.Random(6)
    texts = [prose(rng, 80) for _ in range(4)]
    texts.append(texts[0])
    monkeypatch.setattr(linedup, "WRAP", 1 << 62)  # a chunk each
    real = linedup.chunks

    def weak(data, offsets):
        out = list(real(data, offsets))
        out[2] = np.zeros_like(out[2])
        return tuple(out)

    df = documents(spark, texts)
    import quarry.llm.linedup as module

    def weakly(work):  # workers are reused, so each leaves the module as it was
        def run(batches):
            module.chunks = weak
            try:
                yield from work(batches)
            finally:
                module.chunks = real

        return run

    def rows(batches):
        yield from weakly(module_rows)(batches)

    def proof(bitmap):
        return weakly(module_proof(bitmap))

    module_rows, module_proof = linedup._chunk_rows, linedup._evidence
    monkeypatch.setattr(linedup, "_chunk_rows", rows)
    monkeypatch.setattr(linedup, "_evidence", proof)
    got = run(df)
    assert [got[i].text for i in range(4)] == texts[:4] and len(got[4].text) <= len(texts[4])


def test_awkward_rows(spark):
    df = awkward(spark)
    out = linedup.dedup_lines(df)
    assert out.columns[: len(df.columns)] == df.columns and len(out.columns) == len(df.columns) + 3
    rows = out.collect()
    assert len(rows) == 11
    text = {r.doc_id: r.text for r in rows}
    assert text[0] is None and text[1] == "" and text[2] == " \n\t " and text[7] == "12345 !!"
    assert linedup.clean(df).columns == df.columns
    assert linedup.dedup_lines(empty(spark)).count() == 0


def test_passages_of_short_lines_between_short_lines_are_cut(spark):
    rng = random.Random(8)
    line = lambda n: prose(rng, n)
    around = lambda: [line(rng.randint(5, 20)) for _ in range(6)]
    for shape in ((18, 18, 18), (24, 24, 24), (15, 15, 15, 15), (6, 20, 9, 17, 8), (10, 10, 10, 10, 10, 10)):
        passage = [line(n) for n in shape]
        heads, tails = [around() for _ in range(4)], [around() for _ in range(4)]
        got = run(documents(spark, ["\n".join([*h, *passage, *t]) for h, t in zip(heads, tails)]))
        assert got[0].removed_words == 0
        for i in range(1, 4):
            assert got[i].text.split("\n") == heads[i] + tails[i] and got[i].removed_words == sum(shape)


def test_passages_of_tiny_lines_are_cut(spark):
    rng = random.Random(9)
    tiny = lambda count, n: [prose(rng, n) for _ in range(count)]
    for count, n in ((60, 1), (30, 2), (18, 3)):
        passage = tiny(count, n)
        docs = ["\n".join(tiny(9, 2) + passage + tiny(9, 2)) for _ in range(20)]
        got = run(documents(spark, docs))
        assert got[0].text == docs[0] and all(0.5 * count * n < got[i].removed_words <= count * n for i in range(1, 20))


def test_a_short_repeated_line_stays(spark):
    rng = random.Random(10)
    docs = ["\n".join([prose(rng, 12), "read more about this in our weekly letter", prose(rng, 15)]) for _ in range(10)]
    got = run(documents(spark, docs))
    assert all(got[i].text == docs[i] for i in range(10))


def test_a_text_put_together_of_others_lines_stays(spark):
    rng = random.Random(11)
    lines = [prose(rng, 9) for _ in range(3)]
    whole = "\n".join(lines)
    got = run(documents(spark, [*lines, whole, whole]))
    assert [got[i].text for i in range(4)] == [*lines, whole]  # the lines stand side by side there for the first time
    assert got[4].text == "" and got[4].removed_words == 27


def test_a_common_line_inside_a_passage_goes_with_it(spark):
    rng = random.Random(12)
    common = prose(rng, 8)
    passage = "\n".join([prose(rng, 7), common, prose(rng, 7)])
    heads = [prose(rng, 30) for _ in range(4)]
    got = run(documents(spark, [f"{heads[0]}\n{common}\n{prose(rng, 30)}", *[f"{h}\n{passage}\n{h[::-1]}" for h in heads[1:]]]))
    assert got[0].removed_words == got[1].removed_words == 0
    for i in (2, 3):
        assert got[i].text == f"{heads[i]}\n{heads[i][::-1]}" and got[i].removed_words == 22
