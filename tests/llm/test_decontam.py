import random

import numpy as np

from quarry.llm import decontam
from tests.conftest import SF_SMALL
from tests.llm.helpers import WORD, awkward, documents, empty


def brute(item, text):
    """Least word edit distance of the item to a stretch of the text."""
    a, b = ([w.lower() for w in WORD.findall(t)] for t in (item, text))
    cost = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(cost[j - 1] + (x != y), cost[j] + 1, new[-1] + 1))
        cost = new
    return min(cost), len(a)


def items(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, doc_id string")


def test_equals_brute_force_on_the_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r.edits for r in decontam.contaminated(docs, bench).collect()}
    own = bench.collect()
    shared = lambda a, b: len(set(a.split()) & set(b.split())) >= 0.6 * len(set(a.split()))
    want = {}
    for d in docs.collect():
        for i in own:
            if shared(i.text, d.text):
                edits, n = brute(i.text, d.text)
                if edits <= int(0.2 * n):
                    want[d.doc_id, i.item_id] = edits
    assert got == want


def test_edited_passages(spark):
    rng = random.Random(1)
    word = lambda: f"{rng.choice('abcdef')}{min(rng.randrange(3000), rng.randrange(3000))}"
    bench = [" ".join(word() for _ in range(rng.randrange(14, 60))) for _ in range(60)]
    texts, truth = [], []
    for k, item in enumerate(bench):
        words = item.split()
        for _ in range(int(0.15 * len(words))):
            at = rng.randrange(len(words))
            words[at:at + 1] = rng.choice([[], [word()], [words[at], word()]])
        texts.append(" ".join([word() for _ in range(80)] + words + [word() for _ in range(30)]).upper())
        truth.append((k, k))
    texts += [" ".join(word() for _ in range(200)) for _ in range(60)]
    rows = decontam.contaminated(documents(spark, texts), items(spark, bench)).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert found <= set(truth) and len(found) >= 59
    for r in rows:
        edits, n = brute(bench[r.item_id], texts[r.doc_id])
        assert (r.edits, r.item_words) == (edits, n)
        stretch = texts[r.doc_id].split()[r.start_word:r.start_word + r.match_words]
        assert brute(bench[r.item_id], " ".join(stretch))[0] == edits


def test_items_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PART", 1)
    texts = ["a b c d e f g h", "p q r s t u v w"]
    got = decontam.contaminated(documents(spark, texts + ["x " + texts[0] + " y " + texts[1]]), items(spark, texts)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 0), (1, 1), (2, 0), (2, 1)]


def test_awkward_rows(spark):
    df = awkward(spark)
    bench = items(spark, [None, "", "same text twice over and a line", "same text twice over and a line", "two words"])
    got = sorted((r.doc_id, r.item_id, r.edits) for r in decontam.contaminated(df, bench).collect())
    assert got == [(5, 2, 0), (5, 3, 0), (6, 2, 0), (6, 2, 0), (6, 3, 0), (6, 3, 0)]
    left = decontam.clean(df, bench)
    assert left.columns == df.columns and left.count() == 8
    assert decontam.contaminated(empty(spark), bench).count() == 0
    assert decontam.contaminated(df, bench.limit(0)).count() == 0


def test_nearest():
    a = np.array([1, 2, 3, 4], np.uint64)
    assert decontam.nearest(a, np.array([9, 1, 2, 4, 9], np.uint64))[0] == 1
    assert decontam.nearest(a, np.array([9, 1, 2, 3, 4], np.uint64)) == (0, 1, 5)
    assert decontam.nearest(a, np.array([], np.uint64))[0] == 4


def test_short_items_match_exact_copies(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(3))
    bench = [" ".join(word() for _ in range(n)) for n in (1, 1, 2, 2, 3, 3, 4, 4)] + ["zz", "b1 zz", "", "one two three four five six"]
    bench.append(bench[4])
    texts = [" ".join(word() for _ in range(rng.randrange(1, 120))).upper() for _ in range(60)] + ["", "zz", "b1", "zz b1", "b1\nzz", None]
    for own in (bench, [b for b in bench if len(b.split()) < 5]):
        got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(documents(spark, texts), items(spark, own)).collect()}
        want = {}
        for d, t in enumerate(texts):
            have = (t or "").lower().split()
            for i, b in enumerate(own):
                m = len(b.split())
                places = [k for k in range(len(have) - m + 1) if have[k:k + m] == b.split()]
                if m and places:
                    want[d, i] = (places[0], m, 0)
        assert {k: (r.start_word, r.match_words, r.edits) for k, r in got.items()} == want and len(want) > 50
    left = decontam.clean(documents(spark, texts), items(spark, ["b1 zz"])).collect()
    assert len(left) == len(texts) - 1
    loose = decontam.contaminated(documents(spark, ["x p q s y", "k l"]), items(spark, ["p q r s"]), max_edits=0.25).collect()
    assert [(r.doc_id, r.edits) for r in loose] == [(0, 1)]
