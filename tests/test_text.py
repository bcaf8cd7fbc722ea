"""Python string semantics in the JVM (H14, H15) and text resolution."""

from pyspark.sql import functions as F

from quarry.functions import text as T
from tests.conftest import SF_MID


def test_whitespace_split_and_strip_match_python(spark):
    seps = "\x1c\x85\xa0　 \t\n\x0b\x0c\r     "
    samples = [
        "", " ", "a", "  a  b ", "x\x1cy\x85z\xa0w　v", seps + "tok" + seps + "tok2" + seps,
        "​ zero-width is not space", "a b c", "é ü ß",
    ]
    # every BMP code point below the surrogates, as separators between letters
    samples.append("a".join(chr(c) for c in range(0x20, 0xD800, 7)))
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = df.select("i", T.py_split("s").alias("t"), T.py_strip("s").alias("p"),
                    T.whitespace_token_count("s").alias("n")).orderBy("i").collect()
    for r in got:
        s = samples[r["i"]]
        assert list(r["t"]) == s.split()
        assert r["p"] == s.strip()
        assert r["n"] == len(s.split())


def test_token_counts_equal_python_on_documents(spark):
    d = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = d.select("text", T.whitespace_token_count("text").alias("n"), F.size(T.distinct_tokens("text")).alias("k")).collect()
    for r in got:
        assert r["n"] == len(r["text"].split())
        assert r["k"] == len(set(r["text"].split()))


def test_text_fallback_first_nonempty_h15(spark):
    df = spark.createDataFrame([(0, None, "c0"), (1, "", "c1"), (2, " ", "c2"), (3, "t", "c3"), (4, None, None)],
                               "i int, text string, content string")
    got = dict(df.select("i", T.resolve_text_first_nonempty(df)).collect())
    assert got == {0: "c0", 1: "c1", 2: " ", 3: "t", 4: ""}


def test_text_presence_by_schema(spark):
    with_content = spark.createDataFrame([(0, "c")], "i int, content string")
    with_neither = spark.createDataFrame([(0, "x")], "i int, output string")
    with_text = spark.createDataFrame([(0, None, "c")], "i int, text string, content string")
    assert with_content.select(T.resolve_text_presence(with_content)).first()[0] == "c"
    assert with_neither.select(T.resolve_text_presence(with_neither)).first()[0] == ""
    # text present (even null) wins over content, read as ""
    assert with_text.select(T.resolve_text_presence(with_text)).first()[0] == ""


def test_strip_nonblank_lines(spark):
    df = spark.createDataFrame([(1, "  a \n\n 　\n b ")], "doc_id long, text string")
    got = [(r["line_no"], r["line"]) for r in T.strip_nonblank_lines(df, keep=["doc_id"]).collect()]
    assert got == [(0, "a"), (3, "b")]
