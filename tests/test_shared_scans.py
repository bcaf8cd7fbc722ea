"""Sources that differ in their predicate only are read by one scan of their table."""

import warnings

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans import corpus as CP
from quarry.session import scratch_path
from quarry.sources import registry as REG
from tests.conftest import rows

ROWS = [(1, "a", "en", "one two"), (2, "b", "en", "x"), (3, "a", "de", None), (4, None, "en", "y z"), (5, "c", None, ""), (5, "c", None, "")]


@pytest.fixture(scope="module")
def table(spark):
    path = scratch_path(spark, "test-shared")
    spark.createDataFrame(ROWS, "doc_id long, source string, lang string, text string").write.parquet(path)
    return path


def registry(table):
    return [REG.SourceSpec("a", table, predicate=F.col("source") == "a"),
            REG.SourceSpec("none", table, predicate="source = 'zz'"),
            REG.SourceSpec("en", table, predicate="lang = 'en'"),
            REG.SourceSpec("c", table, predicate=F.col("source").isin("c"))]


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("PushedFilters")


EXPECTED = sorted([("a", 0, 1), ("a", 0, 3), ("en", 2, 1), ("en", 2, 2), ("en", 2, 4), ("c", 3, 5), ("c", 3, 5)])


def test_union_reads_the_table_once(spark, table):
    df = REG.union_sources(spark, registry(table), columns=["doc_id"])
    assert df.columns == ["doc_id", "source", "source_idx"]
    assert rows(df, "source", "source_idx", "doc_id") == EXPECTED
    assert scans(df) == 1


def test_corpus_reads_the_table_once(spark, table):
    df, opened = CP._merged_sources(spark, registry(table), "doc_id", T.resolve_text_presence, "fail")
    assert opened == [0, 1, 2, 3]
    texts = {r[0]: r[3] or "" for r in ROWS}
    assert rows(df, "source", "source_idx", "doc_id", "text") == [(*r, texts[r[2]]) for r in EXPECTED]
    assert scans(df) == 1


def test_other_tables_and_sources_without_a_predicate(spark, table):
    other = scratch_path(spark, "test-shared")
    spark.createDataFrame([(9, "t")], "doc_id long, content string").write.parquet(other)
    reg = [REG.SourceSpec("all", table), REG.SourceSpec("o", other), REG.SourceSpec("de", table, predicate="lang = 'de'"),
           REG.SourceSpec("renamed", other, rename={"content": "text"})]
    df, _ = CP._merged_sources(spark, reg, "doc_id", T.resolve_text_presence, "fail")
    assert rows(df, "source", "doc_id", "text") == sorted(
        [("all", r[0], r[3] or "") for r in ROWS] + [("de", 3, ""), ("o", 9, "t"), ("renamed", 9, "t")])


def test_a_bad_predicate_keeps_only_its_source_out(spark, table):
    reg = registry(table) + [REG.SourceSpec("bad", table, predicate="no_such_column = 1")]
    with pytest.raises(AnalysisException):
        REG.union_sources(spark, reg)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        df = REG.union_sources(spark, reg, on_error="skip", columns=["doc_id"])
    assert len(said) == 1 and "'bad' skipped" in str(said[0].message)
    assert rows(df, "source", "source_idx", "doc_id") == EXPECTED
    assert CP._merged_sources(spark, reg, "doc_id", T.resolve_text_presence, "skip")[1] == [0, 1, 2, 3]


def test_draws_and_subqueries_have_scans_of_their_own(spark, table):
    reg = registry(table) + [REG.SourceSpec("drawn", table, predicate=F.rand(7) < 2)]
    df = REG.union_sources(spark, reg, columns=["doc_id"])
    assert scans(df) == 2
    assert rows(df.filter("source = 'drawn'"), "doc_id") == [(1,), (2,), (3,), (4,), (5,), (5,)]
    spark.createDataFrame([(1,), (5,)], "k long").createOrReplaceTempView("shared_scan_keys")
    reg = registry(table) + [REG.SourceSpec("sub", table, predicate="doc_id in (select k from shared_scan_keys)")]
    df = REG.union_sources(spark, reg, columns=["doc_id"])
    assert rows(df.filter("source = 'sub'"), "doc_id") == [(1,), (5,), (5,)]


def test_split_at_every_white_space(spark):
    texts = [f"{pad}a{chr(p)}{chr(p)}b{chr(q)}{pad}" for p in T.PY_WHITESPACE for q in (0x20, 0x85, 0x3000, p) for pad in ("", " ", "é")]
    texts += ["", " ", "\x1f", "\x7f", "a", "é", " ", "a\x00b c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.py_split("t").alias("w"), T.whitespace_token_count("t").alias("n")).collect()
    assert len(got) == len(texts) and all((r["w"], r["n"]) == (r["t"].split(), len(r["t"].split())) for r in got)
    assert spark.createDataFrame([(None,)], "t string").select(T.py_split("t").isNull()).first()[0]
