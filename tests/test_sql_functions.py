"""The SQL functions equal the DataFrame ones, stay in the JVM and take nulls and empty values."""

from pyspark.sql import functions as F

from quarry.functions import sequences as SQ
from quarry.functions import sql as QL
from quarry.functions import text as T

TEXTS = ["", " ", "a", " a\tb\n c　d\x1fe ", "ein  Wörtchen 😀", " x ", "'quoted' \\d \\n"]


def test_texts(spark):
    assert QL.register(spark) == QL.register(spark) == list(QL.DEFINITIONS)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, text string")
    df.createOrReplaceTempView("sql_texts")
    got = spark.sql("SELECT i, word_tokens(text) AS w, word_count(text) AS n, strip_text(text) AS s, word_ids(text) AS ids, first_text(array(null, text, 'z')) AS f FROM sql_texts")
    want = df.select("i", T.py_split("text").alias("w"), T.whitespace_token_count("text").alias("n"), T.py_strip("text").alias("s"),
                     SQ.word_length_ids(T.py_split("text")).alias("ids"), F.coalesce(F.nullif("text", F.lit("")), F.lit("z")).alias("f"))
    assert sorted(got.collect()) == sorted(want.collect())
    for r in got.filter("i < 7").collect():
        assert (r.w, r.s) == (TEXTS[r.i].split(), TEXTS[r.i].strip())
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "Python" not in plan and "Arrow" not in plan


def test_ids(spark):
    QL.register(spark)
    df = spark.createDataFrame([(i, x) for i, x in enumerate([[], [5], [5, 0], [0], [1, 2, 3, 4], [1, 2, 3, 4, 5], [0, 0, 7]])], "i int, ids array<bigint>")
    df.createOrReplaceTempView("sql_ids")
    got = spark.sql("""SELECT i, append_eos(ids, 0) AS a, append_eos(ids, 0, false) AS b, append_eos(ids, 0, always => false) AS b2, truncate_ids(ids, 3) AS t,
                       pad_ids(ids, 4, 9) AS p, id_mask(ids, 0) AS m, id_chunks(ids, 2) AS c, example_ids(ids, 4, 0) AS e FROM sql_ids""")
    want = df.select("i", SQ.append_eos("ids", 0).alias("a"), SQ.append_eos("ids", 0, "if_missing").alias("b"), SQ.append_eos("ids", 0, "if_missing").alias("b2"),
                     SQ.truncate("ids", 3).alias("t"), SQ.pad("ids", 4, 9).alias("p"), SQ.attention_mask("ids", 0).alias("m"), SQ.chunks("ids", 2).alias("c"),
                     SQ.pad(SQ.truncate(SQ.append_eos("ids", 0), 4), 4, 0).alias("e"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_chunks_compute_their_ids_once(spark):
    """The filter that is made for exploded chunks must not hold the words' whole expression once per chunk."""
    import re

    QL.register(spark)
    spark.createDataFrame([(0, "a b c")], "i int, text string").createOrReplaceTempView("sql_lines")
    cut = spark.sql("""WITH c AS (SELECT i, id_chunks(append_eos(word_ids(strip_text(text)), 0, false), 2) AS chunks FROM sql_lines)
                       SELECT i, k, chunk FROM c LATERAL VIEW posexplode(chunks) AS k, chunk""")
    lines = spark.table("sql_lines").select("i", SQ.chunks(SQ.append_eos(SQ.word_length_ids(T.py_split("text")), 0, "if_missing"), 2).alias("chunks"))
    for df in (cut, lines.select("i", F.posexplode("chunks").alias("k", "chunk"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert set(re.findall(r"slice\((\w+)", plan)) == {"lambda"}
        assert sorted(df.collect()) == [(0, 0, [1, 1]), (0, 1, [1, 0])]
