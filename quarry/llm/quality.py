r"""Quality rules by distribution divergence, in DataFrame and SQL functions only.

A document's histogram of character classes and its histogram of common words are compared with references of
all languages in the corpus by Jensen-Shannon distance (base 2, so 0 to 1). References cover all documents that name a language:
the summed class counts, and the counts of its ``TOP`` most frequent words beside all others. The candidates
for the frequent words come from a mergeable frequent-items sketch per language, their counts are exact. A document is held against its closest
language (least word distance, ties by name), whatever its own ``lang`` says.

Kept: the base rule holds, and either the text has fewer than ``MIN_WORDS`` words (too short for histograms; the
base rule with its 50 words is stricter by default) or both distances and their sum are at most their limits.

Base rule: words are ``[^\x20\x09-\x0D]+``; failed with fewer than 50 words or when more than half of the words stand in
three-word windows that occur twice or more. Equal windows are found by 64-bit hashes and confirmed by their words.

Scale: two scans of the texts and one narrow stored table. The references are a table (language, word, share), which meets the
documents' counts of these words; what is shuffled is a sum for each document and each language that it shares a word with. Of all
languages that it shares none with only the closest can matter; their distances are the same for every document. What is collected
is the vocabulary, ``CANDIDATES`` words a language.

Edge cases. Null text: no words, base_failed. Very long texts: whole. Repeated rows, null keys: a row each.
No document names a language, or empty table: no reference, only the base rule decides. Extra columns: ignored.
"""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import write_table

TOP, CANDIDATES, TRACKED = 32, 128, 20_000
MIN_WORDS = 50
MAX_CHAR, MAX_WORD, MAX_SUM = 0.3, 0.38, 0.52
CLASSES = ["lower", "upper", "digit", "symbol", "other", "space"]
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _doubled(pairs: Column) -> Column:
    """Of sorted structs (x, i), the i of those whose x another one has too, ascending."""
    def alike(s):
        def near(j):
            own = F.get(s, j)["x"]
            return own.eqNullSafe(F.get(s, j - 1)["x"]) | own.eqNullSafe(F.get(s, j + 1)["x"])
        found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), near)
        return F.array_sort(F.transform(found, lambda j: F.get(s, j)["i"]))
    return F.when(F.size(pairs) > 0, let(pairs, alike)).otherwise(F.array().cast("array<int>"))


def repeated_words(words: Column, windows: Column) -> Column:
    """Words in three-word windows that occur twice or more. ``windows``: the windows' hashes, in order."""
    hashed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    phrase = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    exact = F.sort_array(F.transform(_doubled(hashed), lambda i: F.struct(phrase(i).alias("x"), i.alias("i"))))

    def covered(at):
        step = lambda k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - F.get(at, k), F.lit(3)))
        return F.aggregate(F.transform(at, lambda _, k: step(k)), F.lit(0), lambda a, b: a + b)

    # equal windows have equal hashes, so most texts end here
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(let(exact, _doubled), covered)).otherwise(0)


def vocabulary_counts(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``rows`` with ``seen``: the place (i) and the count (c) of each word of ``vocabulary`` that is in ``words``."""
    if not vocabulary:
        return rows.withColumn("seen", F.array().cast("array<struct<i:int,c:bigint>>"))
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="words", outputCol="vector", minTF=0.0)
    sparse = F.unwrap_udt("vector")
    pairs = F.zip_with(sparse["indices"], sparse["values"], lambda i, c: F.struct(i.alias("i"), c.cast("long").alias("c")))
    return counter.transform(rows).withColumn("seen", pairs).drop("vector")


def features(docs: DataFrame, vocabulary: list[str], key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts of each text: the base columns, character classes, and how often the words of ``vocabulary`` occur; ``row`` numbers the rows."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(lang).cast("string").alias("lang"), body.alias("t"))
    drop = lambda c, what: F.regexp_replace(c, what, "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id", "lang", word_list(F.col("t")).alias("words"), F.length("t").alias("chars"),
        F.length(drop("t", SPACE)).alias("word_chars"), drop("t", r"[\p{Ll}\x20\x09-\x0D]+").alias("rare"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(
        F.when(F.size(h) >= 3, F.sequence(F.lit(0), F.size(h) - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))
    less = lambda what: F.length("rare") - F.length(drop("rare", what))
    rows = rows.select(
        "doc_id", "lang", "words", "word_chars", "n_dup_lines", F.size("words").alias("n_words"), windows.alias("windows"),
        F.length("rare").alias("rest"), (F.col("word_chars") - F.length("rare")).alias("lower"), less(r"\p{Lu}+").alias("upper"),
        less(r"\p{N}+").alias("digit"), less(r"[#*$%&|<>]+").alias("symbol"), (F.col("chars") - F.col("word_chars")).alias("space"))
    rows = rows.withColumn("n_repeat_words", repeated_words(F.col("words"), F.col("windows")))
    rows = vocabulary_counts(rows, vocabulary)
    return rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "lang", *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars")], F.col("symbol").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"), F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
        F.array(*[F.col(c).cast("long") for c in ("lower", "upper", "digit", "symbol")],
                (F.col("rest") - F.col("upper") - F.col("digit") - F.col("symbol")).cast("long"), F.col("space").cast("long")).alias("classes"),
        "seen")


def frequent_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(language, words): candidates for the most frequent words of each language, from a sketch of bounded size, whose guarantee
    holds for words of more than a ``TRACKED``-th of the language's words."""
    named = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("language"), F.explode(word_list(F.col(text).cast("string"))).alias("w"))
    top = named.groupBy("language").agg(F.expr(f"approx_top_k(w, {CANDIDATES}, {TRACKED})").alias("top"))
    return top.select("language", F.transform("top", lambda x: x["item"]).alias("words"))


def references(counts: DataFrame, candidates: DataFrame, vocabulary: list[str]) -> tuple[DataFrame, DataFrame]:
    """The ``TOP`` words of each language (language, i: place in ``vocabulary``, q: share); and (language, rest: share of all other
    words, apart: word distance of a text without any of them, shares: class distribution)."""
    named = counts.filter(F.col("lang").isNotNull() & (F.col("n_words") > 0)).withColumnRenamed("lang", "language")
    total = named.groupBy("language").agg(F.sum("n_words").alias("words"), *[F.sum(F.col("classes")[i]).alias(c) for i, c in enumerate(CLASSES)])
    may = vocabulary_counts(candidates, vocabulary).select("language", F.explode("seen").alias("s")).select("language", "s.i")
    seen = named.select("language", F.explode("seen").alias("s")).select("language", "s.i", "s.c").join(may, ["language", "i"])
    order = Window.partitionBy("language").orderBy(F.desc("c"), "i")  # the candidates of a language; the vocabulary is sorted
    top = seen.groupBy("language", "i").agg(F.sum("c").alias("c")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    top = write_table(top.join(total, "language").select("language", "i", "c", (F.col("c") / F.col("words")).alias("q")), "reference-words")
    rest = (F.col("words") - F.coalesce(F.col("own"), F.lit(0))) / F.col("words")
    chars = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0]))
    languages = total.join(top.groupBy("language").agg(F.sum("c").alias("own")), "language", "left") \
        .select("language", rest.alias("rest"), F.array(*[F.col(c) / chars for c in CLASSES]).alias("shares"))
    languages = languages.withColumn("apart", word_distance(F.lit(0.0), F.lit(1.0), F.col("rest")))
    return top.select("language", "i", "q"), write_table(languages, "references")


def divergence(p: Column, q: Column) -> Column:
    """The term of a pair of shares in twice the squared Jensen-Shannon distance."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return part(p, q) + part(q, p)


def word_distance(shared: Column, p: Column, q: Column) -> Column:
    """Jensen-Shannon distance to a language's words. ``shared``: of the text's words among them the sum of ``divergence`` less the
    language's share, which is the term of a word that the text lacks; ``p``, ``q``: the shares of all other words."""
    return F.sqrt(F.greatest(F.lit(0.0), shared + (1 - q) + divergence(p, q)) / 2)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, divergence), F.lit(0.0), lambda a, b: a + b) / 2))


def nearest(counts: DataFrame, words: DataFrame, languages: DataFrame) -> DataFrame:
    """``counts`` with ``near``: the word distance and the name of the closest of all ``languages`` (null where there is none)."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    p = F.col("c") / n
    found = counts.select("row", "n_words", F.explode("seen").alias("s")).select("row", "n_words", "s.i", "s.c").join(words, "i") \
        .groupBy("row", "n_words", "language").agg(F.sum(divergence(p, F.col("q")) - F.col("q")).alias("shared"), F.sum("c").alias("own"))
    distance = word_distance(F.col("shared"), (n - F.col("own")) / n, F.col("rest"))
    pair = lambda d: F.struct(d.alias("word_distance"), F.col("language").alias("language"))
    met = found.join(languages, "language").groupBy("row").agg(F.min(pair(distance)).alias("best"), F.collect_list(pair(F.col("apart"))).alias("met"))
    everyone = languages.agg(F.array_sort(F.collect_list(pair(F.col("apart")))).alias("all"))  # one row
    none = F.array().cast(everyone.schema["all"].dataType)
    other = F.get(F.array_except("all", F.coalesce("met", none)), F.lit(0))
    return counts.drop("seen").join(met, "row", "left").crossJoin(F.broadcast(everyone)).withColumn("near", F.least("best", other)).drop("best", "met", "all")


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_char: float = MAX_CHAR,
            max_word: float = MAX_WORD, max_sum: float = MAX_SUM) -> DataFrame:
    """The base columns, base_failed, language, char_distance, word_distance and kept of every document."""
    candidates = write_table(frequent_words(docs, text, lang), "frequent")
    vocabulary = sorted(r["w"] for r in candidates.select(F.explode("words").alias("w")).distinct().collect())
    counts = write_table(features(docs, vocabulary, key, text, lang), "quality")
    words, languages = references(counts, candidates, vocabulary)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = nearest(counts.withColumn("base_failed", failed), words, languages)
    counts = counts.select("*", F.col("near.language").alias("language"), F.coalesce("near.word_distance", F.lit(0.0)).alias("word_distance"))
    counts = counts.join(languages.select("language", "shares"), "language", "left")
    chars = let(F.aggregate("classes", F.lit(0).cast("long"), lambda a, b: a + b), lambda s: F.transform("classes", lambda c: c / F.greatest(s, F.lit(1))))
    counts = counts.withColumn("char_distance", F.coalesce(js_distance(chars, F.col("shares")), F.lit(0.0)))
    near = (F.col("char_distance") <= max_char) & (F.col("word_distance") <= max_word) & (F.col("char_distance") + F.col("word_distance") <= max_sum)
    fine = (F.col("n_words") < MIN_WORDS) | near
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "language", "char_distance",
                         "word_distance", (~F.col("base_failed") & fine).alias("kept"))
