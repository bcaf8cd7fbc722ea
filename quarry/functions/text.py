"""Python string semantics as JVM expressions (whitespace split/strip, text resolution).

Python's ``str.split()`` / ``str.strip()`` treat 29 code points as white space. Java's ``\\s`` misses
the non-ASCII ones and even ``(?U)\\s`` misses 0x1c-0x1f, and Spark's ``trim`` strips only spaces if not told
otherwise, so the class is spelled out. ``\\x{..}`` escapes are understood by both Java regex and RE2 (DuckDB),
which lets the oracle SQL use the very same pattern.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The code points Python's str.isspace() accepts (str.split/strip separators).
PY_WHITESPACE = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def _char_class(points: list[int]) -> str:
    parts, i = [], 0
    pts = sorted(points)
    while i < len(pts):
        j = i
        while j + 1 < len(pts) and pts[j + 1] == pts[j] + 1:
            j += 1
        lo, hi = pts[i], pts[j]
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
        i = j + 1
    return "[" + "".join(parts) + "]"


WS_CLASS = _char_class(PY_WHITESPACE)
WS_RUN = WS_CLASS + "+"
# Most texts hold none of the white space beyond Latin-1; Java looks up a class of single Latin-1 characters in one table, without ranges
LATIN_WS_RUN = "[" + "".join(f"\\x{{{p:x}}}" for p in PY_WHITESPACE if p < 0x100) + "]+"
WIDE_WS = [chr(p) for p in PY_WHITESPACE if p >= 0x100]
STRIP_PATTERN = f"^{WS_RUN}|{WS_RUN}$"
PY_SPACES = "".join(map(chr, PY_WHITESPACE))


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_split(text: Column | str) -> Column:
    """``str.split()``: runs of Python white space, no empty pieces."""
    c = _c(text)
    wide = F.octet_length(c) != F.length(c)  # not ASCII
    wide = wide & reduce(lambda a, b: a | b, [c.contains(w) for w in WIDE_WS])
    return F.filter(F.when(wide, F.split(c, WS_RUN)).otherwise(F.split(c, LATIN_WS_RUN)), lambda x: x != F.lit(""))


def py_strip(text: Column | str) -> Column:
    """``str.strip()`` with Python's white-space set; only the ends of the text are looked at."""
    return F.btrim(_c(text), F.lit(PY_SPACES))


def whitespace_token_count(text: Column | str) -> Column:
    """Number of whitespace tokens (the whitespace tokenizer's ``len(encode(text))``)."""
    return F.size(py_split(text)).cast("long")


def distinct_tokens(text: Column | str) -> Column:
    """The token *set* of a text (what a MinHash sketches)."""
    return F.array_distinct(py_split(text))


def resolve_text_presence(df: DataFrame, out: str = "text") -> Column:
    """P5: ``text`` if the field exists, else ``content``, else ``""`` -- decided by the schema.

    A present-but-null value is read as ``""`` (Python would raise on it).
    """
    names = set(df.columns)
    if "text" in names:
        src = F.col("text")
    elif "content" in names:
        src = F.col("content")
    else:
        src = F.lit(None).cast("string")
    return F.coalesce(src, F.lit("")).alias(out)


TEXT_FALLBACK_FIELDS = ["text", "content", "instruction", "response", "output"]


def resolve_text_first_nonempty(df: DataFrame, out: str = "text") -> Column:
    """First of text/content/instruction/response/output that is non-null and non-empty.

    Python truthiness: no trimming, so ``" "`` counts as text. Missing fields are skipped.
    """
    present = [c for c in TEXT_FALLBACK_FIELDS if c in set(df.columns)]
    cands = [F.when(F.col(c) != "", F.col(c)) for c in present]
    return F.coalesce(*cands, F.lit("")).alias(out) if cands else F.lit("").alias(out)


def strip_nonblank_lines(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """P7 over a document table: split on newlines, strip each line, drop blank ones.

    Keeps ``line_no`` (0-based position of the line in its document) for the order contract.
    """
    keep = keep or []
    lines = df.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return lines.select(*keep, "line_no", py_strip("line").alias("line")).filter(F.length("line") > 0)
