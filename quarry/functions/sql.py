"""The text and id functions for SQL users: SQL-defined functions of the session.

``register(spark)`` makes them; Spark inlines their bodies into the query, so they are JVM expressions like the built-in ones. They are
temporary functions, seen by this session only, and may be made again at any time. Null arguments give null unless stated.

====================================  ==============================================================================
``word_tokens(text)``                 F1: words between Python's white space
``word_count(text)``                  A1: their number
``strip_text(text)``                  F2: without white space at both ends
``first_text(candidates)``            P6: the first that is neither null nor empty, else ""
``word_ids(text)``                    the length of every word, as ids
``append_eos(ids, eos [, always])``   F4: with EOS behind; ``always => false``: only where it is missing, and not to no ids
``truncate_ids(ids, n)``              F5
``pad_ids(ids, n, pad)``              F6
``id_mask(ids, pad)``                 F7: 1 where the id isn't ``pad``
``example_ids(ids, n, eos)``          F4-F6 and F11: EOS, cut and padded with EOS to n
``id_chunks(ids, n)``                 F8: pieces of n ids, the last one short; no ids: one empty piece
====================================  ==============================================================================
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quarry.functions.text import PY_WHITESPACE, WS_RUN

_IDS = "ARRAY<BIGINT>"
_SPACES = "".join(f"\\u{c:04x}" for c in PY_WHITESPACE)


def _once(body: str) -> str:
    """The body with ``ids`` bound to x. The optimiser may put the argument's whole expression wherever a body names it (as in the filter
    that it makes for an exploded array), in a lambda once per element; a lambda's variable is computed once."""
    return f"get(transform(array(ids), x -> {body}), 0)"


DEFINITIONS = {
    "word_tokens": ("text STRING", "ARRAY<STRING>", f"filter(split(text, r'{WS_RUN}'), w -> w <> '')"),
    "word_count": ("text STRING", "BIGINT", "cast(size(word_tokens(text)) AS BIGINT)"),
    "strip_text": ("text STRING", "STRING", f"btrim(text, '{_SPACES}')"),
    "first_text": ("candidates ARRAY<STRING>", "STRING", "coalesce(get(filter(candidates, c -> c <> ''), 0), '')"),
    "word_ids": ("text STRING", _IDS, "transform(word_tokens(text), w -> cast(length(w) AS BIGINT))"),
    "append_eos": (f"ids {_IDS}, eos BIGINT, always BOOLEAN DEFAULT true", _IDS,
                   _once("CASE WHEN always THEN concat(x, array(eos)) WHEN coalesce(try_element_at(x, -1), eos) = eos THEN x ELSE concat(x, array(eos)) END")),
    "truncate_ids": (f"ids {_IDS}, n INT", _IDS, "slice(ids, 1, n)"),
    "pad_ids": (f"ids {_IDS}, n INT, pad BIGINT", _IDS, _once("concat(x, array_repeat(pad, greatest(n - size(x), 0)))")),
    "id_mask": (f"ids {_IDS}, pad BIGINT", _IDS, "transform(ids, i -> cast(i <> pad AS BIGINT))"),
    "example_ids": (f"ids {_IDS}, n INT, eos BIGINT", _IDS, "pad_ids(truncate_ids(append_eos(ids, eos), n), n, eos)"),
    "id_chunks": (f"ids {_IDS}, n INT", "ARRAY<ARRAY<BIGINT>>",
                  _once("transform(sequence(0, greatest(size(x) - 1, 0), n), i -> slice(x, i + 1, n))")),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions in the session; returns their names."""
    for name, (arguments, kind, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(DEFINITIONS)
