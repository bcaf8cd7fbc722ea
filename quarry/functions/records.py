"""Records without a schema: JSON of any shape in one VARIANT column.

One source may mix record shapes. A path that a record lacks makes a predicate false, and so do a JSON null, a value of another
type and a path through an array or a plain value; text that isn't JSON is a record without fields. All of it runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import TEXT_FALLBACK_FIELDS


def parse_records(json: Column | str) -> Column:
    """The JSON text as VARIANT; null where it isn't valid JSON."""
    return F.try_parse_json(json)


def has_field(record: Column | str, path: str) -> Column:
    """Whether the path is there, a JSON null included."""
    return F.try_variant_get(record, path, "variant").isNotNull()


def field_equals(record: Column | str, path: str, value) -> Column:
    """The nested field equals ``value`` (str, bool, int or float; numbers compare by value, types don't mix)."""
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(record, path, "variant")), F.lit(""))
    if isinstance(value, bool):
        same, typed = F.try_variant_get(record, path, "boolean") == F.lit(value), kind == "BOOLEAN"
    elif isinstance(value, str):
        same, typed = F.try_variant_get(record, path, "string") == F.lit(value), kind == "STRING"
    elif isinstance(value, int):
        same = F.try_variant_get(record, path, "decimal(38,10)") == F.lit(value).cast("decimal(38,10)")
        typed = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    else:
        same, typed = F.try_variant_get(record, path, "double") == F.lit(value), kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.coalesce(typed & same, F.lit(False))


def text_by_presence(record: Column | str) -> Column:
    """P5 record by record: ``text`` if the record has that field, else ``content``, else ``""``; a null is ``""``."""
    field = F.when(has_field(record, "$.text"), F.try_variant_get(record, "$.text", "string")) \
        .otherwise(F.try_variant_get(record, "$.content", "string"))
    return F.coalesce(field, F.lit(""))


def text_first_nonempty(record: Column | str) -> Column:
    """P6 record by record: the first of the fallback fields that is there and not empty, else ``""``."""
    found = [F.nullif(F.try_variant_get(record, f"$.{c}", "string"), F.lit("")) for c in TEXT_FALLBACK_FIELDS]
    return F.coalesce(*found, F.lit(""))
