"""Records without a schema (P2 P5 P6): as Python reads them."""

import json

from quarry.functions import records as RC
from quarry.functions.text import TEXT_FALLBACK_FIELDS

RECORDS = [
    {"meta": {"category": "math", "n": 3}}, {"meta": {"category": "art", "n": 3.0}}, {"meta": {"category": 3, "n": "3"}}, {"meta": {"category": None, "n": None}},
    {"meta": {"n": True}}, {"meta": None}, {"meta": []}, {"meta": [{"category": "math", "n": 3}]}, {"meta": "math"}, {}, [], 5, None, "math",
    {"meta": {"category": ["math"], "n": {"n": 3}}}, {"text": "a", "content": "b"}, {"text": None, "content": "b"}, {"content": "b", "output": "x"},
    {"text": "", "content": "", "instruction": " ", "response": "r"}, {"response": "r", "instruction": None}, {"text": "ü\n\u0000\"", "meta": {"n": 2}},
]


def test_fields_and_texts(spark):
    rows = [(i, json.dumps(r)) for i, r in enumerate(RECORDS)] + [(90, "{broken"), (91, ""), (92, None)]
    df = spark.createDataFrame(rows, "id int, json string").withColumn("r", RC.parse_records("json"))

    def field(r, name):
        meta = r.get("meta") if isinstance(r, dict) else None
        return meta.get(name) if isinstance(meta, dict) else None

    def same(a, b):
        return a == b and isinstance(a, bool) == isinstance(b, bool)

    got = {r.id: r for r in df.select(
        "id", RC.field_equals("r", "$.meta.category", "math").alias("cat"), RC.field_equals("r", "$.meta.n", 3).alias("int"),
        RC.field_equals("r", "$.meta.n", 3.0).alias("float"), RC.field_equals("r", "$.meta.n", True).alias("bool"), RC.has_field("r", "$.text").alias("has"),
        RC.text_by_presence("r").alias("presence"), RC.text_first_nonempty("r").alias("first")).collect()}
    for i, r in enumerate(RECORDS):
        d = r if isinstance(r, dict) else {}
        assert got[i].cat == same(field(r, "category"), "math"), r
        assert got[i].int == got[i].float == same(field(r, "n"), 3), r
        assert got[i].bool == same(field(r, "n"), True), r
        assert got[i].has == ("text" in d)
        assert got[i].presence == ((d["text"] if "text" in d else d.get("content")) or "")
        assert got[i].first == next((d[c] for c in TEXT_FALLBACK_FIELDS if d.get(c)), "")
    for i in (90, 91, 92):
        assert not (got[i].cat or got[i].int or got[i].bool or got[i].has) and got[i].presence == got[i].first == ""
