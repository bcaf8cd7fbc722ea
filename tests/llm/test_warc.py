import hashlib

from quarry.llm import warc

BIG = "<p>" + "x" * 1200 + "é</p>"


def table(spark):
    rows = [(1, "http://a/1", BIG), (2, "http://a/2\r\nX: y", BIG), (3, None, BIG), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"),
            (8, "u", "z" * 200_000), (8, "u", "z" * 200_000), (None, "u", BIG), (9, "u", "\r\n\r\nWARC/1.1\r\n")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, length string")


def test_round_trip_and_revisits(spark):
    df = table(spark)
    index = warc.write_archive(df)
    assert index.count() == 11
    got = warc.read_records(index).collect()
    text = {r.page_id: (r.html or "").encode() for r in df.collect()}
    assert len(got) == 11
    for r in got:
        own = text[int(r.page_id) if r.page_id else None]
        assert r.payload_bytes == len(own) and r.payload_digest == hashlib.sha1(own).hexdigest()
        if r.record_type == "response":
            assert bytes(r.payload) == own and r.refers_to is None
        else:
            assert r.payload is None and r.refers_to == "3"
    kinds = sorted((r.page_id or "", r.record_type) for r in got)
    assert kinds == sorted([("1", "revisit"), ("2", "revisit"), ("3", "response"), ("4", "response"), ("5", "response"), ("6", "response"),
                            ("7", "response"), ("8", "response"), ("8", "response"), ("9", "response"), ("", "revisit")])


def test_any_selection_is_read_by_ranges(spark):
    index = warc.write_archive(table(spark))
    got = warc.read_records(index.filter("page_id in (4, 8)"), run_bytes=10, gap_bytes=0).collect()
    assert sorted(r.page_id for r in got) == ["4", "8", "8"]


def test_empty(spark):
    index = warc.write_archive(table(spark).limit(0))
    assert index.count() == 0 and warc.read_records(index).count() == 0
