import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.llm import shard
from tests.llm.helpers import awkward, documents, empty


def check(rows, n):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, n)
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = shard.shard_table(df, [1.0] * 4).collect()
    assert len(rows) == 11
    check(rows, 4)
    text = {r.doc_id: r.text for r in df.collect()}
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    assert shard.shard_table(empty(spark), [1.0] * 4).count() == 0


def test_only_the_new_shard_gains(spark):
    df = documents(spark, ["x"] * 2000)
    a = {r.doc_id: r for r in shard.shard_table(df, [1.0] * 16).collect()}
    b = {r.doc_id: r.shard for r in shard.shard_table(df, [1.0] * 17).collect()}
    assert all(a[i].grown_shard == b[i] for i in b)
    moved = sum(a[i].shard != b[i] for i in b)
    assert 60 < moved < 180
    check(a.values(), 16)


def test_weights_and_hot_keys(spark):
    df = documents(spark, [f"t{i % 3}" for i in range(3000)], ids=[7 if i % 3 == 0 else i for i in range(3000)])
    rows = shard.shard_table(df, [1.0, 3.0]).collect()
    check(rows, 2)
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1
    heavy = sum(r.shard == 1 for r in rows if r.doc_id != 7)
    assert 0.68 < heavy / 2000 < 0.82
    assert shard.with_shard(df, "doc_id", [1.0]).agg(F.max("shard")).first()[0] == 0


def test_shards_equal_sql(spark):
    """The hashing itself, stated in SQL (slots and crc32 have no form in it)."""
    from quarry.llm.queries import OP3_SQL, op3_shards
    from tests.conftest import SF_SMALL
    from tests.oracle_compare import duck

    got = sorted((r.doc_id, r["size"], r.shard, r.grown_shard) for r in op3_shards(spark, SF_SMALL).collect())
    assert got == sorted(duck(SF_SMALL).sql(OP3_SQL).fetchall())
