"""Composite jobs and remaining semantic options (S9, D9, D13, C2 stream, C6)."""

import json
import os


from quarry.functions import sequences as SQ
from quarry.plans import corpus as CP
from quarry.session import scratch_path
from quarry.sources import registry as REG
from quarry.sources import sinks as SK
from quarry.sources.tables import documents_registry
from tests.conftest import SF_SMALL


def test_metadata_sink_is_one_json_object(spark):
    seqs = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "shard long, local_idx long")
    path = scratch_path(spark, "test-meta")
    SK.write_metadata(CP.shard_metadata(seqs, 16, 2), path)
    files = [f for f in os.listdir(path.replace("file:", "")) if f.endswith(".json")]
    assert len(files) == 1
    obj = json.loads(open(os.path.join(path.replace("file:", ""), files[0])).read())
    assert obj == {"total_sequences": 3, "num_shards": 2, "seq_length": 16, "shard_size": 2}


def test_empty_text_pad_or_drop_d13(spark):
    df = spark.createDataFrame([(0, [5, 6], False), (1, [], True)], "i int, ids array<bigint>, e boolean")
    pad = {r["i"]: list(r["input_ids"]) for r in SQ.with_fixed_length(df, "ids", "e", 4, 9).collect()}
    assert pad == {0: [5, 6, 9, 9], 1: [9, 9, 9, 9]}
    drop = [r["i"] for r in SQ.with_fixed_length(df, "ids", "e", 4, 9, empty="drop").collect()]
    assert drop == [0]
    assert [r["i"] for r in SQ.drop_empty(df.withColumnRenamed("ids", "input_ids")).collect()] == [0]


def test_source_config_is_a_subfolder_d9(spark):
    base = scratch_path(spark, "test-config")
    spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").write.parquet(f"{base}/cfg_a")
    spec = REG.SourceSpec(name="bench", path=base, config="cfg_a", rename={"text": "content"})
    df = REG.open_source(spark, spec)
    assert "content" in df.columns and df.count() == spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").count()


def test_corpus_stream_budget_and_interleave(spark):
    reg = documents_registry(SF_SMALL, extra={"src0": {"cap_tokens": 300}, "src1": {"cap_rows": 2}})
    out = CP.corpus_stream(spark, reg).orderBy("pos").collect()
    per = {}
    for r in out:
        per.setdefault(r["source"], []).append(r)
    # whole rounds, one row per source per round, in registry order
    assert [r["source_idx"] for r in out] == [i % 3 for i in range(len(out))]
    assert sum(r["n_tokens"] for r in per["src0"]) <= 300
    assert len(per["src1"]) <= 2


def test_training_view_batches_and_ranks(spark):
    from quarry.functions.tokenize import TokenizerSpec

    reg = documents_registry(SF_SMALL)
    tv = CP.training_view(spark, reg, TokenizerSpec(), 32, 2, 4, 2, 2)
    rows = tv.collect()
    n = len(rows) // 2
    assert sorted(r["pos"] for r in rows) == list(range(2 * n))  # consecutive over both epochs
    for r in rows:
        assert r["batch_id"] == r["pos"] // 4 and r["micro_id"] == (r["pos"] % 4) // 2
        assert r["rank"] in (0, 1) and len(r["input_ids"]) == 32


def _own_documents(spark, tmp_path):
    """Documents of three sources, one in four without a text, some of just the ids that fill an example."""
    def text(s, i):
        return [None, "", "word " * 127 + "word", f"doc {i} of source {s}", "<|endoftext|> inside", "naive word " * (10 * s + i)][(i + s) % 6]

    rows = [(3 * i + s, f"src{s}", text(s, i)) for s in range(3) for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return rows


def _view_by_loop(spec, rows, caps, length, epochs, batch, micro, empty="pad"):
    """The reference's loops over lists: (epoch, pos, doc_id, batch_id, micro_id, input_ids, attention_mask) in order."""
    tok, eos = spec.load(), spec.eos()
    streams = []
    for source, cap in caps.items():
        streams.append([])
        for doc, _, text in sorted(r for r in rows if r[1] == source):
            ids = tok.encode(text or "", add_special_tokens=False).ids
            cap -= len(ids)
            if cap < 0:
                break
            ids = (ids + [eos])[:length] if text else []
            ids += [eos] * (length - len(ids)) if text or empty == "pad" else []
            streams[-1].append((doc, ids, [int(i != eos) for i in ids]))
    merged = [x for turn in zip(*streams) for x in turn if x[1]]
    at = [(e, e * len(merged) + i, *x) for e in range(epochs) for i, x in enumerate(merged)]
    return [(e, p, doc, p // batch, p % batch // micro, ids, mask) for e, p, doc, ids, mask in at]


def test_training_view_query_gives_ids_and_mask_of_every_example(spark, tmp_path):
    from quarry.plans import catalog as C

    rows = _own_documents(spark, tmp_path)
    chars = {f"src{s}": sum(len(t or "") for _, x, t in rows if x == f"src{s}") for s in range(3)}
    caps = {n: c * (i + 1) // C.TRAIN_CHARS for i, (n, c) in enumerate(chars.items())}
    expect = _view_by_loop(C.BPE, rows, caps, C.BPE_SEQ, C.EPOCHS, C.BATCH_SIZE, C.MICRO_BATCH)
    assert any(sum(x[6]) == 0 for x in expect) and any(0 < sum(x[6]) < C.BPE_SEQ for x in expect) and any(sum(x[6]) == C.BPE_SEQ for x in expect)
    got = C.q_training_view(spark, str(tmp_path)).orderBy("pos").collect()
    numbers = lambda text: [int(i) for i in text.split(",")]
    assert [(*(r[c] for c in ("epoch", "pos", "doc_id", "batch_id", "micro_id")), numbers(r["input_ids"]), numbers(r["attention_mask"])) for r in got] == expect


def test_training_view_drops_examples_without_ids_p9(spark, tmp_path):
    from quarry.functions.tokenize import TokenizerSpec

    spec, rows = TokenizerSpec(), _own_documents(spark, tmp_path)
    reg = documents_registry(str(tmp_path))
    caps = {s.name: 10**9 for s in reg}
    for empty in ("pad", "drop"):
        got = CP.training_view(spark, reg, spec, 32, 2, 8, 2, 2, empty).orderBy("pos").collect()
        got = [(r["epoch"], r["pos"], r["doc_id"], r["batch_id"], r["micro_id"], r["input_ids"], r["attention_mask"]) for r in got]
        assert got == _view_by_loop(spec, rows, caps, 32, 2, 8, 2, empty)
    assert CP.training_view(spark, reg, spec, 0, 2, 8, 2, 2).count() == 0  # no id fits an example of no length


def test_sequence_shards_from_files_in_order(spark, tmp_path):
    from quarry.functions.tokenize import TokenizerSpec

    spec = TokenizerSpec()
    tok, eos = spec.load(), spec.eos()
    files = []
    for i, lines in enumerate([["b first", "", "b second"], ["a third " * 30, "a fourth"]]):
        f = tmp_path / f"in_{1 - i}.txt"  # names do not decide the order, the list does
        f.write_text("\n".join(lines) + "\n", encoding="utf-8")
        files.append(str(f))
    out = scratch_path(spark, "test-seqfiles")
    CP.create_sequence_shards(spark, files, out, spec, seq_length=8, shard_size=3)
    back = SK.read_sequence_shards(spark, f"{out}/shards").orderBy("shard", "local_idx").collect()
    expect = []
    for line in ["b first", "b second", ("a third " * 30).strip(), "a fourth"]:
        ids = tok.encode(line).ids + [eos]
        expect += [ids[i:i + 8] for i in range(0, len(ids), 8)] if len(ids) > 8 else [ids]
    assert [list(r["input_ids"]) for r in back] == expect
    assert [(r["shard"], r["local_idx"]) for r in back] == [(i // 3, i % 3) for i in range(len(expect))]
    meta = spark.read.json(f"{out}/metadata").first()
    assert (meta["total_sequences"], meta["num_shards"]) == (len(expect), (len(expect) + 2) // 3)


def test_cli_builds_text_shards(spark, tmp_path):
    from quarry.__main__ import main

    reg = [{"name": f"src{i}", "path": f"{SF_SMALL}/documents.parquet", "predicate": f"source = 'src{i}'",
            "cap_tokens": 2000} for i in range(3)]
    (tmp_path / "reg.json").write_text(json.dumps(reg))
    out = scratch_path(spark, "test-cli")
    assert main(["build-text-shards", str(tmp_path / "reg.json"), out, "--shard-tokens", "1500"]) == 0
    back = SK.read_text_shards(spark, out)
    assert back.count() > 0 and back.select("shard_name").distinct().count() >= 1


def test_empty_registered_source_ends_first_exhausted(spark):
    from pyspark.sql import functions as F

    reg = documents_registry(SF_SMALL, extra={"src1": {"predicate": F.col("doc_id") < 0}})  # opens, holds nothing
    assert CP.corpus_stream(spark, reg).count() == 0
    skipped = documents_registry(SF_SMALL) + [REG.SourceSpec(name="gone", path=f"{SF_SMALL}/none.parquet")]
    assert CP.corpus_stream(spark, skipped, on_error="skip").count() > 0  # a source that cannot open is skipped
