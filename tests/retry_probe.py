"""Run operators with injected task failures and compare with a clean run (used by test_retries.py).

Every partition's first attempt of the input stage raises; Spark retries (local[4,3]) and the
results must be identical: bucket bounds are literals, spreading is by hash, state is written.
"""

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quarry.functions import text as T  # noqa: E402
from quarry.operators import dedup as D  # noqa: E402
from quarry.operators import ordered as O  # noqa: E402
from quarry.operators import shards as SH  # noqa: E402
from quarry.session import get_session, scratch_path  # noqa: E402
from quarry.sources import sinks as SK  # noqa: E402


def flaky(df):
    schema = df.schema

    def run(batches):
        ctx = TaskContext.get()
        if ctx is not None and ctx.attemptNumber() == 0:
            raise RuntimeError("injected failure (first attempt)")
        yield from batches

    return df.mapInArrow(run, schema)


def results(spark, docs):
    d = docs.withColumn("n_tokens", T.whitespace_token_count("text"))
    out = {}
    out["budget"] = sorted(r["doc_id"] for r in O.token_budget(d, 3000).collect())
    out["interleave"] = sorted((r["doc_id"], r["pos"]) for r in O.interleave(
        d.withColumn("source_idx", F.regexp_extract("source", r"(\d+)$", 1).cast("int"))).collect())
    out["dedup"] = sorted(r["doc_id"] for r in D.near_dedup(d, "doc_id").collect())
    path = scratch_path(spark, "files")
    out["files"] = [SK.write_text_shard_files(SH.token_shards(d, 20000, "doc_id", mode="reset"), path, order="doc_id"),
                    sorted(r[0] for r in spark.read.text(path).collect())]
    out["shards"] = sorted((r["doc_id"], r["shard"]) for r in SH.token_shards(d, 20000, "doc_id", mode="reset").collect())
    return out


def main(sf_dir):
    spark = get_session("local[4,3]", shuffle_partitions=4, app="retry-probe")
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").repartition(4, "doc_id")
    clean = results(spark, base)
    failing = results(spark, flaky(base))
    print(json.dumps({"equal": clean == failing, "sizes": {k: len(v) for k, v in clean.items()}}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
