"""Single-process timings of the reference's loops, for comparison with bench.py (not library code).

The reference is a single Python process walking iterators. This script times the same loops,
written as plain Python over the same parquet (read with pyarrow), one process, one thread:
whitespace count + per-source budget, sequential MinHash-LSH dedup, the reset shard fold, and the
text-line -> BPE -> EOS -> chunk -> count-shard writer loop.

    python tests/single_process_baseline.py [/root/testdata/sf0.1]
"""

from __future__ import annotations

import json
import os
import sys
import time

import numpy as np
import pyarrow.parquet as pq

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.operators import dedup as D  # noqa: E402  (the same hash family, so the work is comparable)


def main(sf_dir: str) -> dict:
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "source", "text"]).to_pylist()
    t.sort(key=lambda r: r["doc_id"])
    out = {}

    t0 = time.perf_counter()
    by_source: dict[str, list[int]] = {}
    for r in t:
        by_source.setdefault(r["source"], []).append(len(r["text"].split()))
    sum(int((np.cumsum(ns) <= 5000).sum()) for ns in by_source.values())
    out["token_budget"] = time.perf_counter() - t0

    t0 = time.perf_counter()
    bands, rows = D.optimal_bands(0.9, 128)
    a, b = (np.array(x, dtype=np.int64) for x in D.perm_params(128, 1))
    index, n_kept = set(), 0
    for r in t:
        keys = list(enumerate(D.band_keys_of(D.signature_of(list(set(r["text"].split())), a, b), bands, rows)))
        if any(k in index for k in keys):
            continue
        index.update(keys)
        n_kept += 1
    out["near_dedup"] = time.perf_counter() - t0

    t0 = time.perf_counter()
    ends = np.cumsum([len(r["text"].split()) for r in t])
    first, shards = 0, 0
    while first < len(ends):  # a shard ends with the document that fills it
        first = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 20_000)) + 1
        shards += 1
    out["token_shards_reset"] = time.perf_counter() - t0

    try:
        from quarry.functions.tokenize import TokenizerSpec

        spec = TokenizerSpec()
        tok, eos = spec.load(), spec.eos()
        t0 = time.perf_counter()
        lines = (line.strip() for r in t for line in r["text"].split("\n"))
        ids = [tok.encode(line).ids + [eos] for line in lines if line]
        pieces = [x[i:i + 2048] for x in ids for i in range(0, len(x), 2048)]
        [pieces[i:i + 1000] for i in range(0, len(pieces), 1000)]
        out["bpe_chunked_sequences"] = time.perf_counter() - t0
    except FileNotFoundError:
        pass
    res = {"sf_dir": sf_dir, "documents": len(t), "seconds": {k: round(v, 3) for k, v in out.items()}}
    print(json.dumps(res))
    return res


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
