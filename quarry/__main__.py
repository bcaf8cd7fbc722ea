"""Command line: the corpus job and the sequence-shard job on Spark.

    python -m quarry build-text-shards REGISTRY.json OUT [--shard-tokens N] [--mode reset|balanced] [--bpe]
                                       [--target-tokens N --shares PART=WEIGHT,PART=WEIGHT]
    python -m quarry sequence-shards OUT FILE [FILE ...] [--seq-length N] [--shard-size N]

A registry is a JSON list of sources in interleave order, each an object with ``name``, ``path`` and
optionally ``format``, ``split``, ``cap_tokens``, ``cap_rows``, ``predicate`` (a SQL expression),
``config``, ``part`` and ``weight``. Run it with ``spark-submit -m``-style launchers or plain ``python``; the session is taken
from the environment (``spark.checkpoint.dir`` must name a shared folder on a cluster).
"""

from __future__ import annotations

import argparse
import json

from quarry import defaults as DEF


def _registry(path: str):
    from quarry.sources.registry import SourceSpec

    with open(path, encoding="utf-8") as f:
        return [SourceSpec(**entry) for entry in json.load(f)]


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="quarry")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build-text-shards")
    b.add_argument("registry")
    b.add_argument("out")
    b.add_argument("--shard-tokens", type=int, default=DEF.SHARD_TOKENS)
    b.add_argument("--mode", choices=["reset", "balanced"], default="reset")
    b.add_argument("--drop-tail", action="store_true")
    b.add_argument("--bpe", action="store_true", help="count tokens with the byte-level BPE (default: whitespace)")
    b.add_argument("--target-tokens", type=int, help="share out so many tokens over the parts and sources")
    b.add_argument("--shares", help="the parts' weights, such as core=80,general=20")
    q = sub.add_parser("sequence-shards")
    q.add_argument("out")
    q.add_argument("files", nargs="+")
    q.add_argument("--seq-length", type=int, default=DEF.SEQ_LENGTH)
    q.add_argument("--shard-size", type=int, default=DEF.SEQ_SHARD_SIZE)
    args = ap.parse_args(argv)
    if args.cmd == "build-text-shards" and (args.target_tokens is None) != (args.shares is None):
        ap.error("--target-tokens and --shares go together")

    from pyspark.sql import SparkSession

    from quarry.functions.tokenize import TokenizerSpec
    from quarry.plans import corpus as CP
    from quarry.session import shared_dir

    spark = SparkSession.builder.appName("quarry").getOrCreate()
    shared_dir(spark)
    if args.cmd == "build-text-shards":
        tok = TokenizerSpec() if args.bpe else None
        registry = _registry(args.registry)
        if args.shares is not None:
            shares = {part: int(weight) for part, weight in (x.split("=") for x in args.shares.split(","))}
            registry = CP.allocated(spark, registry, shares, args.target_tokens, tokenizer=tok)
        CP.build_text_shards(spark, registry, args.out, args.shard_tokens, tok, mode=args.mode,
                             drop_tail=args.drop_tail)
    else:
        CP.create_sequence_shards(spark, args.files, args.out, TokenizerSpec(), args.seq_length, args.shard_size)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
