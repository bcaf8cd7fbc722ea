"""Write PLANS.md: the physical plan tree (``explain("formatted")``) of headline queries at sf0.1.

    python tests/plans_report.py [/root/testdata/sf0.1]

Parts that were written with a reliable checkpoint earlier in the job appear as ``Scan ExistingRDD``.
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NOTES = {
    "token_budget": "Text is read once more and only filtered: broadcast join with one cut-off row per source; no text shuffle.",
    "near_dedup": "Final pass: ReadSchema prunes `text` away; the dropped set (written) joins on the position.",
    "interleave_first_exhausted": "Filters pushed into the scan; a window per (source, bucket); broadcast bucket offsets and per-source stats.",
    "token_shards_balanced": "Shard ids come from a prefix sum on narrow rows; the wide side joins once on the order key.",
    "pack_ids": "Packs of the whole stream planned on (pos, length); ids assembled by groupBy(pack) (at most seq_length ids per pack).",
    "bpe_token_counts": "One Arrow Python stage (BPE) after the pruned scan; nothing else.",
    "flagship_mixture": "lang filter pushed to parquet; budget by cut-off join; rollup over one row per source.",
}


def main(sf_dir: str) -> None:
    from quarry.session import get_session

    spark = get_session("local[8]")
    import __spark_entry__ as E

    q = E.queries()
    out = ["# Physical plans of headline queries (sf0.1, `local[8]`)", "",
           "Generated by `tests/plans_report.py`. Subplans written earlier with a reliable checkpoint show as",
           "`Scan ExistingRDD`; the trees below are the final query of each job.", ""]
    for name, note in NOTES.items():
        df = q[name](spark, sf_dir)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        tree = text.split("\n\n")[0].strip()
        details = [ln for ln in text.splitlines() if ln.startswith(("PushedFilters", "ReadSchema"))]
        out += [f"## {name}", "", note, "", "```", tree, *details[:6], "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
