"""WARC archives, index first: write records with an index, then read selected records by coalesced ranges.

``write_archive`` deals pages over tasks. A task writes gzip members, one a record, into files of its own below
the shared folder and returns an index row per record: file, offset, length, URL, payload digest. The file name
holds the task attempt, so a repeated or speculative attempt never touches another's file; the index, written
at once, names only the files of the attempts that count.

Of records with equal payloads of at least ``min_revisit`` bytes, the one with the largest page_id is the response and
the others revisit it (a record with a reference and no payload). Smaller payloads are all responses.

``read_records`` takes any selection of index rows, deals them by (file, block of offsets), sorts them by offset
and reads neighbours in one range request (up to ``run_bytes``; gaps up to ``gap_bytes`` are read over).

Edge cases. Null html: empty payload. Null url: empty. Null page_id: never the page that others revisit unless
all ids of the group are null; then all are responses. Repeated rows: each its own record; rows that share the
largest page_id are all responses. Empty table: no files, empty index. Extra columns: ignored.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, write_table
from quarry.session import scratch_path

FILE_BYTES = 1 << 30  # a task begins another file beyond this
BLOCK_BYTES = 4 << 20  # of a file that one task reads
_INDEX = ("page_id string, url string, payload_digest string, payload_bytes long, record_type string, refers_to string, "
          "file string, offset long, length long")


def _open_fs(uri: str):
    """Arrow's file system for a folder of the cluster (local or mounted, HDFS, object stores) and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def _record(page_id, url, payload, digest, size, refers_to) -> bytes:
    block = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            "WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url),
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                     f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, level: int):
    def run(batches):
        store, base = _open_fs(folder)
        task = TaskContext.get()
        out, name, at, number = None, None, 0, 0
        try:
            for batch in batches:
                rows = []
                cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
                for page_id, url, payload, digest, size, refers_to in zip(*cols):
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number}.warc.gz"
                        number, at = number + 1, 0
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    packer = zlib.compressobj(level, wbits=31)
                    member = packer.compress(_record(page_id, url, payload, digest, size, refers_to)) + packer.flush()
                    out.write(member)
                    rows.append((page_id, url, digest, size, "response" if refers_to is None else "revisit", refers_to,
                                 f"{folder}/{name}", at, len(member)))
                    at += len(member)
                kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 3 + [pa.int64()] * 2
                cols = list(zip(*rows)) if rows else [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 [x.split()[0] for x in _INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return run


def with_revisits(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """``(page_id, url, payload, payload_digest, payload_bytes, refers_to)``."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = (rows.withColumn("payload_digest", F.sha1("payload"))
            .withColumn("payload_bytes", F.octet_length("payload").cast("long")))
    # a second hash beside SHA-1 keeps payloads apart whose SHA-1 was made to collide
    same = F.when(F.col("payload_bytes") >= min_revisit, F.concat_ws(":", "payload_digest", F.xxhash64("payload"), "payload_bytes"))
    groups = (rows.select("page_id", same.alias("same")).filter("same is not null").groupBy("same")
              .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    joined = rows.withColumn("same", same).join(groups, "same", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.withColumn("refers_to", F.when(revisit, F.col("keeper"))).drop("same", "keeper")


def write_archive(pages: DataFrame, folder: str | None = None, min_revisit: int = 1000, level: int = 3) -> DataFrame:
    """Write all pages; the index as a stored table."""
    arrow_rows(pages.sparkSession)
    folder = folder or scratch_path(pages.sparkSession, "warc")
    rows = with_revisits(pages, min_revisit).select(
        F.col("page_id").cast("string"), "url", "payload", "payload_digest", "payload_bytes", F.col("refers_to").cast("string"))
    return write_table(rows.mapInArrow(_writer(folder, level), _INDEX), "warc-index")


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    urn = lambda x: x and (x[len("<urn:page:"):-1] or None)
    kind = fields["WARC-Type"]
    return {"page_id": urn(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": kind,
            "refers_to": urn(fields.get("WARC-Refers-To")), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "payload_bytes": int(fields["X-Payload-Length"]),
            "payload": rest[: int(fields["Content-Length"])] if kind == "response" else None}


_READ = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _reader(run_bytes: int, gap_bytes: int):
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _READ.split(", ")]

    def fetch(span):
        store, path = _open_fs(span[0][0])
        first, last = span[0][1], max(o + n for _, o, n in span)
        with store.open_input_file(path) as f:
            data = f.read_at(last - first, first)
        rows = [parse_record(zlib.decompress(data[o - first:o - first + n], wbits=31)) for _, o, n in span]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names)

    def run(batches):
        span, end = [], 0
        for batch in batches:
            for file, offset, length in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if span and (file != span[0][0] or offset - end > gap_bytes or offset + length - span[0][1] > run_bytes):
                    yield fetch(span)
                    span = []
                span.append((file, offset, length))
                end = offset + length
        if span:
            yield fetch(span)

    return run


def read_records(index: DataFrame, run_bytes: int = 4 << 20, gap_bytes: int = 64 << 10) -> DataFrame:
    """The records that the rows of ``index`` (file, offset, length) point to; payload is null for revisits."""
    # as many tasks as there are blocks to read; the index alone, a few bytes a record, would make one
    size = index.agg(F.sum("length")).first()[0] or 0
    rows = (index.select("file", "offset", "length").repartition(size // BLOCK_BYTES + 1, "file", F.floor(F.col("offset") / BLOCK_BYTES))
            .sortWithinPartitions("file", "offset"))
    return rows.mapInArrow(_reader(run_bytes, gap_bytes), _READ)
