"""WARC archives: index first, then coalesced byte-range reads.

Each task writes its rows as gzip members into archives of its own and returns an index row per record: file, offset,
length, URL and digest. Readers take index rows, whichever were selected, sort them by place, and fetch runs of
neighbours with one read each. Archives carry the task attempt in their name and only attempts whose index rows were
committed are ever read, so a lost executor leaves nothing wrong behind.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_folder

#: Bytes after which a task begins another archive, between two wanted records that are read over, and of one read.
ARCHIVE_BYTES, GAP_BYTES, READ_BYTES = 1 << 30, 64 << 10, 8 << 20
#: Record headers.
_VERSION, _END = b"WARC/1.1\r\n", b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, date: str) -> bytes:
    """One record as a gzip member; a revisit (refers_to is given) keeps the HTTP headers and leaves the payload out."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", _PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(_VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + _END) + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    if not raw.startswith(_VERSION):
        raise ValueError("not a WARC record")
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != _END:
        raise ValueError("a record doesn't end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0, date: str = "2020-01-01T00:00:00Z", id_col: str = "page_id") -> DataFrame:
    """Write a record for each row of pages (id_col, url, html) below `folder`; the index, materialized, of what was written.

    Index: file, at (offset), length, url, digest, page_id. Null html is an empty payload; a null url leaves the target
    out. Of rows with equal payloads of min_payload bytes or more, those with the least id are responses and the
    others revisits of it; rows with a null id are always responses. An empty table gives an empty index.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "utf-8")))
    keys = rows.filter(F.octet_length("html") >= min_payload).select("page_id", "sha")
    groups = keys.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = keys.join(groups, "sha").filter("page_id <> first").select("page_id", "sha", "first").distinct()
    rows = rows.join(again, ["page_id", "sha"], "left").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        name, out, at, archives = "", None, 0, 0
        try:
            for b in batches:
                index = []
                for page_id, url, html, first in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{archives}.warc.gz"
                        out, at, archives = store.open_output_stream(f"{base}/{name}", compression=None), 0, archives + 1
                    payload = html.encode("utf-8", "surrogatepass")
                    digest = base32_digest(payload)
                    data = record(page_id, url, payload, digest, first, date)
                    out.write(data)
                    index.append((name, at, len(data), url, digest, page_id))
                    at += len(data)
                columns = list(zip(*index, strict=True)) or [()] * 6
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), b.schema.field("page_id").type]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "at", "length", "url", "digest", "page_id"])
        finally:
            if out is not None:
                out.close()

    return materialize(rows.mapInArrow(run, f"file string, at long, length long, url string, digest string, page_id {kind}"), "warc-index")


def read_records(selected: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Fetch the records of the selected index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload if asked for.

    Rows of one stretch of an archive meet in one task, sorted; neighbours at most GAP_BYTES apart share a read of at
    most READ_BYTES (one record alone may be longer). A response's payload is held against its digest and length.
    """
    spark, kind = selected.sparkSession, selected.schema["page_id"].dataType.simpleString()
    places = selected.select("file", "at", "length").withColumn("stretch", F.floor(F.col("at") / READ_BYTES))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = places.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "at")

    def fetch(store: fs.FileSystem, base: str, run: list[tuple[str, int, int]]) -> Iterator[tuple]:
        with store.open_input_file(f"{base}/{run[0][0]}") as f:
            start = run[0][1]
            data = f.read_at(max(a + n for _, a, n in run) - start, start)
        for _, at, length in run:
            fields, http, payload = parse(data[at - start : at - start + length])
            digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
            response = fields["WARC-Type"] == "response"
            if response and (len(payload) != size or base32_digest(payload) != digest):
                raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what was written")
            name, refers = (fields.get(k, "").removeprefix("<urn:page:").removesuffix(">") or None for k in ("WARC-Record-ID", "WARC-Refers-To"))
            yield name, fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], refers, payload if payloads and response else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

        def packed(run: list[tuple[str, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*fetch(store, base, run), strict=True), types, strict=True)], names)

        run: list[tuple[str, int, int]] = []
        for b in batches:
            for place in zip(*(b[c].to_pylist() for c in ("file", "at", "length")), strict=True):
                if run and (place[0] != run[0][0] or place[1] - (run[-1][1] + run[-1][2]) > GAP_BYTES or place[1] + place[2] - run[0][1] > READ_BYTES):
                    yield packed(run)
                    run = []
                run.append(place)
        if run:
            yield packed(run)

    got = places.select("file", "at", "length").mapInArrow(read, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    out = got.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
    return out if payloads else out.drop("payload")


def archived(pages: DataFrame, min_payload: int = 0, id_col: str = "page_id") -> DataFrame:
    """Write all pages to archives in the shared folder, select every index row, and read the records back.

    See write_archives for the cases; the result has one row per row of pages, with page_id as the id's name.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder, min_payload, id_col=id_col), folder)
