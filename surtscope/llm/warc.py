"""WARC archives written with an index, and read back by the index.

Writing makes one gzip member per record and an index row with the file, offset,
length, URL and digest of each. Reading starts from index rows alone: they are
sorted by file and offset, neighbours are joined into one byte range, and each
range is read once and cut into its records.

Files are written and read through ``pyarrow.fs`` in the folder shared by all
executors. A file's name is new in each attempt of a task and only index rows of
the attempt that Spark commits are kept, so lost executors leave no wrong rows.

Defined results: NULL html is an empty payload; equal payloads agree in SHA-1 and
length; the smallest page_id of a group is the response (every row that carries
it, if rows repeat); payloads shorter than ``min_revisit_bytes`` are always
responses; NULL page_ids sort last; NULL URLs are written as an empty target;
control and non-ASCII characters of a URL are percent-encoded in its header.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtscope.llm.common import materialise
from surtscope.session import run_folder

#: A task starts another file when one has reached this size.
FILE_BYTES = 512 << 20
#: Byte span of a file that one reading group covers.
SPAN_BYTES = 4 << 20
#: Records this close are fetched by one read.
GAP_BYTES = 64 << 10
#: Header date of every record: archives are reproducible byte for byte.
DATE = "2000-01-01T00:00:00Z"
#: Fixed value: the profile of revisits found by their payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = (
    "page_id long, url string, record_type string, refers_to long, file string, offset long, length long, "
    "payload_digest string, payload_bytes long"
)
_INDEX_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
    ]
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _member(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Date", DATE), *headers])
    raw = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit that names the response."""
    headers = [
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]-._~|")),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
        return _member("revisit", headers, http)
    return _member("response", headers, http + payload)


def parse(raw: bytes) -> dict:
    """Headers, kind and payload of one unpacked record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    return {"kind": fields["WARC-Type"], "fields": fields, "payload": payload}


def mark_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, revisit, refers_to). Only digests meet by group; pages
    are joined by their own id, so a group of copies does not gather their texts."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        html.alias("html"),
        F.sha1(html).alias("sha"),
        F.octet_length(html).cast("long").alias("n"),
    )
    small = rows.select("page_id", "sha", "n")
    groups = (
        small.where(F.col("n") >= min_revisit_bytes)
        .groupBy("sha", "n")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )
    later = (
        small.join(groups, ["sha", "n"])
        .where(~F.col("page_id").eqNullSafe(F.col("first")))
        .select(F.col("page_id").alias("p"), F.col("sha").alias("s"), F.col("n").alias("m"), "first")
        .distinct()
    )
    found = rows.join(
        later,
        F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")) & (F.col("n") == F.col("m")),
        "left",
    )
    return found.select(
        "page_id", "url", "html", F.col("s").isNotNull().alias("revisit"), F.col("first").alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the archives; returns the index as a stored table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, offset = None, "", 0
        info = _member("warcinfo", [("WARC-Record-ID", "<urn:info>"), ("Content-Type", "application/warc-fields")], b"")
        try:
            for batch in batches:
                for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                    rows = []
                    for page_id, url, html, revisit, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                        if out is None or offset >= FILE_BYTES:
                            if out is not None:
                                out.close()
                            name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                            out = store.open_output_stream(f"{base}/{name}", compression=None)
                            out.write(info)
                            offset = len(info)
                        payload = html.encode()
                        data = record(page_id, url, payload, refers_to, revisit)
                        out.write(data)
                        kind = "revisit" if revisit else "response"
                        rows.append((page_id, url, kind, refers_to, name, offset, len(data), base32_sha1(payload), len(payload)))
                        offset += len(data)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX_SCHEMA)], schema=_INDEX_SCHEMA
                    )
        finally:
            if out is not None:
                out.close()

    marked = mark_revisits(pages, min_revisit_bytes)
    return materialise(marked.mapInArrow(write, _INDEX), "warc-index")


def coalesce_ranges(places: list[tuple[int, int]], gap: int = GAP_BYTES) -> list[tuple[int, int, list[int]]]:
    """(start, end, members) of joint reads for (offset, length) sorted by offset."""
    ranges: list[tuple[int, int, list[int]]] = []
    for k, (offset, length) in enumerate(places):
        if ranges and offset - ranges[-1][1] <= gap:
            start, end, members = ranges[-1]
            members.append(k)
            ranges[-1] = (start, max(end, offset + length), members)
        else:
            ranges.append((offset, offset + length, [k]))
    return ranges


_READ = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "payload binary, file string, offset long, length long"
)
_READ_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("file", pa.string()),
        ("offset", pa.int64()), ("length", pa.int64()),
    ]
)


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that the index rows name. Payload figures come from the bytes
    read: a response whose payload does not match its digest is an error."""

    def read(group: pa.Table) -> pa.Table:
        store, base = fs.FileSystem.from_uri(folder)
        group = group.sort_by([("offset", "ascending")])
        files, offsets, lengths = (group.column(c).to_pylist() for c in ("file", "offset", "length"))
        rows = []
        with store.open_input_file(f"{base}/{files[0]}") as source:
            for start, end, members in coalesce_ranges(list(zip(offsets, lengths))):
                data = memoryview(source.read_at(end - start, start))
                for k in members:
                    at = offsets[k] - start
                    found = parse(zlib.decompress(data[at : at + lengths[k]], 31))
                    fields, payload = found["fields"], found["payload"]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(fields["X-Payload-Length"])
                    refers = None
                    if found["kind"] == "revisit":
                        refers = _page_of(fields["WARC-Refers-To"])
                    elif base32_sha1(payload) != digest or len(payload) != size:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                    rows.append(
                        (_page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, found["kind"],
                         refers, payload if with_payload else None, files[k], offsets[k], lengths[k])
                    )
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ_SCHEMA)], schema=_READ_SCHEMA)

    spans = index.select("file", "offset", "length", F.floor(F.col("offset") / SPAN_BYTES).alias("span"))
    return spans.groupBy("file", "span").applyInArrow(read, _READ)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write every page, then read all records back by the index."""
    folder = run_folder(pages.sparkSession, "warc")
    index = write_archives(pages, folder, min_revisit_bytes)
    return read_records(index, folder, with_payload=False).drop("payload")
