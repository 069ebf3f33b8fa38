"""WARC archives: writing, normalising monolithic gzip files to one member a record, and reading by offset.

A monolithic archive is a single gzip stream over all of its records, so no record
can be read alone.  The normaliser inflates that stream once, from front to back, and
rewrites every record as a gzip member of its own; a sidecar index keeps each
member's offset and length.  Archives are one task's work each and are streamed, so
memory depends on the longest record only.

Files go through pyarrow's file systems, so the folder may be in any store that all
executors reach.  A file is written under an attempt's own name and then moved, so a
task that is lost or run twice leaves one whole file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.tables import read, tidy, without
from heliograph.storage import Scratch, join_checked

BLOCK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
GZIP = 31


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, own: str, uri: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """A response record with its payload, or a revisit record that names the response with an equal one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{own}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k}


def records_of(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from the inflated bytes of an archive, as they stand in it."""
    held = bytearray()
    blocks = iter(blocks)
    ended = False
    while True:
        cut = held.find(b"\r\n\r\n")
        if cut >= 0:
            size = cut + 4 + int(_headers(bytes(held[:cut]))["content-length"]) + 4
            while len(held) < size and not ended:
                more = next(blocks, None)
                ended = more is None
                held += more or b""
            if len(held) < size:
                raise ValueError("the archive ends within a record")
            yield bytes(held[:size])
            del held[:size]
            continue
        more = None if ended else next(blocks, None)
        if more is None:
            if held.strip():
                raise ValueError("the archive ends within a record's header")
            return
        held += more


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or several, in bounded blocks; a file cut short is an error."""
    box, begun = zlib.decompressobj(GZIP), False
    while data := stream.read(BLOCK):
        while data:
            begun = True
            yield box.decompress(data, 16 * BLOCK)
            if box.eof:
                data, box, begun = box.unused_data, zlib.decompressobj(GZIP), False
            else:
                data = box.unconsumed_tail
    if begun:
        raise ValueError("the archive ends within a gzip member")


def parsed(raw: bytes) -> dict:
    """A record's type, ids, target, payload (None for a revisit), and its full payload's digest and length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    name = lambda x: re.sub(r"^<urn:page:|>$", "", x) if x else None
    return {
        "record_type": h["warc-type"], "record": name(h["warc-record-id"]), "uri": h["warc-target-uri"], "refers_to": name(h.get("warc-refers-to")),
        "payload": payload if h["warc-type"] == "response" else None, "payload_bytes": int(_headers(http)["content-length"]),
        "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"),
    }


#: Hadoop's names for file systems that pyarrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfs", "abfss": "abfs"}


def known(uri: str) -> str:
    """A URI as pyarrow writes it; a bare path is a local one."""
    scheme, rest = uri.split(":", 1) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri) else ("file", uri)
    return f"{SCHEMES.get(scheme.lower(), scheme)}:{rest}" if scheme != "file" or rest.startswith("//") else f"file://{rest}"


class Store:
    """A folder on any file system, addressed by its URI."""

    def __init__(self, uri: str):
        self.fs, self.base = pyarrow.fs.FileSystem.from_uri(known(uri))

    def write(self, name: str, parts: Iterator[bytes]) -> None:
        self.fs.create_dir(self.base, recursive=True)
        mine = f"{self.base}/.{name}.{uuid.uuid4().hex}"
        try:
            with self.fs.open_output_stream(mine, compression=None) as out:
                for p in parts:
                    out.write(p)
            self.fs.move(mine, f"{self.base}/{name}")
        except BaseException:  # a failed attempt leaves nothing behind
            if self.fs.get_file_info(mine).type != pyarrow.fs.FileType.NotFound:
                self.fs.delete_file(mine)
            raise

    def stream(self, name: str):
        return self.fs.open_input_stream(f"{self.base}/{name}", compression=None)

    def file(self, name: str):
        return self.fs.open_input_file(f"{self.base}/{name}")


def _written(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n = TaskContext.get().partitionId(), 0
        name = f"part-{number:06d}.warc.gz"

        def parts():
            nonlocal n
            box = zlib.compressobj(6, zlib.DEFLATED, GZIP)
            for batch in batches:
                for own, target, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    n += 1
                    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", target or "about:blank")
                    # a page without an id still has a record id of its own
                    own, payload = f"null:{number}:{n}" if own is None else own, payload or b""
                    yield box.compress(record("response" if first is None else "revisit", own, target, payload, first))
            yield box.flush()

        Store(uri).write(name, parts())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "n"])

    return run


def write_monolithic(records: DataFrame, uri: str) -> DataFrame:
    """One whole-file gzip archive for each partition of (record id, target uri, payload binary, refers_to or null); returns (name, n)."""
    return records.mapInArrow(tidy(_written(uri)), "name string, n long")


def _normalised(source: str, target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new = Store(source), Store(target)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                entries: list[tuple] = []

                def members(name=name, entries=entries):
                    offset = 0
                    with old.stream(name) as stream:
                        for raw in records_of(inflated(stream)):
                            box = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                            member = box.compress(raw) + box.flush()
                            h = parsed(raw)
                            entries.append((name, offset, len(member), h["record"], h["record_type"], h["uri"], h["payload_digest"]))
                            offset += len(member)
                            yield member

                new.write(name, members())
                fields = ("name", "offset", "length", "record", "record_type", "uri", "payload_digest")
                new.write(f"{name}.idx", (json.dumps(dict(zip(fields, e, strict=True))).encode() + b"\n" for e in entries))
                cols = list(zip(*entries, strict=True)) or [()] * 7
                kinds = (pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], list(fields))

    return run


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each archive (column name) with a gzip member a record and an index beside it; returns the index's rows."""
    schema = "name string, offset long, length long, record string, record_type string, uri string, payload_digest string"
    return archives.select("name").mapInArrow(tidy(_normalised(source, target)), schema)


def _read(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, files = Store(uri), {}
        fields = ("record", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
        kinds = (*[pa.string()] * 4, pa.int64(), pa.string(), pa.binary())
        for batch in batches:
            rows, held = [], 0
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name not in files:
                    files = {name: store.file(name)}
                files[name].seek(offset)
                got = parsed(zlib.decompress(files[name].read(length), GZIP))
                if got["payload"] is not None and (len(got["payload"]), digest_of(got["payload"])) != (got["payload_bytes"], got["payload_digest"]):
                    raise ValueError(f"{name} at {offset}: the payload is not what its header says")
                rows.append([got[f] for f in fields])
                held += length
                if held > 1 << 22 or len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(fields))
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(fields))

    return run


def read_records(index: DataFrame, uri: str) -> DataFrame:
    """Every indexed record, read alone by its offset and verified against its digest."""
    schema = "record string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    return index.select("name", "offset", "length").mapInArrow(tidy(_read(uri)), schema)


def with_revisits(pages: DataFrame, *, page_id: str = "page_id", payload: str = "payload", min_bytes: int = 0) -> DataFrame:
    """``pages`` plus refers_to: the smallest id with an equal payload of at least ``min_bytes``, null for that page itself.

    Payloads are equal if their SHA-1 is.  Rows that repeat the smallest id are all
    responses.  A page without an id refers to the smallest id of its copies, but no
    page refers to it; pages without an id alone are responses.  A null payload has no
    copy.  An empty table stays empty; an input column named refers_to is replaced.

    Copies are counted by a partial aggregate of digests.  Only ids and digests are
    joined to the first of each; whole pages then meet the table of revisits, by id,
    which is broadcast if it is small.
    """
    scratch = Scratch(pages.sparkSession, "payloads")
    base = without(pages, "refers_to")
    slim = scratch.table(base.where(F.octet_length(payload) >= min_bytes).select(F.col(page_id).alias("id"), F.sha1(payload).alias("digest")), "digests")
    several = scratch.table(slim.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1 and first is not null").drop("n"), "several")
    revisits = join_checked(slim, several, "digest").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "digest", "first").distinct()
    revisits = scratch.table(revisits, "revisits")
    same = F.col(page_id).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.sha1(payload)) & (F.octet_length(payload) >= min_bytes)
    joined = join_checked(base, revisits.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("first").alias("refers_to")), same, "left")
    return joined.drop("__id", "__digest")


def op9_gzip_normaliser(spark, sf_dir):
    """Pages written to monolithic archives, normalised, and read back record by record."""
    scratch = Scratch(spark, "warc")
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = with_revisits(pages).select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"))
    archives = scratch.table(write_monolithic(rows, f"{scratch.base}/monolithic"), "archives")
    archives = archives.repartition(max(1, archives.count()))
    index = scratch.table(normalise(archives, f"{scratch.base}/monolithic", f"{scratch.base}/members"), "index")
    scratch.drop("monolithic")
    back = read_records(index, f"{scratch.base}/members")
    page = F.when(~F.col("record").startswith("null"), F.col("record")).cast("long")
    return back.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: printf('%04d', ['0','1','10','11','100','101','110','111','1000','1001','1010','1011','1100','1101','1110','1111'][('0x' || hex[i])::INT + 1]::INT)), '') AS b FROM payloads),
first AS (SELECT html, min(page_id) AS page_id FROM payloads GROUP BY html)
SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[16 * b[5 * i + 1]::INT + 8 * b[5 * i + 2]::INT + 4 * b[5 * i + 3]::INT + 2 * b[5 * i + 4]::INT + b[5 * i + 5]::INT + 1]), '') AS payload_digest,
 CASE WHEN f.page_id IS NOT DISTINCT FROM p.page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f.page_id IS DISTINCT FROM p.page_id THEN f.page_id END AS refers_to
FROM bits p JOIN first f USING (html)
"""
