"""WARC archives of pages: written, normalised to one gzip member per record, indexed and read back.

An archive as crawlers often leave it is one gzip stream over all records, so nothing in
it can be reached without inflating all before it.  The normaliser inflates such a
stream once, finds each record by its ``Content-Length``, deflates it as a member of
its own, byte for byte, and notes where the member starts: the sidecar index, one JSON
line a record.  Any record is then one range read and one inflate.  Heads are read as
they are met: names in any case, with or without a blank after the colon, folded over
lines, in UTF-8 or Latin-1, with bare line feeds.

Which archives count is said by a manifest, not by what lies in the folder: a task that
ran twice leaves files of its own names, and only those of the attempt that Spark took
are listed.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treegate.llm.common import Workspace, likely, marked, partitions
from treegate.llm.tokenids import put

#: Payload bytes of an archive, and the gzip level of members.
ARCHIVE_BYTES, LEVEL = 32_000_000, 1
#: Payloads under this many bytes are never revisits.
REVISIT_BYTES = 100

_DATE = "2024-01-01T00:00:00Z"


def record(kind: str, url: str | None, record_id: str, digest: str, payload: bytes, headers: dict[str, str] | None = None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload of its own."""
    named = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{record_id}>", "WARC-Date": _DATE}
    if url:
        named["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    named |= {"WARC-Payload-Digest": f"sha256:{digest}", **(headers or {}), "Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items())
    return head.encode() + b"\r\n" + payload + b"\r\n\r\n"


class Headers(dict):
    """A record's named fields; names count in any case."""

    def __init__(self, head: bytes):
        super().__init__()
        lines = re.split(rb"\r?\n", head)
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        name = None
        for line in lines[1:]:
            if line[:1] in (b" ", b"\t") and name is not None:
                self[name] += b" " + line.strip()
            elif line:
                name, _, value = line.partition(b":")
                name = name.strip().lower()
                self.setdefault(name, value.strip())

    def text(self, name: str) -> str | None:
        value = self.get(name.lower().encode())
        if value is None:
            return None
        try:
            return value.decode()
        except UnicodeDecodeError:
            return value.decode("latin-1")

    @property
    def length(self) -> int:
        value = self.get(b"content-length", b"")
        if not value.isdigit():
            raise ValueError("a record without its Content-Length")
        return int(value)


def parse(data: bytes) -> tuple[Headers, bytes]:
    """The headers and the block of one record."""
    end = re.search(rb"\r?\n\r?\n", data)
    if end is None:
        raise ValueError("a record without the end of its head")
    headers = Headers(bytes(data[: end.start()]))
    return headers, data[end.end() : end.end() + headers.length]


def records(stream) -> Iterator[tuple[Headers, bytes]]:
    """The records of an inflated stream with their headers, each as it stands, without reading ahead of one."""
    while True:
        head = bytearray()
        while True:
            line = stream.readline()
            if not line:
                if head:
                    raise ValueError("the stream ends inside a record's head")
                return
            if line in (b"\r\n", b"\n"):
                if not head:
                    continue  # blank lines between records
                break
            head += line
        headers = Headers(bytes(head))
        body = stream.read(headers.length)
        if len(body) < headers.length:
            raise ValueError("the stream ends inside a record")
        yield headers, bytes(head) + line + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, the same bytes for the same record."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def normalise(source, target) -> list[dict]:
    """Rewrites one whole-file gzip stream (or any members) as one member per record; the index rows."""
    index, at = [], 0
    with gzip.GzipFile(fileobj=source) as inflated:
        for headers, data in records(io.BufferedReader(inflated, 1 << 20)):
            packed = member(data)
            target.write(packed)
            index.append({"id": headers.text("WARC-Record-ID"), "type": headers.text("WARC-Type"), "url": headers.text("WARC-Target-URI"), "offset": at, "length": len(packed)})
            at += len(packed)
    return index


def read_at(data, offset: int, length: int) -> tuple[Headers, bytes]:
    """A record by its place: one inflate of its own member."""
    return parse(zlib.decompress(data[offset : offset + length], 31))


def _payload() -> F.Column:
    return F.encode(F.coalesce("html", F.lit("")), "UTF-8")


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Monolithic archives, then their normal form and index; one row per archive."""
        from pyspark import TaskContext

        part, seq, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex[:12]
        raw, count, size = io.BytesIO(), 0, 0
        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)

        def flush() -> pa.RecordBatch:
            nonlocal raw, count, size, seq, deflate
            raw.write(deflate.flush())
            name = f"pages-{part:06d}-{seq:06d}-{attempt}"
            put(f"{folder}/raw/{name}.warc.gz", raw.getvalue())
            where, path = fs.FileSystem.from_uri(f"{folder}/raw/{name}.warc.gz")
            out = io.BytesIO()
            with where.open_input_stream(path, compression=None) as source:
                index = normalise(source, out)
            put(f"{folder}/warc/{name}.warc.gz", out.getvalue())
            put(f"{folder}/warc/{name}.index", "".join(json.dumps(x) + "\n" for x in index).encode())
            where.delete_file(path)
            row = pa.record_batch([pa.array([f"{name}.warc.gz"]), pa.array([count], pa.int64()), pa.array([out.tell()], pa.int64())], names=["file", "records", "bytes"])
            raw, count, size, seq, deflate = io.BytesIO(), 0, 0, seq + 1, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            return row

        for batch in batches:
            for page, url, payload, digest, length, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "size", "refers_to")), strict=True):
                name = "null" if page is None else str(page)
                if refers is None:
                    data = record("response", url, name, digest, payload)
                else:
                    data = record("revisit", url, name, digest, b"", {"WARC-Refers-To": f"<urn:page:{refers}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Payload-Bytes": str(length)})
                raw.write(deflate.compress(data))
                count, size = count + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if count:
            yield flush()

    return write


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to ``folder``/warc; one row per archive: (file, records, bytes).

    Among pages of equal payloads of at least 100 bytes the smallest page_id is the
    response and the others are revisits of it; pages that repeat that page_id with the
    same payload are responses too. Null html is an empty payload. A page with a null
    page_id is always a response. Who is what is decided on digests alone: payloads are
    read where they are written, and only those that a bitmap can't clear are shuffled.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "pages")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _payload().alias("payload")).withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    slim = work.write(rows.drop("payload"), "slim")
    shared = slim.where((F.col("size") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    # minima combine before the shuffle, so a payload that many pages share is a row a task
    first = work.write(shared.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    revisits = work.write(shared.join(first, "digest").where("page_id > first").select("page_id", "url", "size", "digest", F.col("first").alias("refers_to")), "revisits")
    # the others, with their payloads: those that the bitmap of revisits clears, and those that it wrongly holds
    key = ("page_id", "digest")
    clear = marked(rows, revisits, *key).where("not __maybe").drop("__maybe")
    held = likely(slim, revisits, *key).alias("s").join(revisits.select(*key).alias("r"), _same(key, "s", "r"), "left_anti").select(*key)
    held = work.write(held.distinct(), "held")
    wrongly = likely(rows, held, *key).alias("s").join(held.alias("r"), _same(key, "s", "r"), "left_semi")
    responses = clear.unionByName(wrongly).withColumn("refers_to", F.lit(None).cast("long"))
    every = responses.unionByName(revisits.withColumn("payload", F.lit(None).cast("binary")))
    where, path = fs.FileSystem.from_uri(f"{folder}/warc")
    for at in (path, f"{path[: -len('/warc')]}/raw"):
        where.create_dir(at, recursive=True)
    written = every.select("page_id", "url", "payload", "digest", "size", "refers_to").mapInArrow(_writer(folder), "file string, records long, bytes long")
    manifest = Workspace(spark, path=folder).write(written, "manifest")
    work.delete("")
    return manifest


def _same(key: tuple[str, ...], a: str, b: str) -> F.Column:
    out = F.lit(True)
    for c in key:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Reads every record of the archives in the manifest by the sidecar index: (page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]).

    A response's digest and size are computed from its payload; a revisit's are those
    of its record, which the writer took from the full payload.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def number(urn: str) -> int | None:
        text = urn.removeprefix("<urn:page:").removesuffix(">")
        return None if text == "null" else int(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                where, at = fs.FileSystem.from_uri(f"{folder}/warc/{name}")
                with where.open_input_stream(at.removesuffix(".warc.gz") + ".index", compression=None) as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                with where.open_input_stream(at, compression=None) as f:
                    data = f.read()
                out, held = [], 0
                for i, x in enumerate(index):
                    headers, payload = read_at(data, x["offset"], x["length"])
                    kind, digest = headers.text("WARC-Type"), headers.text("WARC-Payload-Digest").removeprefix("sha256:")
                    if kind == "response":
                        size, found = len(payload), hashlib.sha256(payload).hexdigest()
                        if found != digest:
                            raise ValueError(f"{name}: record {i} doesn't have its digest")
                        refers = None
                    else:
                        size, refers = int(headers.text("X-Payload-Bytes")), number(headers.text("WARC-Refers-To"))
                    out.append((number(headers.text("WARC-Record-ID")), headers.text("WARC-Target-URI"), size, digest, kind, refers, payload))
                    held += len(payload)
                    if len(out) == 2_000 or held > 8_000_000 or i == len(index) - 1:
                        yield pa.record_batch([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds[: 6 + with_payload])], names=[*names, "payload"][: 6 + with_payload])
                        out, held = [], 0

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    manifest = Workspace(spark, path=folder).read("manifest")
    files = manifest.count()
    return manifest.select("file").repartition(max(1, min(files, max(partitions(spark), files // 16)))).mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives in the shared folder and reads them back; see the two functions for nulls and repeats.

    An empty table gives an empty result.
    """
    folder = Workspace(pages.sparkSession, f"warc-{uuid.uuid4().hex[:8]}").path
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder)
