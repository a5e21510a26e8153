"""Documents to token-id files and back.

A file is a row of segments, each of which is a whole one of :mod:`treegate.llm.dac` and
can be read alone; a manifest has a row per segment. Only files that it names count, so
what a repeated task left behind is never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treegate.llm import kernels as K
from treegate.llm import dac
from treegate.llm.common import Workspace, partitions
from treegate.llm.tokens import ENCODE_BYTES, encoder

#: Tokens after which a writer starts its next segment, and segments after which its next file (about 250 MB).
SEGMENT_TOKENS, FILE_SEGMENTS = 1_000_000, 128
#: Word pieces that a writer keeps encoded: about 250 MB.
CACHE_PIECES = 1_400_000


def put(uri: str, data: bytes) -> None:
    """Writes a file whole: under a name of this attempt first, so a repeated task leaves one good file."""
    where, path = fs.FileSystem.from_uri(uri)
    part = f"{path.rpartition('/')[0]}/_part-{uuid.uuid4().hex}"
    with where.open_output_stream(part, compression=None) as out:
        out.write(data)
    where.move(part, path)


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt, segment, at = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0, 0
        enc, end = encoder(tokenizer, CACHE_PIECES), np.array([end_id], "<u4").tobytes()
        where, path = fs.FileSystem.from_uri(folder)
        out = name = None
        doc_ids: list[int | None] = []
        pieces: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, held, doc_ids, pieces, out, name, at
            if segment % FILE_SEGMENTS == 0:
                if out is not None:
                    out.close()
                name, at = f"tokens-{part:06d}-{segment // FILE_SEGMENTS:06d}-{attempt}.dac", 0
                out = where.open_output_stream(f"{path}/{name}", compression=None)
            lengths = np.array([len(x) // 4 for x in pieces], np.int64)
            data = dac.encode(doc_ids, lengths, np.frombuffer(b"".join(pieces), "<u4"))
            out.write(data)
            row = [[part], [segment], [name], [at], [len(data)], [len(pieces)], [held]]
            segment, at, held, doc_ids, pieces = segment + 1, at + len(data), 0, [], []
            return pa.record_batch([pa.array(x, t) for x, t in zip(row, _SEGMENT.types, strict=True)], names=_SEGMENT.names)

        for batch in batches:
            for rows, _, _ in K.slices(batch, "text", ENCODE_BYTES):
                texts = [x or "" for x in rows.column("text").to_pylist()]
                for doc, ids in zip(rows.column("doc_id").to_pylist(), enc.encode(texts), strict=True):
                    doc_ids.append(doc)
                    pieces.append(ids + end)
                    held += len(pieces[-1]) // 4
                    if held >= SEGMENT_TOKENS:
                        yield flush()
        if pieces:
            yield flush()
        if out is not None:
            out.close()

    return write


_SEGMENT = pa.schema([("part", pa.int64()), ("segment", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("bytes", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64())])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encodes every whole text, appends ``end_id`` and writes token files in ascending doc_id order.

    Returns the manifest, one row per segment: (part, segment, file, at, bytes,
    documents, tokens, start), in the order of part and segment; ``start`` counts the
    tokens of all segments before. Null texts are empty (the end id alone), null
    doc_ids come first; rows that repeat a doc_id are all written, and many of them are
    dealt over several tasks. An empty table gives no file.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in zip(_SEGMENT.names, _SEGMENT.types, strict=True))
    made = Workspace(spark, path=folder).write(dealt.select("doc_id", "text").mapInArrow(_writer(folder, tokenizer, end_id), schema), "segments")
    # only the sums of parts, as many as there were tasks, are ordered as a whole
    earlier = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = made.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    bases = sums.select("part", earlier(Window.orderBy("part")).alias("base"))
    within = made.withColumn("start", earlier(Window.partitionBy("part").orderBy("segment")))
    return within.join(bases, "part").withColumn("start", F.col("start") + F.col("base")).drop("base")


def read_token_files(segments: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Reads the segments of a manifest back: (doc_id, start, n_tokens, ids_crc32[, ids]); ``start`` counts all tokens before."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, at, size, base in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "bytes", "start")), strict=True):
                with where.open_input_file(f"{path}/{name}") as source:
                    f = dac.TokenFile(source.read_at(size, at))
                ids = f.all()
                cuts = [ids[a:b] for a, b in zip(f.starts[:-1], f.starts[1:], strict=True)]
                columns = [pa.array(f.doc_ids, pa.int64()), pa.array(f.starts[:-1] + base, pa.int64()), pa.array(np.diff(f.starts), pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cuts], pa.int64())]
                if with_ids:
                    columns.append(pa.array(cuts, pa.list_(pa.int64())))
                yield pa.record_batch(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    n = segments.count()
    dealt = segments.select("file", "at", "bytes", "start").repartition(max(1, min(n, max(partitions(segments.sparkSession), n // 16))))
    return dealt.mapInArrow(read, schema)


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes token files and reads them back: (doc_id, start, n_tokens, ids_crc32) per document row.

    ``start`` counts the ids of all documents before it. See :func:`write_token_files`
    for nulls, repeats and empty tables.
    """
    folder = Workspace(docs.sparkSession, "tokens").path
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id), folder)
