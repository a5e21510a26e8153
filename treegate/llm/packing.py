"""Packing token sequences by minimum bin slack.

Only the histogram of piece lengths decides a packing, and it has at most ``capacity``
entries whatever the number of documents.  A plan is made from it on the driver: the
longest length left opens a bin, and a subset-sum dynamic program over the lengths
left, as a bitset of reachable sums, finds the fullest way to go on; that combination
is taken as many times as its lengths allow and removed.  A combination uses up one
of its lengths each time, so the plan's size is bounded by the capacity too.  The
executors then give each piece the place that its rank among the pieces of its
length has in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treegate.llm import kernels as K
from treegate.llm.common import Workspace, partitions
from treegate.llm.tokens import ENCODE_BYTES, encoder


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The lengths (longest first), each at most counts[length] times, of the greatest sum <= room.

    Among equal sums the one found first when longer lengths are offered first.
    """
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for n in lengths:
        if n > room:
            continue
        for _ in range(min(counts[n], room // n)):
            grown = (reach | reach << n) & mask
            if grown == reach:
                break
            steps.append((n, reach))
            reach = grown
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        if not before >> at & 1:
            out.append(n)
            at -= n
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many bins, lengths in each) that use up the histogram."""
    left = {n: c for n, c in histogram.items() if c}
    order = sorted(left, reverse=True)
    out = []
    while order:
        first = order[0]
        left[first] -= 1
        fill = [first, *fullest(order, left, capacity - first)]
        left[first] += 1
        uses = {n: fill.count(n) for n in set(fill)}
        times = min(left[n] // u for n, u in uses.items())
        for n, u in uses.items():
            left[n] -= times * u
        order = [n for n in order if left[n]]
        out.append((times, sorted(fill, reverse=True)))
    return out


def _places(bins: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, uses per bin, first sequence, offset of the first use), in rank order."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, fill in bins:
        offset, i = 0, 0
        while i < len(fill):
            n, u = fill[i], fill.count(fill[i])
            rows.setdefault(n, []).append((used.get(n, 0), u, sequence, offset))
            used[n] = used.get(n, 0) + u * times
            offset, i = offset + n * u, i + u
        sequence += times
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def _cutter(tokenizer: str, end_id: int, capacity: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for rows, _, _ in K.slices(batch, "text", ENCODE_BYTES):
                texts = [x or "" for x in rows.column("text").to_pylist()]
                out: list[tuple] = []
                for doc, ids in zip(rows.column("doc_id").to_pylist(), enc.encode(texts), strict=True):
                    ids += end
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        x = ids[at : at + 4 * capacity]
                        out.append((doc, p, at // 4, len(x) // 4, zlib.crc32(x), np.frombuffer(x, "<i4") if with_ids else None))
                columns = list(zip(*out, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(columns[5], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(arrays, names=names)

    return cut


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Packs every whole text into sequences of at most ``capacity`` tokens.

    A document's ids are its encoding and ``end_id``; only longer documents are cut,
    into pieces of ``capacity`` tokens and a shorter last one. One row per piece:
    (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]). Null texts
    are empty: one piece with the end id. Null and repeated doc_ids are packed like any
    other row; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = work.write(rows.mapInArrow(_cutter(tokenizer, end_id, capacity, with_ids), schema), "pieces")

    # ranks within a length: a hot length is dealt over salts, whose counts are summed up
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(partitions(spark))).cast("int"))
    counts = work.write(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = _places(plan(histogram, capacity))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = length == n
                table = places[int(n)]
                row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                turn, use = np.divmod(rank[at] - row[:, 0], row[:, 1])
                sequence[at], offset[at] = row[:, 2] + turn, row[:, 3] + use * n
            out = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            out = out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield out.append_column("ids", batch.column("ids")) if with_ids else out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return ranked.mapInArrow(place, schema)
