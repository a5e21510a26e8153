"""Removal of byte strings that occur more than once, by a sorted sparse suffix array.

A byte goes if a ``length``-byte string over it also starts anywhere else.  Sorting every
suffix of a corpus moves ``length`` times its bytes, so suffixes are sorted in three
rounds, each over what the last one left open.  A round is the same: sampled splitters
range-partition the suffixes by their leading bytes, each partition is sorted in byte
order, and neighbours are compared, across partition boundaries too.  As the keys end in
the suffix's own place, splitters cut inside a group of equal suffixes, so a passage that
a third of all documents hold is dealt over many tasks.

Round 1: every window of ``length`` bytes has an anchor, the leftmost place of the least
hash among its ``ANCHOR``-byte strings; equal windows have it at the same offset.  The
suffixes are those at anchors, about one in 70 places, in the order of their ``ANCHOR``
leading bytes.  Windows that share an anchor form a region.  Regions with equal bytes
repeat as a whole; a region whose anchor string is unique holds no repeat; the others are
open, and go on together with one or two of each kind of equal regions that share their
anchor string.
Round 2: open regions are cut into blocks of ``BLOCK`` windows.  Blocks with equal bytes
repeat; a block whose bytes common to all its windows are unique holds no repeat; the
others are open in the same way.
Round 3: the windows of blocks still open, one suffix each.

The local sort is Spark's, which spills; like a multikey quicksort it compares eight
leading bytes at first and goes on where they tie.  In rounds 2 and 3 a fingerprint
follows the leading bytes.  Strings count as equal if, beside the bytes or the
fingerprint that brought them together, 64 bits of hash over the ``length`` bytes (or
the whole region) agree; all of them are under 512 bytes, so short that polynomials
modulo 2**64 tell them apart however regular they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treegate.llm import kernels as K
from treegate.llm.common import Workspace, carried, unpacked

LENGTH, ANCHOR, BLOCK = 200, 64, 16
#: Bytes of one text looked at together; longer texts overlap by ``length`` - 1.
PIECE = 4_000_000
_TAG = 17  # further bits of a text's hash, beside the 64 of rid
_U = np.uint64


def _pack(lo, offset, more, tag) -> np.ndarray:
    """Windows lo..lo + more, whose anchor is at lo + offset, of a row with this tag."""
    out = lo.astype(np.uint64) << _U(33) | offset.astype(np.uint64) << _U(25) | more.astype(np.uint64) << _U(17) | tag.astype(np.uint64)
    return out.view(np.int64)


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    p = packed.view(np.uint64)
    return (p >> _U(33)).astype(np.int64), (p >> _U(25) & _U(255)).astype(np.int64), (p >> _U(17) & _U(255)).astype(np.int64), (p & _U((1 << _TAG) - 1)).astype(np.int64)


def _leading(buf: np.ndarray, at: np.ndarray, width: int, *after: np.ndarray) -> pa.Array:
    """Sort keys: ``width`` leading bytes of the suffixes, then the bytes of further numbers."""
    parts = [np.lib.stride_tricks.sliding_window_view(buf, width)[at]] if len(at) else [np.zeros((0, width), np.uint8)]
    parts += [np.ascontiguousarray(x.astype(">u8")).view(np.uint8).reshape(-1, 8) for x in after]
    return _binary(np.concatenate(parts, axis=1), np.ones(len(at), bool))


def _binary(rows: np.ndarray, there: np.ndarray) -> pa.Array:
    """A binary column of rows of equal width; empty where not ``there``."""
    offsets = np.concatenate([[0], np.cumsum(there * rows.shape[1])]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows[there]))])


def _matrix(column: pa.Array) -> np.ndarray:
    """A binary column whose values have one width, as a matrix of bytes."""
    _, offsets, data = column.buffers()
    cut = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[cut[0] : cut[-1]].reshape(len(column), -1)


def _regions_of(buf: np.ndarray, offs: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, hash of all bytes) of the regions of some rows."""
    prefix = K.prefix_hash(buf)
    _, inverse = K._powers(len(prefix))
    n = len(buf) - k + 1
    grams = K.mix((prefix[k:] - prefix[:-k]) * inverse[:n])
    least = grams & _U(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
    width, step = length - k + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[: len(least) - step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - width + step], least[width - step :])
    end = np.repeat(offs[1:], np.diff(offs))[: len(least)]
    window = np.flatnonzero(np.arange(len(least)) + length <= end)
    anchor = (least[window] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi, anchor = window[first], window[np.append(first[1:], len(window)) - 1] if len(first) else window, anchor[first]
    return lo, hi, anchor, K.range_hash(prefix, lo, hi + length)


def _regions(length: int, k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release_caches()
        for batch in batches:
            for rows, buf, offs in K.slices(batch, "text"):
                rid, tag = rows.column("rid").to_numpy(), rows.column("tag").to_numpy()
                whole = rows.num_rows > 1 or len(buf) <= PIECE + length
                for start in [0] if whole else range(0, len(buf) - length + 1, PIECE):
                    part = buf if whole else buf[start : start + PIECE + length - 1]
                    cut = offs if whole else np.array([0, len(part)])
                    if len(part) < length:
                        continue
                    lo, hi, anchor, sub = _regions_of(part, cut, length, k)
                    row = np.searchsorted(cut, lo, side="right") - 1
                    packed = _pack(lo - cut[row] + start, anchor - lo, hi - lo, tag[row])
                    yield pa.record_batch([_leading(part, anchor, k), *(pa.array(K.signed(x), pa.int64()) for x in (sub, rid[row], packed))], names=["key", "sub", "rid", "pack"])

    return find


def _status(left_key, left, right_key, right) -> np.ndarray:
    """1: a neighbour has (key, sub). 3: so, and one has the key alone. 2: one has the key alone. 0: none."""
    alone = (left_key & ~left) | (right_key & ~right)
    return np.where(left | right, np.where(alone, 3, 1), np.where(alone, 2, 0))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks rows sorted by (key, sub) with :func:`_status`, and drops those of status 0.

    A partition's first and last row are kept with edge 1 and 2 (3: both) and what is
    known of their neighbours (``near``), which may stand in another partition.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: dict[str, np.ndarray] | None = None
    held_left = (np.zeros(1, bool), np.zeros(1, bool))
    fresh = True  # no row has gone out yet

    def rows(columns, left, right, edge):
        status = _status(left[0], left[1], right[0], right[1])
        near = left[0] + 2 * left[1] + 4 * right[0] + 8 * right[1]
        keep = np.flatnonzero((status > 0) | (edge > 0))
        # keys are only looked at again at edges
        arrays = [_binary(x[keep], edge[keep] > 0) if c == "key" else pa.array(x[keep], pa.int64()) for c, x in columns.items()]
        more = [pa.array(x[keep], pa.int32()) for x in (status, edge, near, np.full(len(edge), part))]
        return pa.record_batch([*arrays, *more], names=[*columns, "status", "edge", "near", "part"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: _matrix(batch.column(c)) if c == "key" else batch.column(c).to_numpy() for c in batch.schema.names}
        if held is not None:
            columns = {c: np.concatenate([held[c], x]) for c, x in columns.items()}
        n = len(columns["key"]) - 1
        same_key = (columns["key"][1:] == columns["key"][:-1]).all(axis=1)
        same = same_key & (columns["sub"][1:] == columns["sub"][:-1])
        left = [np.concatenate([held_left[i], x]) for i, x in enumerate((same_key, same))]
        if n:
            edge = np.zeros(n, np.int64)
            edge[0] = fresh
            fresh = False
            yield rows({c: x[:n] for c, x in columns.items()}, [x[:n] for x in left], (same_key, same), edge)
        held, held_left = {c: x[n:] for c, x in columns.items()}, tuple(x[n:] for x in left)
    if held is not None:
        none = np.zeros(1, bool)
        yield rows(held, held_left, (none, none), np.array([3 if fresh else 2]))


def _round(suffixes: DataFrame, work: Workspace, name: str) -> DataFrame:
    """One sort: (status, rid, pack, ...) of suffixes whose neighbour agrees, see :func:`_neighbours`."""
    order = ["key", "sub", "rid", "pack"]
    dealt = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = ", ".join(f"{c} {'binary' if c == 'key' else 'long'}" for c in suffixes.columns)
    marked = work.write(dealt.mapInArrow(_neighbours, f"{columns}, status int, edge int, near int, part int"), name)
    rest = [c for c in suffixes.columns if c not in ("key", "sub")]
    # two rows a partition: the only ones that are looked at in one task
    line = Window.orderBy("part", "edge")
    yes = lambda c: F.coalesce(c, F.lit(False))
    bit = lambda n: F.col("near").bitwiseAND(F.lit(n)) > 0
    known = marked.where("edge > 0")
    for side, step, n, edges in (("left", F.lag, 1, (1, 3)), ("right", F.lead, 4, (2, 3))):
        at = F.col("edge").isin(*edges)
        known = known.withColumn(f"{side}_key", bit(n) | (at & yes(step("key").over(line) == F.col("key"))))
        known = known.withColumn(side, bit(2 * n) | (at & yes((step("key").over(line) == F.col("key")) & (step("sub").over(line) == F.col("sub")))))
    alone = (F.col("left_key") & ~F.col("left")) | (F.col("right_key") & ~F.col("right"))
    status = F.when(F.col("left") | F.col("right"), F.when(alone, 3).otherwise(1)).otherwise(F.when(alone, 2).otherwise(0))
    return marked.where("edge = 0").select("status", *rest).unionByName(known.withColumn("status", status).where("status > 0").select("status", *rest))


def _cut_regions(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of each open region."""
        for batch in batches:
            for rows, buf, offs in K.slices(batch, "text"):
                lists = rows.column("packs")
                packs = lists.flatten().to_numpy()
                row = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
                lo, _, more, _ = _unpack(packs)
                data = buf.tobytes()
                starts = offs[row] + lo
                parts = [data[a:b] for a, b in zip(starts.tolist(), (starts + more + length).tolist(), strict=True)]
                for i in range(0, len(parts), 20_000):
                    yield pa.record_batch([pa.array(rows.column("rid").to_numpy()[row[i : i + 20_000]], pa.int64()), pa.array(packs[i : i + 20_000], pa.int64()), pa.array(parts[i : i + 20_000], pa.binary())], names=["rid", "pack", "bytes"])

    return cut


def _blocks(length: int, size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in K.slices(batch, "bytes"):
                rid, ref = rows.column("rid").to_numpy(), rows.column("pack").to_numpy()
                lo, offset, more, tag = _unpack(ref)
                least, most = (offset - more) // size, offset // size
                r = np.repeat(np.arange(len(lo)), most - least + 1)
                q = np.arange(len(r)) - np.repeat(np.cumsum(most - least + 1) - (most - least + 1), most - least + 1) + least[r]
                x, y = np.maximum((offset - more)[r], q * size), np.minimum(offset[r], q * size + size - 1)
                anchor = offs[r] + offset[r]
                one, two = K.prefix_hash(buf), K.prefix_hash(buf, 1)
                core = K.range_hash(one, anchor - q * size, anchor - (q * size + size - 1) + length)
                hull = K.range_hash(two, anchor - y, anchor - x + length)
                hull = K.mix(hull + x.astype(np.uint64) * _U(256) + y.astype(np.uint64))
                key = _leading(buf, anchor - q * size, min(ANCHOR, length - size + 1), K.mix(core + q.astype(np.uint64)))  # windows of blocks at other offsets are others
                packed = _pack(lo[r] + offset[r] - y, y, y - x, tag[r])
                yield pa.record_batch([key, *(pa.array(K.signed(v), pa.int64()) for v in (hull, rid[r], packed, ref[r]))], names=["key", "sub", "rid", "pack", "ref"])

    return cut


def _windows(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in K.slices(batch, "bytes", K.SLICE_BYTES // 4):
                lo, _, more, tag = _unpack(rows.column("pack").to_numpy())
                start = _unpack(rows.column("ref").to_numpy())[0]
                r = np.repeat(np.arange(len(lo)), more + 1)
                s = lo[r] + np.arange(len(r)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
                at = offs[r] + s - start[r]
                one, two = K.prefix_hash(buf), K.prefix_hash(buf, 1)
                key = _leading(buf, at, ANCHOR, K.range_hash(one, at, at + length))
                zero = np.zeros(len(s), np.int64)
                packed = _pack(s, zero, zero, tag[r])
                yield pa.record_batch([key, *(pa.array(K.signed(v), pa.int64()) for v in (K.range_hash(two, at, at + length), rows.column("rid").to_numpy()[r], packed))], names=["key", "sub", "rid", "pack"])

    return cut


def covered_spans(n_bytes: int, packs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes under repeated windows, as starts and ends."""
    if not len(packs):
        return packs, packs
    lo, _, more, _ = _unpack(packs)
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate((lo + more + length)[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > end[:-1]
    first = np.flatnonzero(new)
    return lo[first], end[np.append(first[1:], len(lo)) - 1]


def _identity(doc_id: F.Column) -> dict[str, F.Column]:
    """A row's identity: ``rid``, 64 bits of hash over doc_id and text, and ``tag``, _TAG bits over the text.

    Rows that share it have equal texts, and so the same repeats.
    """
    return {"rid": F.xxhash64(F.lit(1), doc_id.cast("long"), "text"), "tag": F.pmod(F.xxhash64("text"), F.lit(1 << _TAG)).cast("int")}


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumns(_identity(F.col("doc_id")))


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rid, tag, packs): per row of ``docs`` that has any, its windows that occur anywhere else."""
    if not ANCHOR < length < ANCHOR + 256:
        raise ValueError(f"length: over {ANCHOR} and under {ANCHOR + 256}")
    work = Workspace(docs.sparkSession, "suffix")
    rows = _marked(docs.select("doc_id", "text")).select("rid", "tag", "text")
    four = "key binary, sub long, rid long, pack long"
    tag = F.col("pack").bitwiseAND(F.lit((1 << _TAG) - 1)).cast("int")

    places = _round(rows.where(F.octet_length("text") >= length).mapInArrow(_regions(length, ANCHOR), four), work, "regions")
    found = [places.where("status in (1, 3)").select("rid", "pack")]
    wanted = places.where("status in (2, 3)").groupBy("rid", tag.alias("tag")).agg(F.collect_list("pack").alias("packs"))
    opened = work.write(rows.join(wanted, ["rid", "tag"]).select("rid", "text", "packs").mapInArrow(_cut_regions(length), "rid long, pack long, bytes binary"), "open")

    blocks = _round(opened.mapInArrow(_blocks(length, BLOCK), f"{four}, ref long"), work, "blocks")
    found.append(blocks.where("status in (1, 3)").select("rid", "pack"))
    left = blocks.where("status in (2, 3)").select("rid", "pack", "ref")
    held = left.join(opened.withColumnRenamed("pack", "ref"), ["rid", "ref"]).select("rid", "pack", "ref", "bytes")
    windows = _round(held.mapInArrow(_windows(length), four), work, "windows")
    found.append(windows.where("status in (1, 3)").select("rid", "pack"))
    every = found[0].unionByName(found[1]).unionByName(found[2])
    out = work.write(every.groupBy("rid", tag.alias("tag")).agg(F.collect_list("pack").alias("packs")), "found")
    for name in ("regions", "open", "blocks", "windows"):
        work.delete(name)
    return out


def _removal(length: int, with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release_caches()
        for batch in batches:
            for rows, buf, offs in K.slices(batch, "text"):
                lists = rows.column("packs").to_pylist() if rows.column("packs").null_count == rows.num_rows else None
                data = memoryview(buf.tobytes())
                out: list[tuple] = []
                for i in range(rows.num_rows):
                    a, n = int(offs[i]), int(offs[i + 1] - offs[i])
                    packs = None if lists is not None else rows.column("packs")[i].values
                    starts, ends = covered_spans(n, packs.to_numpy() if packs is not None else np.zeros(0, np.int64), length)
                    kept, at = [], 0
                    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                        kept.append(data[a + at : a + s])
                        at = e
                    kept.append(data[a + at : a + n])
                    if len(ends) and ends[-1] > n:
                        raise ValueError("repeats past the end of a text: its row has changed")
                    removed = int((ends - starts).sum())
                    if with_text:
                        out.append((_whole_characters(bytes(data[a : a + n]), starts, ends), removed))
                    else:
                        digest = hashlib.sha256()
                        for part in kept:
                            digest.update(part)
                        out.append((n, removed, len(starts), digest.hexdigest()))
                rest = [c for c in rows.schema.names if c != "packs" and (with_text or c != "text")]
                if with_text:
                    new = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())]
                    rest = [c for c in rest if c != "text"]
                    yield pa.record_batch([*(rows.column(c) for c in rest), *new], names=[*rest, "text", "n_removed"])
                else:
                    new = [pa.array([x[j] for x in out], pa.string() if j == 3 else pa.int64()) for j in range(4)]
                    yield pa.record_batch([*(rows.column(c) for c in rest), *new], names=[*rest, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return remove


def _whole_characters(text: bytes, starts: np.ndarray, ends: np.ndarray) -> str:
    """What stays if only characters wholly inside the spans go."""
    kept, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    return b"".join(kept).decode("utf-8")


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_bytes, n_removed, n_spans, kept_sha256).

    Texts are UTF-8 bytes (null: empty), matches never cross documents, and every
    byte under a ``length``-byte string that also starts anywhere else counts as
    removed, judged on the input. Rows that repeat a doc_id are documents of their
    own, so equal ones of at least ``length`` bytes lose everything; null doc_ids are
    documents like any other. An empty table gives an empty result.
    """
    found = repeated_windows(docs, length)
    rows = _marked(docs.select("doc_id", "text"))
    joined = rows.join(found, ["rid", "tag"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "packs")
    return joined.mapInArrow(_removal(length, False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, into: str = "n_removed") -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``, and ``into``, the bytes that repeat.

    As :func:`repeat_report`, but a character is only cut if all of its bytes repeat,
    so the text stays UTF-8. Null texts stay null. Other columns pass through whatever
    their names; one named ``into`` gives way.
    """
    found = repeated_windows(docs, length).select(F.col("rid").alias("__rid"), F.col("tag").alias("__tag"), F.col("packs").alias("__packs"))
    names, packed = carried(docs, into)
    rows = packed.withColumns(_identity(F.col("row.doc_id")))
    joined = rows.join(found, (F.col("rid") == F.col("__rid")) & (F.col("tag") == F.col("__tag")), "left").select("row", F.col("text").isNull().alias("missing"), "text", F.col("__packs").alias("packs"))
    fields = [joined.schema["row"], T.StructField("missing", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())]
    cut = joined.mapInArrow(_removal(length, True), T.StructType(fields))
    return cut.select(*unpacked(names, F.when(~F.col("missing"), F.col("text"))), F.col("n_removed").alias(into))
