"""Near-duplicate detection over whole texts: sketches, bands, exact verification, components.

1. One pass makes each document's set of distinct k-word shingles, its fingerprint and
   its bands (:mod:`treegate.llm.minhash`).  Documents with the same set form one
   class; from here on only the class's smallest doc_id counts, so thousands of exact
   copies cost one row.
2. Documents that share a band are candidates.  In each band's bucket only the smallest
   id is compared with the rest (a star), on full sets.
3. Components of the confirmed links.  Where the candidates of one smallest id ended in
   several components, the pairs across components are compared too, in blocks of
   bounded size, so no link is lost to the star; pairs inside a component cannot
   change anything and are never formed, nor are pairs of sets whose sizes alone rule
   a link out: blocks hold sets of about one size and meet only those next in size.
4. Components of all links.

With 256 bins in 42 bands of 6, two documents of similarity 0.8 share no band with a
probability of about 3e-6, and two of similarity 0.4 share one with 0.16.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treegate.llm import kernels as K
from treegate.llm.common import Workspace, likely, list_of
from treegate.llm.graph import connected_components
from treegate.llm.minhash import FastSimilaritySketch, band_keys

BINS, BAND_ROWS = 256, 6
#: Members of one block in step 3; a task holds two blocks.
BLOCK = 256


def _row_sets(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray, k: int) -> Iterator[np.ndarray]:
    starts, ends, first = K.word_bounds(buf, offs)
    hashes = K.word_hashes(buf, starts, ends)
    for i in range(rows.num_rows):
        yield K.row_shingles(hashes[first[i] : first[i + 1]], k)


def _sketcher(k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release_caches()
        sketcher = FastSimilaritySketch(BINS)
        odd = np.uint64(0xC2B2AE3D27D4EB4F)
        for batch in batches:
            for rows, buf, offs in K.slices(batch, "text"):
                sizes, prints, bands, counts = [], [], [], []
                for x in _row_sets(rows, buf, offs, k):
                    sizes.append(len(x))
                    prints.append((K.mix(x).sum(dtype=np.uint64), K.mix(x * odd).sum(dtype=np.uint64)) if len(x) else (0, 0))
                    counts.append(BINS // BAND_ROWS if len(x) else 0)
                    if len(x):
                        bands.append(band_keys(sketcher.sketch(x), BAND_ROWS))
                prints = np.array(prints, np.uint64).reshape(-1, 2)
                yield pa.record_batch(
                    [rows.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(K.signed(prints[:, 0]), pa.int64()), pa.array(K.signed(prints[:, 1]), pa.int64()), list_of(K.signed(np.concatenate(bands)) if bands else [], counts, pa.int64())],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands"],
                )

    return sketch


def _set_maker(k: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offs in K.slices(batch, "text"):
                sets = list(_row_sets(rows, buf, offs, k))
                yield pa.record_batch([rows.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "size", "elements"])

    return make


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keeps the pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
        for batch in batches:
            kept = []
            for i, (p, q) in enumerate(zip(batch.column("left"), batch.column("right"), strict=True)):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < percent * len(large) or not len(small):
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    kept.append(i)
            if kept:
                yield batch.select(["a", "b"]).take(pa.array(kept))

    return confirm


def _block_comparer(percent: int):
    def compare(group: pa.Table) -> pa.Table:
        """Links across components between two blocks (``first``, ``second``) of one centre's candidates, by exact counts on full sets.

        A pair across components has a member outside the commonest one, so only those
        rows are held against all.
        """
        group = group.combine_chunks()
        ids, labels = (group.column(c).to_numpy() for c in ("rep", "label"))
        first, second = (group.column(c).to_numpy(zero_copy_only=False) for c in ("first", "second"))
        kinds, at, counts = np.unique(labels, return_inverse=True, return_counts=True)
        rare = at != counts.argmax()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("elements").chunk(0)]
        sizes = np.array([len(x) for x in sets])
        terms, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        row_of = np.repeat(np.arange(len(sets)), sizes)
        twice = np.bincount(inverse, minlength=len(terms)) > 1
        keep = twice[inverse]
        row_of, col_of = row_of[keep], (np.cumsum(twice) - 1)[inverse[keep]]
        width = max(256, 8_000_000 // len(sets))  # bounds the dense pieces
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for left, right in ((np.flatnonzero(first & rare), np.flatnonzero(second)), (np.flatnonzero(first & ~rare), np.flatnonzero(second & rare))):
            if not len(left) or not len(right):
                continue
            both = np.zeros((len(left), len(right)), np.float32)  # counts stay exact: sets are under 2**24
            at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
            at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
            for c in range(0, int(twice.sum()), width):
                piece = (col_of >= c) & (col_of < c + width)
                r, q = row_of[piece], col_of[piece] - c
                x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
                m = at_left[r] >= 0
                x[at_left[r[m]], q[m]] = 1
                m = at_right[r] >= 0
                y[at_right[r[m]], q[m]] = 1
                both += x @ y.T
            union = sizes[left][:, None] + sizes[right][None, :] - both
            p, q = np.nonzero((100 * both >= percent * union) & (labels[left][:, None] != labels[right][None, :]))
            found.append((ids[left[p]], ids[right[q]]))
        a, b = (np.concatenate([x[n] for x in found]) if found else np.zeros(0, np.int64) for n in (0, 1))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return compare


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): (doc_id, n_shingles, component_id, kept).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set has its
    distinct k-word shingles, or the whole sequence as one where it has fewer words.
    Two documents are linked where 100 * intersection >= percent * union of their full
    sets. ``component_id`` is the smallest doc_id reachable by links, ``kept`` says that
    it is the document's own.

    Null and empty texts, and texts without words, have an empty set: they link with
    nothing and are kept. Rows that repeat a doc_id count as one document. A row with a
    null doc_id has a null component_id, links with nothing and is kept. An empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = work.write(docs.mapInArrow(_sketcher(k), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"), "sketched")

    whole = sketched.where("doc_id is not null and n_shingles > 0")
    classes = work.write(whole.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "classes")
    member = work.write(whole.select("doc_id", "f1", "f2", "n_shingles").join(classes, ["f1", "f2", "n_shingles"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")), "member")
    # bands of class representatives; a repeated doc_id keeps each of its texts
    reps = whole.join(member.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").withColumnRenamed("doc_id", "rep")
    banded = reps.select("rep", F.explode("bands").alias("key"))  # a band's number is in its key
    full = banded.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre < last").drop("last")
    star = work.write(banded.join(full, "key").where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "star")
    wanted = work.write(star.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    sets = work.write(likely(docs, wanted, "doc_id").join(wanted, "doc_id", "left_semi").mapInArrow(_set_maker(k), "doc_id long, size long, elements binary"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left, right = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("left")), sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("right"))
        return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(_confirmer(percent), "a long, b long").distinct()

    links = work.write(confirmed(star), "links")
    first = work.write(connected_components(links, work, "first"), "first")

    # candidates of one centre that ended in several components
    labelled = work.write(star.select(F.col("a").alias("centre"), F.col("b").alias("rep")).join(first.withColumnRenamed("node", "rep"), "rep", "left").select("centre", "rep", F.coalesce("component", "rep").alias("label")), "labelled")
    split = labelled.groupBy("centre").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("centre")
    # a set's level: those that may be linked are at most one level apart (the width is a little more than it need be)
    level = F.floor(F.log("size") / (-math.log(percent / 100) * (1 + 1e-9)))
    sized = labelled.join(split, "centre").join(sets.select(F.col("doc_id").alias("rep"), "size"), "rep").withColumn("level", level.cast("int"))
    counts = sized.groupBy("centre", "level").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # levels grow with the logarithm of a text's length: a short map per centre
    levels = counts.groupBy("centre").agg(F.map_from_entries(F.collect_list(F.struct("level", "blocks"))).alias("of"))

    def pairs(low: F.Column, high: F.Column, low_block, high_block, others: F.Column) -> F.Column:
        each = F.transform(F.sequence(F.lit(0), others - 1), lambda o: F.struct(low.alias("low"), low_block(o).alias("i"), high.alias("high"), high_block(o).alias("j")))
        return F.when(others.isNotNull(), each).otherwise(F.array().cast("array<struct<low:int,i:int,high:int,j:int>>"))

    own, at = F.col("own"), F.col("level")
    met = F.concat(
        pairs(at, at, lambda o: F.least(own, o), lambda o: F.greatest(own, o), F.col("of")[at]),
        pairs(at, at + 1, lambda o: own, lambda o: o, F.try_element_at("of", at + 1)),
        pairs(at - 1, at, lambda o: o, lambda o: own, F.try_element_at("of", at - 1)),
    )
    dealt = (
        sized.join(levels, "centre")
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("of")[at]).cast("int"))
        .select("centre", "rep", "label", "size", "level", "own", F.explode(met).alias("met"))
        .select("centre", "rep", "label", "size", "met.*", ((at == F.col("met.low")) & (own == F.col("met.i"))).alias("first"), ((at == F.col("met.high")) & (own == F.col("met.j"))).alias("second"))
        .join(sets.withColumnRenamed("doc_id", "rep"), ["rep", "size"])
    )
    more = work.write(dealt.groupBy("centre", "low", "i", "high", "j").applyInArrow(_block_comparer(percent), "a long, b long").where("a <> b").distinct(), "more")
    merged = links.unionByName(more)
    last = work.write(connected_components(merged, work, "last"), "last")

    for name in ("classes", "star", "wanted", "sets", "links", "first", "labelled", "more"):
        work.delete(name)  # what is returned reads the others

    whole_of = member.distinct().join(last.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = sketched.select("doc_id", "n_shingles").join(whole_of, "doc_id", "left")
    own = F.when(F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
