"""Benchmark decontamination: BM25 over test items, block-max WAND, overlap verification.

The inverted index holds the test items.  Every passage of every training text is a
query: runs of words of twice a length, each half over the next, so an item of at most
that length that occurs as a whole lies whole in one of them.  Items are grouped by
length (each group up to twice its shortest), and a group is searched by passages of its
own length, so a few long items don't blunt the search for short ones.  Scores are BM25
of the item for the passage's distinct words, with statistics over all items, divided by
the item's score for its own words, so one threshold fits all items.  Block-max WAND
(Ding and Suel, 2011) retrieves every item at or above it, with blocks that are ranges of
items, the same for all terms: a passage whose words' greatest impacts, over all items or
in a block, sum to less cannot have an item there, which is tested for whole batches of
passages at once; in the blocks that are left, pivots by the block's maxima decide which
items are scored.  What is retrieved counts only if the item's question (its text up to
the last sentence, or all of it if that has under four words) and answer (the last
sentence) overlap the passage.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treegate.llm import kernels as K
from treegate.llm.common import Workspace, carried, list_of, unpacked

K1, B = 1.2, 0.75
#: Least share of an item's own score; least overlaps of question 4-grams and of answer words.
THRESHOLD, QUESTION, ANSWER = 0.6, 0.3, 0.5
GRAM, BLOCKS, BLOCK_ITEMS = 4, 64, 4
#: Items of one index, and their bytes, on average; more make more indexes, each over all texts.
ITEMS_PER_INDEX, BYTES_PER_INDEX = 25_000, 25_000_000

#: Words are runs of ASCII letters, digits and non-ASCII bytes; the rest separates them. Case counts for letters past U+00FF alone.
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False
_CODES = K.LOWER.copy()
_CODES[_BREAK] = 0x20


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and per row the index of its first (length rows + 1)."""
    codes = _CODES[buf]
    if len(codes):  # À to Þ, but ×, are lower-cased too: in UTF-8 their second byte grows by 32
        capital = np.flatnonzero((codes[:-1] == 0xC3) & (codes[1:] >= 0x80) & (codes[1:] <= 0x9E) & (codes[1:] != 0x97)) + 1
        codes[capital] += 0x20
    starts, ends, first = K.word_bounds(codes, offs)
    return K.word_hashes(codes, starts, ends), first


def _words_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _words(data, np.array([0, len(data)]))[0]


def question_and_answer(text: str) -> tuple[str, str]:
    """The text up to its last sentence, and that; a single sentence is all question."""
    cuts = [m.end() for m in re.finditer(r"[.?!]+\s+|\n+", text.rstrip())]
    return (text[: cuts[-1]], text[cuts[-1] :]) if cuts and text[: cuts[-1]].strip() else (text, "")


@dataclass
class Statistics:
    """In how many items each word (by its hash) is; how many items, and words in them."""

    frequency: dict[int, int]
    items: int
    words: int


class Index:
    """Items as sorted postings in blocks, with each term's and each block's greatest impact."""

    def __init__(self, items: list[tuple[int | None, str]], statistics: Statistics | None = None):
        """``statistics``: of all items, where these are some of them."""
        rows = [(i, t, _words_of(t)) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1]))]
        rows = [r for r in rows if len(r[2])]
        self.ids = [r[0] for r in rows]
        #: words that passages advance by: no item is longer
        self.stride = 1 << max((len(r[2]) - 1).bit_length() for r in rows) if rows else 1
        counts = [Counter(r[2].tolist()) for r in rows]
        if statistics is None:
            statistics = Statistics(Counter(t for c in counts for t in c), len(rows), sum(len(r[2]) for r in rows))
        frequency, total, mean = statistics.frequency, statistics.items, statistics.words / max(1, statistics.items)
        postings: dict[int, list[tuple[int, float]]] = {}
        for d, ((_, _, words), c) in enumerate(zip(rows, counts, strict=True)):
            norm = K1 * (1 - B + B * len(words) / mean)
            own = {t: math.log(1 + (total - frequency[t] + 0.5) / (frequency[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in c.items()}
            whole = sum(own.values())
            for t, x in own.items():
                postings.setdefault(t, []).append((d, x / whole))
        self.terms = np.array(sorted(postings), np.uint64)
        size = max(BLOCK_ITEMS, -(-len(rows) // BLOCKS))
        #: per block, term number to its items there and their impacts
        self.blocks: list[dict[int, tuple[list[int], list[float]]]] = [{} for _ in range(-(-len(rows) // size))]
        self.maxima = np.zeros((len(self.terms), len(self.blocks)), np.float32)
        for n, t in enumerate(self.terms.tolist()):
            for d, x in postings[t]:
                docs, impacts = self.blocks[d // size].setdefault(n, ([], []))
                docs.append(d)
                impacts.append(x)
                self.maxima[n, d // size] = max(self.maxima[n, d // size], x)
        self.greatest = self.maxima.max(axis=1).astype(float) if len(self.terms) else np.zeros(0)
        parts = [tuple(map(_words_of, question_and_answer(r[1]))) for r in rows]
        # a part of few words proves nothing: the whole text is the question then
        parts = [(q, a) if len(q) >= GRAM and len(a) else (r[2], a[:0]) for (q, a), r in zip(parts, rows, strict=True)]
        self.questions = [self._grams(q) for q, _ in parts]
        self.answers = [np.unique(a) for _, a in parts]
        # terms by the leading bits of their hash
        self.bits = max(8, min(20, 4 + len(self.terms).bit_length()))
        self.slots = np.searchsorted(self.terms, np.arange((1 << self.bits) + 1, dtype=np.uint64) << np.uint64(64 - self.bits), side="left") if len(self.terms) else None
        if self.slots is not None:
            self.slots[-1] = len(self.terms)

    @staticmethod
    def _grams(words: np.ndarray) -> tuple[int, np.ndarray]:
        k = min(GRAM, max(1, len(words)))
        return k, np.unique(K.shingle_hashes(words, k))

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Term numbers of words, -1 for words in no item."""
        out = np.full(len(words), -1, np.int32)
        if self.slots is None:
            return out
        slot = (words >> np.uint64(64 - self.bits)).astype(np.int64)
        maybe = np.flatnonzero(self.slots[slot] < self.slots[slot + 1])
        at = np.minimum(np.searchsorted(self.terms, words[maybe]), len(self.terms) - 1)
        out[maybe] = np.where(self.terms[at] == words[maybe], at, -1)
        return out

    def search(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """Every item of a block whose score for the distinct ``terms`` is at least ``threshold``, by WAND with the block's maxima."""
        threshold -= 1e-6
        here, bounds = self.blocks[block], self.maxima[:, block]
        lists = [[here[t][0][0], 0, t] for t in terms if t in here]  # current item, place, term
        out = []

        def advance(x: list, item: int) -> None:
            docs = here[x[2]][0]
            x[1] = bisect_left(docs, item, x[1])
            x[0] = docs[x[1]] if x[1] < len(docs) else None

        while lists:
            lists.sort(key=lambda x: x[0])
            bound, pivot = 0.0, None
            for x in lists:
                bound += float(bounds[x[2]])
                if bound >= threshold:
                    pivot = x[0]
                    break
            if pivot is None:
                break
            score = 0.0
            for x in lists:
                if x[0] > pivot:
                    break
                advance(x, pivot)
                if x[0] == pivot:
                    score += here[x[2]][1][x[1]]
                    advance(x, pivot + 1)
            if score >= threshold:
                out.append((pivot, score))
            lists = [x for x in lists if x[0] is not None]
        return out

    def verify(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """Shares of the item's question 4-grams and of its answer's words that the passage has (no answer: 1)."""
        (k, question), answer = self.questions[item], self.answers[item]
        q = float(np.isin(question, K.shingle_hashes(passage, k)).mean()) if len(question) else 0.0
        a = float(np.isin(answer, passage).mean()) if len(answer) else 1.0
        return q, a

    def matches(self, words: np.ndarray, first: np.ndarray, threshold: float, question: float, answer: float) -> list[list[tuple[int, float, float, float]]]:
        """Per row the confirmed items: (item number, best score, and its overlaps)."""
        out: list[list] = [[] for _ in range(len(first) - 1)]
        if not len(words) or self.slots is None:
            return out
        term = self.lookup(words)
        impact = np.where(term >= 0, self.greatest[term], 0.0)
        total = np.concatenate([[0.0], np.cumsum(impact)])
        stride = self.stride
        sizes = np.diff(first)
        each = np.maximum(1, -(-sizes // stride) - 1) * (sizes > 0)
        row = np.repeat(np.arange(len(sizes)), each)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        start = first[row] + nth * stride
        end = np.minimum(start + 2 * stride, first[row + 1])
        likely = np.flatnonzero(total[end] - total[start] >= threshold - 1e-6)
        for i in range(0, len(likely), 2_000):  # bounds the tables of block sums
            own = likely[i : i + 2_000]
            sizes = end[own] - start[own]
            nth = np.repeat(np.arange(len(own)), sizes)
            place = np.arange(len(nth)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[own][nth]
            known = term[place] >= 0
            nth, terms = np.divmod(np.unique(nth[known] * len(self.terms) + term[place[known]]), len(self.terms))
            cut = np.searchsorted(nth, np.arange(len(own) + 1))
            sums = np.add.reduceat(self.maxima[terms], cut[:-1], axis=0)  # every one has a term
            for p, block in zip(*np.nonzero(sums >= threshold - 1e-4), strict=True):
                passage = words[start[own[p]] : end[own[p]]]
                for item, score in self.search(terms[cut[p] : cut[p + 1]].tolist(), int(block), threshold):
                    q, a = self.verify(item, passage)
                    if q >= question and a >= answer:
                        out[row[own[p]]].append((item, score, q, a))
        for r, found in enumerate(out):
            best: dict[int, tuple] = {}
            for x in found:
                if x[0] not in best or x[1] > best[x[0]][1]:
                    best[x[0]] = x
            out[r] = [best[i] for i in sorted(best)]
        return out


_HIT = "struct<item_id: bigint, score: double, question_overlap: double, answer_overlap: double>"
_HIT_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per item row its key, its number of words and its distinct words' hashes."""
    for batch in batches:
        for rows, buf, offs in K.slices(batch, "text"):
            words, first = _words(buf, offs)
            terms = [np.unique(words[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            flat = K.signed(np.concatenate(terms))
            yield pa.record_batch([rows.column("key"), pa.array(np.diff(first), pa.int64()), list_of(flat, [len(x) for x in terms], pa.int64())], names=["key", "n_words", "terms"])


def _indexes(benchmark: DataFrame) -> Iterator[list[Index]]:
    """The items with a word, a row each, dealt over as many parts as keep each small; per part an index for each group of lengths."""
    work = Workspace(benchmark.sparkSession, "items")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    keyed = work.write(items.withColumn("key", F.monotonically_increasing_id()), "keyed")  # written: a key stays a row's
    terms = work.write(keyed.select("key", "text").mapInArrow(_item_terms, "key long, n_words long, terms array<long>"), "terms").where("n_words > 0")
    frequency = work.write(terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")), "frequency")
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    total, words = terms.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    parts = max(-(-total // ITEMS_PER_INDEX), -(-size // BYTES_PER_INDEX))
    part = F.pmod(F.xxhash64("key"), F.lit(max(1, parts)))
    for p in range(parts):
        own = terms.where(part == p)
        known = frequency.join(own.select(F.explode("terms").alias("term")).distinct(), "term").collect()
        statistics = Statistics({r.term % 2**64: r.n for r in known}, total, words)
        groups: dict[int, list[tuple[int | None, str]]] = {}
        for r in keyed.join(own.select("key", "n_words"), "key").collect():
            groups.setdefault((r.n_words - 1).bit_length(), []).append((r.item_id, r.text))
        yield [Index(groups[g], statistics) for g in sorted(groups)]
    work.delete("")


def find_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, into: str = "items") -> DataFrame:
    """``docs`` with ``into``: the benchmark items that each whole text holds, with scores and overlaps.

    ``benchmark``: (item_id, text). Null and empty texts, and texts or items without a
    word, match nothing; items that repeat an id, or have a null one (null in the hit),
    are items of their own. Rows pass through one by one, so repeated rows, null
    doc_ids and other columns, whatever their names, change nothing; a column named
    ``into`` gives way. An empty table gives an empty result, an empty benchmark no items.
    """
    names, packed = carried(docs, into)
    rows = packed.withColumn("found", F.array().cast(f"array<{_HIT}>"))
    schema = rows.schema
    for indexes in _indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)  # about ITEMS_PER_INDEX items and BYTES_PER_INDEX bytes

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            K.release_caches()
            for batch in batches:
                for part, buf, offs in K.slices(batch, "text"):
                    words, first = _words(buf, offs)
                    hits = part.column("found").to_pylist() if len(part.column("found").flatten()) else [[] for _ in range(part.num_rows)]
                    for index in shared.value:
                        for h, found in zip(hits, index.matches(words, first, threshold, question, answer), strict=True):
                            h.extend({"item_id": index.ids[i], "score": s, "question_overlap": q, "answer_overlap": a} for i, s, q, a in found)
                    for h in hits:
                        h.sort(key=lambda x: (x["item_id"] is None, x["item_id"] or 0, -x["score"]))
                    yield pa.record_batch([part.column("row"), part.column("text"), pa.array(hits, _HIT_ARROW)], names=["row", "text", "found"])

        rows = rows.mapInArrow(match, schema)
    return rows.select(*unpacked(names), F.col("found").alias(into))
