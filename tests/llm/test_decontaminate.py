import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from treegate.llm import decontaminate as D

from .helpers import awkward, documents, prose


def brute(index, terms, threshold):
    """Scores of all items from all postings."""
    score = {}
    for block in index.blocks:
        for t in terms:
            for d, x in zip(*block.get(t, ([], [])), strict=True):
                score[d] = score.get(d, 0) + x
    return {d: s for d, s in score.items() if s >= threshold}


@pytest.mark.parametrize("items", [1, 7, 300])
def test_block_max_wand_finds_all_items(items):
    rng = random.Random(items)
    index = D.Index([(i, prose(rng, rng.randrange(1, 30))) for i in range(items)])
    for _ in range(300):
        terms = sorted(rng.sample(range(len(index.terms)), min(len(index.terms), rng.randrange(1, 25))))
        threshold = rng.choice([0.05, 0.2, 0.6])
        sums = index.maxima[terms].sum(axis=0)
        got = {d: s for b in np.flatnonzero(sums >= threshold - 1e-4) for d, s in index.search(terms, int(b), threshold)}
        want = brute(index, terms, threshold - 1e-6)  # equal scores may differ in their last bits
        assert got.keys() == want.keys()
        assert all(abs(got[d] - want[d]) < 1e-9 for d in got)


def test_an_item_scores_one_for_itself():
    rng = random.Random(2)
    items = [(i, prose(rng, 20)) for i in range(50)]
    index = D.Index(items)
    for n, (_, text) in enumerate(items):
        terms = np.unique(index.lookup(D._words_of(text))).tolist()
        assert -1 not in terms
        assert dict(x for b in range(len(index.blocks)) for x in index.search(terms, b, 0.99))[n] == pytest.approx(1)


def test_question_and_answer():
    assert D.question_and_answer("Who was it? It was me.") == ("Who was it? ", "It was me.")
    assert D.question_and_answer("one sentence.") == ("one sentence.", "")
    assert D.question_and_answer("") == ("", "")


@pytest.fixture(scope="module")
def benchmark(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randrange(8, 60))) for i in range(40)] + [(100, None), (101, ""), (102, "?!"), (None, "no id at all"), (0, prose(rng, 12))]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def test_planted_items(spark, benchmark):
    items, table = benchmark
    rng = random.Random(12)
    rows, want = [], set()
    for i in range(150):
        words = prose(rng, rng.choice([5, 40, 400, 3000])).split(" ")
        if i % 3 == 0:
            k, text = items[rng.randrange(40)]
            words.insert(rng.randrange(len(words) + 1), text.upper() if i % 2 else text)
            want.add((i, k))
        rows.append((i, " ".join(words)))
    found = {(r.doc_id, x.item_id) for r in D.find_items(documents(spark, rows), table).collect() for x in r["items"]}
    assert want <= found
    assert len(found - want) <= 2


def test_awkward_documents(spark, benchmark):
    items, table = benchmark
    rows = [*awkward(), (20, items[3][1]), (20, items[3][1]), (None, items[4][1])]
    df = documents(spark, rows, extra=True)
    got = D.find_items(df, table)
    assert got.columns == [*(c for c in df.columns if c != "items"), "items"]  # the given one gives way
    assert D.find_items(df, table, into="hits").columns == [*df.columns, "hits"]
    found = got.collect()
    assert len(found) == len(rows) and sum(bool(r["items"]) for r in found) == 3
    assert all(r.rep == "rep" and r["a b"] == "a b" and r["c`d"] == "c`d" for r in found)
    assert D.find_items(df.where("false"), table).count() == 0
    assert all(not r["items"] for r in D.find_items(df, table.where("false")).collect())


def test_many_indexes_give_what_one_gives(spark, benchmark, monkeypatch):
    items, table = benchmark
    df = documents(spark, [(i, t or "") for i, (_, t) in enumerate(items)])
    one = {r.doc_id: sorted((x.item_id, round(x.score, 9)) for x in r["items"]) for r in D.find_items(df, table).collect()}
    monkeypatch.setattr(D, "ITEMS_PER_INDEX", 9)
    many = {r.doc_id: sorted((x.item_id, round(x.score, 9)) for x in r["items"]) for r in D.find_items(df, table).collect()}
    assert {k: [i for i, _ in v] for k, v in many.items()} == {k: [i for i, _ in v] for k, v in one.items()}


def test_many_indexes_with_capitals_past_latin_1_and_repeated_ids(spark, monkeypatch):
    rng = random.Random(17)
    words = ["Œuvre", "Šárka", "Łódź", "Αθήνα", "Москва", "Ñandú", "İzmir"]
    items = [(i, f"{prose(rng, 12)} {' '.join(rng.sample(words, 3))} {prose(rng, 8)}") for i in range(30)]
    items += [(3, items[3][1]), (4, prose(rng, 15)), (4, prose(rng, 15)), (50, "?!"), (51, None)]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [(i, f"{prose(rng, 20)} {t or ''} {prose(rng, 20)}") for i, (_, t) in enumerate(items)])

    def found():
        return {r.doc_id: sorted((x.item_id, x.score) for x in r["items"]) for r in D.find_items(docs, table).collect()}

    one = found()
    assert all(any(i == items[d][0] for i, _ in one[d]) for d in range(33))
    monkeypatch.setattr(D, "ITEMS_PER_INDEX", 9)
    many = found()
    assert {k: [i for i, _ in v] for k, v in many.items()} == {k: [i for i, _ in v] for k, v in one.items()}
    assert all([s for _, s in many[k]] == pytest.approx([s for _, s in v]) for k, v in one.items())


@pytest.mark.parametrize("size", [50_000, 9])
def test_items_with_a_null_id_are_found(spark, monkeypatch, size):
    monkeypatch.setattr(D, "ITEMS_PER_INDEX", size)
    rng = random.Random(19)
    items = [(None if i % 2 else i, prose(rng, 20)) for i in range(24)]
    docs = documents(spark, [(i, f"{prose(rng, 30)} {t} {prose(rng, 30)}") for i, (_, t) in enumerate(items)])
    got = {r.doc_id: [x.item_id for x in r["items"]] for r in D.find_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: [k] for i, (k, _) in enumerate(items)}


def _tokens(text):
    """Words by the definition: A-Z and the capitals of Latin-1 in lower case."""
    low = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or "")
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", low.encode())


def from_texts(docs, items, threshold=D.THRESHOLD, question=D.QUESTION, answer=D.ANSWER):
    """Per document the items (by place in the list) and their scores: BM25 of every passage for every item, summed up from the texts."""
    words = {i: _tokens(t) for i, (_, t) in enumerate(items) if _tokens(t)}
    frequency = Counter(w for ws in words.values() for w in set(ws))
    mean = sum(map(len, words.values())) / len(words)
    out = []
    for _, text in docs:
        own, best = _tokens(text), {}
        for i, ws in words.items():
            stride = 1
            while stride < len(ws):
                stride *= 2
            tf, norm = Counter(ws), D.K1 * (1 - D.B + D.B * len(ws) / mean)
            impact = {w: math.log(1 + (len(words) - frequency[w] + 0.5) / (frequency[w] + 0.5)) * n * (D.K1 + 1) / (n + norm) for w, n in tf.items()}
            q, a = (_tokens(x) for x in D.question_and_answer(items[i][1]))
            if len(q) < D.GRAM or not a:
                q, a = ws, []
            k = min(D.GRAM, len(q))
            grams = lambda x: {tuple(x[j : j + k]) for j in range(len(x) - k + 1)}  # noqa: B023, E731
            for at in range(0, max(1, -(-len(own) // stride) - 1) * stride, stride):
                passage = own[at : at + 2 * stride]
                score = sum(impact.get(w, 0) for w in set(passage)) / sum(impact.values())
                asked = len(grams(q) & grams(passage)) / len(grams(q))
                answered = len(set(a) & set(passage)) / len(set(a)) if a else 1
                if score >= threshold - 1e-6 and asked >= question and answered >= answer:
                    best[i] = max(best.get(i, 0), score)
        out.append(sorted((items[i][0] is None, items[i][0] or 0, round(s, 6)) for i, s in best.items()))
    return out


@pytest.mark.parametrize("size", [25_000, 9])
def test_against_bm25_summed_up_from_texts(spark, monkeypatch, size):
    """One item of many thousand words, empty and equal ones, null and repeated ids, capitals of several alphabets."""
    monkeypatch.setattr(D, "ITEMS_PER_INDEX", size)
    rng = random.Random(23)
    names = ["ЖУК", "Москва", "ΑΘΗΝΑ", "Œuvre", "Łódź", "ÑANDÚ", "été"]
    items = [(i, f"{prose(rng, rng.randrange(1, 40))}? {rng.choice(names)} {prose(rng, rng.randrange(1, 9))}") for i in range(40)]
    items += [(7, items[7][1]), (7, prose(rng, 9)), (None, prose(rng, 20)), (60, "?!"), (61, ""), (62, None), (63, prose(rng, 3_000)), (64, "ЖУК")]
    docs = []
    for i in range(120):
        words = prose(rng, rng.choice([0, 3, 30, 300])).split(" ")
        if i % 3:
            text = rng.choice(items)[1] or ""
            if i % 2:  # a near copy
                text = " ".join(w for w in text.split(" ") if rng.random() > 0.12)
            words.insert(rng.randrange(len(words) + 1), text)
        docs.append((i, " ".join(words)))
    docs += [(200, None), (None, items[3][1]), (5, docs[5][1]), (201, f"{prose(rng, 500)} {items[-2][1]} {prose(rng, 500)}")]
    numbered = spark.createDataFrame([(n, *d) for n, d in enumerate(docs)], "n long, doc_id long, text string")
    got = D.find_items(numbered, spark.createDataFrame(items, "item_id long, text string")).orderBy("n").collect()
    assert [sorted((x.item_id is None, x.item_id or 0, round(x.score, 6)) for x in r["items"]) for r in got] == from_texts(docs, items)
