"""The queries on the driver's tables: recall and exactness against brute force, held-out accuracy."""

import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from treegate.llm import decontaminate as D
from treegate.llm import suffix
from treegate.llm.queries import QUERIES

from .test_decontaminate import from_texts
from .test_neardup import shingles
from .test_suffix import brute as repeats

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def rows(sf, table, *columns):
    t = pq.read_table(f"{sf}/{table}.parquet", columns=list(columns))
    return list(zip(*(t.column(c).to_pylist() for c in columns), strict=True))


def test_all_links_of_the_documents_are_found(spark):
    """Recall and precision of components against all pairs whose sizes allow a link."""
    sets = sorted(((len(x), i, x) for i, t in rows(SF, "documents", "doc_id", "text") if (x := shingles(t, 2))), key=lambda s: s[:2])
    root = {i: i for _, i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = []
    for p, (n, i, x) in enumerate(sets):
        for m, j, y in sets[p + 1 :]:
            if 100 * n < 80 * m:
                break
            both = len(x & y)
            if 100 * both >= 80 * (n + m - both):
                links.append((i, j))
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in QUERIES["op1_minhash_near_dedup"](spark, SF).collect()}
    assert len(links) > 50 and all(got[i] == got[j] for i, j in links)  # recall 1
    assert all(got[i] == find(i) for i in root)


def test_all_repeats_of_the_documents_are_found(spark):
    docs = rows(SMALL, "documents", "doc_id", "text")
    want = {i: w[:4] for (i, _), w in zip(docs, repeats([t for _, t in docs], suffix.LENGTH), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op4_suffix_array_dedup"](spark, SMALL).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 0


def test_items_are_found_verbatim_and_changed(spark):
    """All that BM25 summed up from texts finds in some documents; and recall as words go missing."""
    items = rows(SMALL, "benchmark", "item_id", "text")
    table = spark.createDataFrame(items, "item_id long, text string")
    rng = random.Random(4)
    docs = [x for x in rows(SMALL, "documents", "doc_id", "text") if len(x[1] or "") < 4_000][:25]
    planted = []
    for share in (0.0, 0.1, 0.2):
        for n in range(20):
            words = [w for w in rng.choice(items)[1].split() if rng.random() >= share]
            around = rng.choice(docs)[1] or ""
            planted.append((1_000 + len(planted), f"{around[:500]} {' '.join(words)} {around[500:900]}"))
    df = spark.createDataFrame([*docs, *planted], "doc_id long, text string")
    got = {r.doc_id: sorted((x.item_id is None, x.item_id or 0, round(x.score, 6)) for x in r["items"]) for r in D.find_items(df, table).collect()}
    want = from_texts([*docs, *planted], items)
    assert [got[i] for i, _ in [*docs, *planted]] == want
    recall = [sum(bool(got[i]) for i, _ in planted[a : a + 20]) / 20 for a in (0, 20, 40)]
    assert recall[0] == 1 and recall[1] >= 0.8, recall


def test_languages_of_held_out_documents(spark):
    lang = dict(rows(SF, "documents", "doc_id", "lang"))
    got = [r for r in QUERIES["op9_language_id"](spark, SF).collect() if r.held_out and r.lang_pred != "und" and lang[r.doc_id] is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(got) > 150 and np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.95


def test_quality_of_held_out_documents(spark):
    quality = dict(rows(SF, "labels", "doc_id", "quality"))
    got = [(r.score, quality[r.doc_id]) for r in QUERIES["op3_quality_classifier"](spark, SF).collect() if r.held_out and quality.get(r.doc_id) is not None]
    good, bad = ([s for s, q in got if q == x] for x in (1, 0))
    assert len(good) > 20 and len(bad) > 5
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.9  # area under the curve


def test_rules_leave_good_documents_alone(spark):
    quality = dict(rows(SF, "labels", "doc_id", "quality"))
    got = {r.doc_id: r for r in QUERIES["op10_quality_rules"](spark, SF).collect()}
    kept = {q: np.mean([got[i].kept for i, x in quality.items() if x == q]) for q in (0, 1)}
    assert kept[1] > 0.9 and kept[0] < 0.5, kept
