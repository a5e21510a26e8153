import random
import re

import numpy as np
import pytest

from treegate.llm import kernels as K
from treegate.llm import neardup
from treegate.llm.common import Workspace
from treegate.llm.graph import connected_components
from treegate.llm.minhash import FastSimilaritySketch, band_keys

from .helpers import awkward, by, documents, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    """Smallest reachable id of each id, by all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in range(len(sets)):
        for q in range(p):
            (a, x), (b, y) = sets[p], sets[q]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def check(rows, got, k):
    want = brute(rows, k)
    sizes = {}
    for i, t in rows:
        sizes.setdefault(i, set()).add(len(shingles(t, k)))
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles in sizes[r.doc_id]
        assert r.component_id == want.get(r.doc_id)
        assert r.kept is (r.doc_id is None or want[r.doc_id] == r.doc_id)


def edited(rng, base, rate):
    return " ".join(w if rng.random() > rate else w + rng.choice("qxz") for w in base.split(" "))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_by_all_pairs(spark, k):
    rng = random.Random(k)
    rows, i = [], 0
    for size in (1, 3, 9, 40, 200):
        base = prose(rng, size)
        for copies, rate in ((3, 0.0), (12, 0.01), (12, 0.04), (6, 0.1)):
            for _ in range(copies):
                rows.append((i, edited(rng, base, rate)))
                i += 1
    rng.shuffle(rows)
    check(rows, neardup.near_duplicates(documents(spark, rows), k=k).collect(), k)


def test_links_across_a_centre_are_found(spark, monkeypatch):
    """Chains whose members are near their neighbours but not near the smallest id, in blocks of two."""
    monkeypatch.setattr(neardup, "BLOCK", 2)
    rng = random.Random(3)
    words = prose(rng, 100).split()
    rows = [(0, " ".join(words))]
    for i in range(1, 14):
        words = words.copy()
        words[rng.randrange(100)] += "x" * i
        words[rng.randrange(100)] += "y" * i
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    check(rows, neardup.near_duplicates(documents(spark, rows), k=2).collect(), 2)


def test_links_between_sets_of_other_sizes_are_found(spark, monkeypatch):
    """Texts that grow, each just near enough to the next: links cross from one level of sizes to the next."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = random.Random(14)
    rows, words = [], prose(rng, 41).split()
    while len(words) < 700:
        rows.append(" ".join(words))
        words = words + [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, len(words) // 4))]
    rows += [" ".join(w + ("z" if rng.random() < 0.04 else "") for w in t.split()) for t in rows]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    check(rows, neardup.near_duplicates(documents(spark, rows), k=2).collect(), 2)


def test_block_comparer_counts_on_full_sets():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(0, 2**63, 4, dtype=np.uint64)])) for _ in range(40)]
    labels = [i % 3 for i in range(40)]
    group = pa.table({"centre": [0] * 40, "rep": list(range(40)), "label": labels, "first": [i % 2 == 0 for i in range(40)], "second": [i % 2 == 1 for i in range(40)], "elements": pa.array([s.tobytes() for s in sets], pa.binary())})
    got = set(zip(*(neardup._block_comparer(80)(group).column(c).to_pylist() for c in "ab"), strict=True))
    want = set()
    for p in range(40):
        for q in range(p):
            both = len(np.intersect1d(sets[p], sets[q]))
            if labels[p] != labels[q] and p % 2 != q % 2 and 100 * both >= 80 * (len(sets[p]) + len(sets[q]) - both):
                want.add((q, p))
    assert got == want and want


def test_awkward_documents(spark):
    rows = awkward()
    for k in (2, 5):
        check(rows, neardup.near_duplicates(documents(spark, rows, extra=True), k=k).collect(), k)


def test_empty_table(spark):
    assert neardup.near_duplicates(documents(spark, [(1, "x")]).where("false")).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    sketcher = FastSimilaritySketch(128)
    shares = []
    for n in (1, 5, 60, 3000):
        for _ in range(20):
            x = rng.integers(0, 2**63, n, dtype=np.uint64)
            y = np.concatenate([x[: max(1, int(0.9 * n))], rng.integers(0, 2**63, n - max(1, int(0.9 * n)), dtype=np.uint64)])
            both = len(np.intersect1d(x, y))
            shares.append((sketcher.sketch(x) == sketcher.sketch(y)).mean() - both / (2 * n - both))
        s = sketcher.sketch(x)
        assert (s < np.uint64(2**64 - 1)).all() and len(np.unique(band_keys(s, 4))) == 32
    assert abs(np.mean(shares)) < 0.03 and np.max(np.abs(shares)) < 0.25


def test_shingle_hashes_depend_on_words_alone():
    def sets(texts):
        data = [t.encode() for t in texts]
        buf, offs = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
        starts, ends, first = K.word_bounds(buf, offs)
        h = K.word_hashes(buf, starts, ends)
        return [K.row_shingles(h[first[i] : first[i + 1]], 2).tolist() for i in range(len(texts))]

    a, b, c, d, e = sets(["A b  c", "\tb c", "a B c\n", "", "cb"])
    assert a == c and set(b) < set(a) and d == [] and e not in (a, b)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(6, 60)] + [(3, 3), (None, 1), (200, 7), (7, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, Workspace(spark, "t")).collect()}
    want = {i: 100 for i in range(100, 141)} | {i: 5 for i in [*range(5, 60), 200]}
    assert got == want
    assert connected_components(df.where("false"), Workspace(spark, "t")).count() == 0


def test_the_result_is_the_same_over_any_partitioning(spark):
    rows = awkward()
    one = by(neardup.near_duplicates(documents(spark, rows).repartition(1), k=2).where("doc_id is not null"))
    many = by(neardup.near_duplicates(documents(spark, rows).repartition(7), k=2).where("doc_id is not null"))
    assert one == many


def thue_morse(n, a="a", b="b"):
    return a if n == 0 else thue_morse(n - 1, a, b) + thue_morse(n - 1, b, a)


def test_words_of_great_regularity_differ(spark):
    """On such words every polynomial hash modulo 2**64 collides."""
    for n in (4, 9, 10, 12):
        one, two = thue_morse(n), thue_morse(n, "b", "a")
        got = by(neardup.near_duplicates(documents(spark, [one, two, f"{one} {two}", f"{two} {one}"]), k=2))
        assert [got[i].component_id for i in range(4)] == [0, 1, 2, 3]


def test_span_hashes_depend_on_bytes_alone():
    rng = np.random.default_rng(3)
    seen = {}
    for n in [*range(40), 255, 256, 257, 511, 512, 513, 2_000]:
        word = rng.integers(0, 256, n, dtype=np.uint8)
        buf = np.concatenate([np.full(3, 9, np.uint8), word, np.full(1, 7, np.uint8), word])
        a, b = K.span_hashes(buf, np.array([3, 4 + n]), np.array([3 + n, 4 + 2 * n])).tolist()
        assert a == b and seen.setdefault(a, n) == n
        for at in range(min(n, 20)):  # every byte counts
            other = word.copy()
            other[at] ^= 1
            assert K.span_hashes(other, np.array([0]), np.array([n]))[0] != a
