import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from treegate.llm import suffix

from .helpers import awkward, documents, prose


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, digest of what is left, spans) per text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def check(rows, got, length):
    want = Counter((str(i), *w[:4]) for (i, _), w in zip(rows, brute([t for _, t in rows], length), strict=True))
    assert Counter((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def corpus(rng, n=60):
    passages = [prose(rng, 60) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [prose(rng, rng.randrange(1, 80)) for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        if rng.random() < 0.2:
            p = rng.choice(passages)
            a = rng.randrange(len(p) - 10)
            parts.append(p[a : a + rng.randrange(150, 300)])
        rows.append((i, " ".join(parts)))
    rows += [(n + i, rng.choice(rows)[1]) for i in range(6)]
    rows += [(n + 10, "ab" * 400), (n + 11, "a" * 900), (n + 12, "xa" + "a" * 250), (n + 13, rows[0][1] + rows[0][1]), (n + 14, "é" * 150), (n + 15, "zé" + "é" * 149)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed):
    rows = corpus(random.Random(seed))
    check(rows, suffix.repeat_report(documents(spark, rows), 200).collect(), 200)


def test_shorter_strings_and_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 300)
    rows = corpus(random.Random(4), 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # only a text alone is cut
    check(rows, suffix.repeat_report(documents(spark, rows).coalesce(1), 100).collect(), 100)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_passage_that_most_documents_hold(spark):
    rng = random.Random(6)
    passage = prose(rng, 70)
    rows = [(i, f"{prose(rng, 5)} {passage} {prose(rng, 5)}") for i in range(300)]
    check(rows, suffix.repeat_report(documents(spark, rows).repartition(5), 200).collect(), 200)


def test_awkward_documents(spark):
    rows = awkward()
    check(rows, suffix.repeat_report(documents(spark, rows, extra=True), 200).collect(), 200)


def test_empty_table_and_tables_without_long_texts(spark):
    assert suffix.repeat_report(documents(spark, [(1, "x")]).where("false")).count() == 0
    rows = [(1, "x"), (2, None)]
    check(rows, suffix.repeat_report(documents(spark, rows)).collect(), 200)


def test_cut_texts_stay_whole_characters(spark):
    rng = random.Random(8)
    passage = "é" * 99 + "xyz" + prose(rng, 50)
    rows = [(0, "ä" + passage + "ö"), (1, "ü" + passage + "ß end"), (2, None), (3, "short"), (4, prose(rng, 60))]
    df = documents(spark, rows, extra=True)
    got = {r.doc_id: r for r in suffix.remove_repeats(df).collect()}
    assert suffix.remove_repeats(df).columns == [*(c for c in df.columns if c != "n_removed"), "n_removed"]  # the given one gives way
    assert suffix.remove_repeats(df, into="cut").columns == [*df.columns, "cut"]
    for (i, text), (_, removed, _, _, kept) in zip(rows, brute([t for _, t in rows], 200), strict=True):
        assert got[i].n_removed == removed
        assert got[i].text == (None if text is None else got[i].text)
        if not removed and text is not None:
            assert got[i].text == text
        elif text is not None:
            # the bytes left, but for characters of which only a part repeats
            assert set(kept.decode(errors="ignore")) <= set(got[i].text) and len(got[i].text.encode()) - len(kept) <= 2
        assert got[i].rep == "rep" and got[i].lang == "en"


def test_packed_places_round_trip():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, high, 500) for high in (2**31, 200, 200, 2**17)]
    assert all((a == b).all() for a, b in zip(parts, suffix._unpack(suffix._pack(*parts)), strict=True))


def test_neighbours_over_batches_and_edges(monkeypatch):
    import pyarrow as pa
    import pyspark

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(pyspark, "TaskContext", Context)
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 12, 60))
    subs = np.concatenate([np.sort(rng.integers(0, 3, (keys == k).sum())) for k in range(12)])
    table = {"key": pa.array([bytes([7, k, 255 - k]) for k in keys], pa.binary()), "sub": subs, "rid": np.arange(60), "pack": np.arange(60)}
    for cuts in ([60], [1, 2, 30, 60], list(range(1, 61))):
        batches = [pa.record_batch([pa.array(v[a:b]) for v in table.values()], names=list(table)) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        got = {r["rid"]: r for b in suffix._neighbours(iter(batches)) for r in b.to_pylist()}
        for i in range(60):
            near = [j for j in (i - 1, i + 1) if 0 <= j < 60 and keys[j] == keys[i]]
            same, alone = any(subs[j] == subs[i] for j in near), any(subs[j] != subs[i] for j in near)
            status = (3 if alone else 1) if same else (2 if alone else 0)
            if status or i in (0, 59):
                assert got[i]["status"] == status and got[i]["edge"] == {0: 1, 59: 2}.get(i, 0)
            else:
                assert i not in got


def test_many_rows_with_a_null_or_one_hot_id(spark, monkeypatch):
    monkeypatch.setattr(suffix, "_TAG", 2)
    rng = random.Random(14)
    passage = prose(rng, 60)
    rows = [(None if i % 2 else 7, f"{prose(rng, rng.randrange(1, 60))} {passage if i % 3 == 0 else ''} {prose(rng, 60)}") for i in range(120)]
    check(rows, suffix.repeat_report(documents(spark, rows), 200).collect(), 200)
    cut = Counter(r.n_removed for r in suffix.remove_repeats(documents(spark, rows)).collect())
    assert cut == Counter(removed for _, removed, _, _, _ in brute([t for _, t in rows], 200))


def test_suffixes_are_in_byte_order(spark):
    """Partition after partition, the anchors' leading bytes ascend."""
    rows = corpus(random.Random(9), 40)
    marked = suffix._marked(documents(spark, rows).select("doc_id", "text")).select("rid", "tag", "text").where("octet_length(text) >= 200")
    found = marked.mapInArrow(suffix._regions(200, suffix.ANCHOR), "key binary, sub long, rid long, pack long")
    keys = [bytes(r.key) for r in found.repartitionByRange(3, "key", "sub", "rid", "pack").sortWithinPartitions("key", "sub", "rid", "pack").collect()]
    assert keys == sorted(keys) and {len(k) for k in keys} == {suffix.ANCHOR}
    data = {t.encode() for _, t in rows}
    assert all(any(k in d for d in data) for k in keys)
