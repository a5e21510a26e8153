"""The pipeline's stages, one after the other, against plain Python on the same rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from treegate.llm.queries import ORACLES, QUERIES

from .helpers import documents, prose
from .test_neardup import brute as near
from .test_suffix import brute as repeats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    at = tmp_path_factory.mktemp("sf")
    items = [(i, prose(rng, 30)) for i in range(5)]
    passage = prose(rng, 60)
    rows = [(i, prose(rng, rng.randrange(30, 200))) for i in range(80)]
    rows += [(80 + i, rows[i][1]) for i in range(10)]  # exact copies
    rows += [(90 + i, rows[20 + i][1].replace(" ", " Q", 1)) for i in range(5)]  # near copies
    rows += [(100 + i, f"{prose(rng, 40)} {passage} {prose(rng, 40)}") for i in range(6)]
    rows += [(110 + i, f"{prose(rng, 60)} {items[i][1]} {prose(rng, 60)}") for i in range(5)]
    rows += [(120, "123 456 !!!"), (121, None), (122, ""), (None, prose(rng, 50))]
    documents(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    steps = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        steps.append({r.doc_id: r for r in docs.collect()})
    spoken, single, cut, clean = steps
    assert before.keys() - spoken.keys() == {120, 121, 122}
    groups = near([(i, r.text) for i, r in spoken.items()], 5)
    assert single.keys() == {i for i in spoken if i is None or groups[i] == i}
    rows = list(single.values())
    for r, (_, removed, _, _, kept) in zip(rows, repeats([r.text for r in rows], 200), strict=True):
        assert r.doc_id in cut
        got = cut[r.doc_id].text
        # characters of which only a part repeats stay whole
        assert got == r.text if not removed else 0 <= len(got.encode()) - len(kept) <= 2
        assert cut[r.doc_id].n_chars == (len(got) if removed else r.n_chars)
    assert sum(cut[i].text != r.text for i, r in single.items()) == 6
    assert cut.keys() - clean.keys() == set(range(110, 115))


def test_run_packs_what_is_left(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert len({r.doc_id for r in rows}) == len(rows) > 80
    assert sum(r.length for r in rows) <= 4096 * len({r.sequence_id for r in rows})
    # the product holds the tokens themselves
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in rows)


def test_an_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert ORACLES.keys() <= QUERIES.keys()


def test_one_row_stays_of_repeated_ids_and_null_id_copies(spark, tmp_path):
    rng = random.Random(33)
    texts = [prose(rng, 120) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(0, texts[0]), (0, texts[0])]  # ingested again under one id
    rows += [(None, texts[1]), (None, texts[1])]  # copies without an id
    twice = prose(rng, 120)
    rows += [(None, twice), (None, twice)]  # only copies without an id
    rows += [(2, prose(rng, 120))]  # one id, two texts
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, prose(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.minhash_near_dedup(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    want = sorted([*((str(i), t) for i, t in enumerate(texts)), ("None", twice), ("2", rows[-1][1])])
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == want
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in packed if not r.start) == sorted(i for i, _ in want)


def test_columns_of_any_name_pass_all_stages(spark, folder):
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    docs = documents(spark, [(r.doc_id, r.text) for r in plain.collect()], extra=True).withColumns({"group": F.lit("group"), "o": F.lit("o")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() > 60
        assert all(r[c] == c for r in docs.collect() for c in docs.columns[5:])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()
