import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from treegate.llm import dac, packing, tokenids  # noqa: E402
from treegate.llm.common import Workspace  # noqa: E402
from treegate.llm.tokens import encoder  # noqa: E402

from .helpers import awkward, documents, prose  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


#: The library as it is, not an operator's encoder.
fresh = cache(Tokenizer.from_file)


def plain_ids(path, text):
    return fresh(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.characters(max_codepoint=0x260), st.sampled_from(" '\n\t\x85\xa0İ"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_pieces_encode_as_the_library_encodes_the_text(path, text):
    assert np.frombuffer(encoder(path).encode([text])[0], "<u4").tolist() == plain_ids(path, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40), max_size=8))
def test_token_file_round_trip_and_random_access(docs):
    ids = np.array([x for d in docs for x in d], np.uint32)
    names = [None if i == 2 else i * 7 - 3 for i in range(len(docs))]
    f = dac.TokenFile(dac.encode(names, np.array([len(d) for d in docs], np.int64), ids))
    assert f.doc_ids == names and len(f) == len(ids)
    assert f.all().tolist() == ids.tolist()
    assert [f.token(i) for i in range(len(f))] == ids.tolist()
    assert [f.document(d).tolist() for d in range(len(docs))] == docs


def test_random_access_over_many_blocks():
    ids = np.random.default_rng(3).integers(0, 70_000, 20_000).astype(np.uint32)
    f = dac.TokenFile(dac.encode([1], np.array([len(ids)]), ids))
    assert all(f.token(i) == ids[i] for i in range(0, len(ids), 37))


def test_token_ids_of_awkward_documents(spark):
    rows = awkward()
    got = tokenids.token_ids(documents(spark, rows, extra=True), BYTE).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(np.array(plain_ids(BYTE, t) + [0], "<u4").tobytes())
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in [(len(x) // 4, zlib.crc32(x)) for x in want[r.doc_id]]
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


def test_files_of_many_segments_and_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(tokenids, "SEGMENT_TOKENS", 150)
    monkeypatch.setattr(tokenids, "FILE_SEGMENTS", 3)
    rng = random.Random(8)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, prose(rng, rng.randrange(60))) for i in range(240)]
    folder = Workspace(spark, "tokens-test").path
    segments = tokenids.write_token_files(documents(spark, rows), folder, BYTE)
    made = segments.collect()
    files = Counter(r.file for r in made)
    assert max(files.values()) == 3 and len(made) > 20
    # a third of all rows has no id, and a third has one: several tasks write each
    assert len({r.part for r in made}) == 4
    open(f"{folder.removeprefix('file://')}/tokens-000000-000000-lost.dac", "wb").write(b"left by another attempt")
    got = sorted(tokenids.read_token_files(segments, folder, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    want = Counter((str(i), tuple([*plain_ids(BYTE, t), 0])) for i, t in rows)
    assert Counter((str(r.doc_id), tuple(r.ids)) for r in got) == want
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d or 0))


def test_token_ids_of_an_empty_table(spark):
    assert tokenids.token_ids(documents(spark, [(1, "x")]).where("false"), BYTE).count() == 0


def check_packing(rows, got, capacity, end):
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    want = sorted((str(i), p, 4 * p * capacity // 4, len(x) // 4, zlib.crc32(x)) for i, t in rows for p, x in enumerate(cut(t, capacity, end)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    return len(bins)


def cut(text, capacity, end):
    ids = np.array(plain_ids(WORD, text) + [end], "<u4").tobytes()
    return [ids[a : a + 4 * capacity] for a in range(0, len(ids), 4 * capacity)]


def test_packing_of_awkward_documents(spark):
    rows = awkward()
    got = packing.pack(documents(spark, rows, extra=True), WORD, capacity=256).collect()
    check_packing(rows, got, 256, 1)


def test_packing_is_close_to_the_bound(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.choice([3, 3, 20, 60, 200]))) for i in range(400)]
    got = packing.pack(documents(spark, rows), WORD, capacity=512).collect()
    used = check_packing(rows, got, 512, 1)
    assert used <= -(-sum(r.length for r in got) // 512) + 1


def test_packing_carries_ids_where_asked(spark):
    rows = [(1, "a b c"), (2, None)]
    for r in packing.pack(documents(spark, rows), WORD, capacity=4, with_ids=True).collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length


def test_packing_of_an_empty_table(spark):
    assert packing.pack(documents(spark, [(1, "x")]).where("false"), WORD).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=8), st.integers(1, 60))
def test_fullest_is_the_best_subset_sum(counts, room):
    order = sorted(counts, reverse=True)
    got = packing.fullest(order, counts, room)
    assert all(got.count(n) <= counts[n] for n in got)
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
    assert sum(got) == max(sums)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_a_plan_uses_up_the_histogram(histogram):
    used = defaultdict(int)
    for times, fill in packing.plan(histogram, 64):
        assert times > 0 and sum(fill) <= 64
        for n in fill:
            used[n] += times
    assert dict(used) == histogram


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_added_tokens_are_taken_as_the_library_takes_them(path):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|startoftext|>", "<|endoftext|><|endoftext|>x", "<|ENDOFTEXT|> y", "a <| endoftext|> b", "plain words", "é <|endoftext|> 漢字", ""]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder(path).encode(texts)]
    assert got == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    if path == BYTE:
        assert got[0] == [64, 220, 50256, 275]


def test_token_ids_and_packing_with_added_tokens(spark):
    from tokenizers import Tokenizer

    rows = [(1, "a <|endoftext|> b"), (2, "c d"), (3, "<|startoftext|>e<|endoftext|>")]
    for path, end, got in ((BYTE, 0, tokenids.token_ids(documents(spark, rows), BYTE)), (WORD, 1, packing.pack(documents(spark, rows), WORD, capacity=4096))):
        fresh = Tokenizer.from_file(path)
        want = {i: zlib.crc32(np.array([*fresh.encode(t, add_special_tokens=False).ids, end], "<u4").tobytes()) for i, t in rows}
        assert {r.doc_id: r.ids_crc32 for r in got.collect()} == want
