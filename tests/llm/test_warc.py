import gzip
import hashlib
import io
import json
import random

import pytest
from pyarrow import fs

from treegate.llm import warc
from treegate.llm.common import Workspace

from .helpers import prose

SCHEMA = "page_id long, url string, html string"


def pages():
    rng = random.Random(4)
    shared = "<p>" + prose(rng, 60)
    return [
        (0, "http://a/0", shared), (1, "http://a/1", shared), (2, None, None), (3, "http://a/3", ""), (4, "http://a/4", "short"), (5, "http://a/5", "short"), (6, "http://a/6\r\nX: y", "é" * 50), (7, "http://a/7", "é" * 50),
        (7, "http://a/7", "é" * 50), (None, "http://a/n", shared), (8, "http://a/8", "x" * 99), (9, "http://a/9", "x" * 99), (10, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 5), (11, "u", prose(rng, 4000)),
    ]


def want(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        equal = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        revisit = len(data) >= 100 and i is not None and i > min(equal)
        out.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", min(equal) if revisit else None))
    return sorted(out)


@pytest.mark.parametrize("size", [warc.ARCHIVE_BYTES, 300])
def test_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    df = spark.createDataFrame(pages(), SCHEMA).selectExpr("*", "'x' as digest", "1 as first", "2 as payload").repartition(3)
    got = warc.archive_round_trip(df).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want(pages())


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_payloads_come_back(spark):
    folder = Workspace(spark, "warc-test").path
    warc.write_archives(spark.createDataFrame(pages(), SCHEMA), folder)
    got = warc.read_archives(spark, folder, with_payload=True).where("record_type = 'response'").collect()
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got)
    # the monolithic streams are gone, each archive has its index
    where, path = fs.FileSystem.from_uri(f"{folder}/warc")
    names = [x.base_name for x in where.get_file_info(fs.FileSelector(path))]
    assert len([n for n in names if n.endswith(".index")]) == len([n for n in names if n.endswith(".warc.gz")]) > 0
    assert where.get_file_info(fs.FileSelector(path.removesuffix("warc") + "raw")) == []


@pytest.mark.parametrize("monolithic", [True, False])
def test_normaliser(monolithic):
    rng = random.Random(1)
    bodies = [rng.randbytes(rng.choice([0, 1, 5000])) for _ in range(20)] + [b"\r\n\r\nWARC/1.1\r\n"]
    parts = [warc.record("response", f"http://x/{i}", str(i), hashlib.sha256(b).hexdigest(), b) for i, b in enumerate(bodies)]
    source = gzip.compress(b"".join(parts)) if monolithic else b"".join(gzip.compress(p) for p in parts)
    out = io.BytesIO()
    index = warc.normalise(io.BytesIO(source), out)
    data = out.getvalue()
    assert len(index) == len(bodies) and gzip.decompress(data) == b"".join(parts)
    for i in rng.sample(range(len(bodies)), 10):
        headers, body = warc.read_at(data, index[i]["offset"], index[i]["length"])
        assert body == bodies[i] and headers.text("WARC-Target-URI") == f"http://x/{i}"
    assert json.loads(json.dumps(index)) == index


def test_broken_streams():
    part = warc.record("response", "u", "1", "d", b"body")
    for cut in (part[:-8], part[:30]):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(cut)))


def test_heads_as_crawlers_write_them():
    """Lower case, no blank after the colon, folded lines, Latin-1, bare line feeds; records come out byte for byte."""
    heads = [
        b"WARC/1.0\r\nwarc-type: response\r\ncontent-length: 5\r\nwarc-record-id: <urn:page:1>\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type:response\r\nWARC-Record-ID:<urn:page:2>\r\nContent-Length:5\r\n\r\n",
        b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/a\r\n b\r\n\tc\r\nContent-Length: 5\r\n\r\n",
        "WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/é\r\nContent-Length: 5\r\n\r\n".encode("latin-1"),
        b"WARC/1.1\nWARC-Type: metadata\nContent-Length: 5\n\n",
    ]
    parts = [h + f"bod\n{i}".encode() + b"\r\n\r\n" for i, h in enumerate(heads)]
    data = b"".join(parts)
    for cut in (len(data), 7, 100):  # members end anywhere
        source = b"".join(gzip.compress(data[i : i + cut]) for i in range(0, len(data), cut))
        out = io.BytesIO()
        index = warc.normalise(io.BytesIO(source), out)
        assert [gzip.decompress(out.getvalue()[x["offset"] : x["offset"] + x["length"]]) for x in index] == parts
        assert [x["type"] for x in index] == ["response"] * 4 + ["metadata"]
        assert [x["url"] for x in index] == [None, None, "http://x/a b c", "http://x/é", None]
        assert [warc.read_at(out.getvalue(), x["offset"], x["length"])[1] for x in index] == [f"bod\n{i}".encode() for i in range(5)]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"WARC/1.1\r\nWARC-Type: x\r\n\r\n")))


def test_files_of_other_attempts_are_not_read(spark):
    folder = Workspace(spark, "warc-test").path
    made = [r.file for r in warc.write_archives(spark.createDataFrame(pages(), SCHEMA), folder).collect()]
    where, path = fs.FileSystem.from_uri(f"{folder}/warc")
    stem = made[0].removesuffix(".warc.gz")
    for end in (".warc.gz", ".index"):
        where.copy_file(f"{path}/{stem}{end}", f"{path}/pages-000000-000000-lost{end}")
    assert warc.read_archives(spark, folder).count() == len(pages())


def test_pages_that_the_bitmap_wrongly_holds_keep_their_payloads(spark, monkeypatch):
    from treegate.llm import common

    exact = common.marked
    monkeypatch.setattr(warc, "marked", lambda df, wanted, *key: exact(df, wanted, *key, bits=7))
    monkeypatch.setattr(warc, "likely", lambda df, wanted, *key: common.likely(df, wanted, *key, bits=7))
    rng = random.Random(6)
    rows = [(i, f"u{i}", "<p>" + (prose(rng, 30) if i % 3 else "same page " * 20)) for i in range(120)] + pages()
    got = warc.archive_round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want(rows)
