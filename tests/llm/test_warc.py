"""Bundles: a round trip, seeking, the format as other readers see it, and corner cases."""

import hashlib
import io
import random

import pyarrow.fs as pafs
import pytest
import zstandard

from tidepool.llm import warc

SCHEMA = "page_id long, url string, html string, digest int, last int, `a.b` int"


def slow(pages):
    """Record type and page referred to, row by row."""
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        same = [j for j, _, other in pages if (other or "").encode() == raw]
        last = max((j for j in same if j is not None), default=None)
        refers = last if len(raw) >= 1000 and last is not None and (i is None or i < last) else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(12)
    texts = ["x" * 999, "x" * 1000, "é" * 500, "é" * 499, "", None, "WARC/1.1\r\n\r\n" * 100, "\r\n\r\n", *["".join(rng.choices("abc <>é\r\n", k=n)) for n in (10, 1000, 3000, 5000)]]
    urls = ["http://a.example/", "http://a.example/%0A", "http://b.example/\r\nWARC-Type: x", None, ""]
    rows = [(rng.choice([k, k, k, None]), rng.choice(urls), rng.choice(texts)) for k in range(300)]
    return [*rows, *[(5000 + k, "http://hot.example/", "hot " * 400) for k in range(400)], rows[0], (9000, "u", "long " * 300_000)]


@pytest.fixture(scope="module")
def index(spark, pages):
    frame = spark.createDataFrame([(*p, 1, 2, 3) for p in pages], SCHEMA).repartition(7)
    return warc.write(frame, frame=20_000, bundle=40_000)


def test_round_trip(index, pages):
    got = warc.read(index).collect()
    assert sorted((tuple(r)[:1] + tuple(r)[2:] for r in got), key=repr) == slow(pages)
    assert sorted(((r.page_id, r.url) for r in got), key=repr) == sorted(((i, u) for i, u, _ in pages), key=repr)
    assert sum(r.record_type == "response" for r in got if r.page_id and 5000 <= r.page_id < 6000) == 1


def test_fetch_by_seeking(spark, index, pages):
    ids = sorted({i for i, _, _ in pages if i is not None})
    got = {r.page_id: bytes(r.payload) for r in warc.fetch(index, spark.createDataFrame([(i,) for i in [*ids, 123456]], "page_id long")).collect()}
    assert sorted(got) == ids
    want = {}
    for i, _, html in pages:
        want.setdefault(i, set()).add((html or "").encode())
    assert all(payload in want[i] for i, payload in got.items())


def test_index_tells_offsets_in_frames(index):
    for r in index.where("page_id < 40").collect():
        with warc.Bundle(r.bundle) as held:
            raw = held.frame(r.frame)[r.start : r.start + r.length]
            (found,) = warc.records_of(raw)
            assert found.row()[0] == r.page_id and found.kind == r.record_type


def test_any_reader_can_read_a_bundle(index):
    paths = [r.bundle for r in index.select("bundle").distinct().collect()]
    assert len(paths) > 3
    for path in paths:
        files, place = pafs.FileSystem.from_uri(path)
        raw = files.open_input_stream(place, compression=None).read()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        with warc.Bundle(path) as held:
            assert whole == b"".join(held.frame(k) for k in range(len(held.table)))
            assert held.starts[-1] == raw.index(b"\x5e\x2a\x4d\x18", held.starts[-1])
            # each frame is independent: it unpacks alone
            k = len(held.table) - 1
            assert zstandard.ZstdDecompressor().decompress(raw[held.starts[k] : held.starts[k + 1]]) == held.frame(k)


def test_damage_is_told(tmp_path):
    writer = warc.Writer(f"file://{tmp_path}")
    path, frame, at = writer.add(warc.record(7, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, "1970-01-01T00:00:00Z"))
    writer.close()
    assert (frame, at) == (0, 0)
    place = path.removeprefix("file://")
    raw = open(place, "rb").read()
    with warc.Bundle(path) as held:
        assert [r.payload for r in warc.records_of(held.frame(0))] == [b"payload"]
    with open(place, "wb") as out:
        out.write(raw[:-12] + bytes([raw[-12] ^ 1]) + raw[-11:])
    with warc.Bundle(path) as held, pytest.raises(ValueError):
        held.frame(0)
    other = next(warc.records_of(warc.record(1, None, b"a", hashlib.sha1(b"b").hexdigest(), None, "d")))
    with pytest.raises(ValueError):
        other.row()


def test_empty_table(spark):
    index = warc.write(spark.createDataFrame([], SCHEMA))
    assert warc.read(index).count() == 0
    assert warc.fetch(index, spark.createDataFrame([(1,)], "page_id long")).count() == 0
