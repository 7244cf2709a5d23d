import hashlib
import io

import pytest

from skein.llm import warc
from skein.llm.common import fresh_path

SCHEMA = "page_id long, url string, html string, payload string, digest int"


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>ünïcode</p>" * 200
    rows = [(i, f"http://x/{i}\r\nX: y", long if i % 3 == 0 else f"<html>{i}" + "common markup " * (i % 7) + str(i), "p", 1) for i in range(90)]
    rows += [(100, None, None, None, None), (101, "u", "", None, None), (102, "u", "short", None, None), (103, "u", "short", None, None), (None, "n", "null id", None, None)]
    rows += [(None, "n", long, None, None), (105, "v", "w" * 3_000_000, None, None), (200, "r", "same" * 400, None, None), (200, "r", "same" * 400, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_round_trip(spark, pages):
    listed = warc.write(pages, fresh_path(spark, "warc"), archive_bytes=40_000)
    got = warc.read(listed).collect()
    assert listed.select("path").distinct().count() > 1 and listed.count() == len(got) == pages.count()
    rows = pages.collect()
    html = {r.page_id: r.html or "" for r in rows if r.page_id is not None}
    top: dict = {}
    for r in rows:
        if r.page_id is not None:
            top[r.html] = max(top.get(r.html, -1), r.page_id)
    seen = 0
    for r in got:
        if r.page_id is None:
            continue
        body = html[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        first = len(body) < 1000 or top[html[r.page_id]] == r.page_id
        if r.page_id == 200:
            seen += r.record_type == "response"
            assert r.record_type == "response" or r.refers_to == 200
        else:
            assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", 87))
        assert bytes(r.payload) == (body if r.record_type == "response" else b"")
    assert seen == 1
    assert sum(r.page_id is None and r.record_type == "revisit" and r.refers_to == 87 for r in got) == 1


def test_dictionary_frame():
    import zstandard as zs

    records = [warc.record("response", i, "u", (f"<p>{i * 7919 % 1000} shared words in all pages</p>" * 8).encode(), 1, "d") for i in range(400)]
    out = io.BytesIO()
    places = warc.write_archive(out, records)
    data = out.getvalue()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    n = int.from_bytes(data[4:8], "little")
    assert places[0][0] == 8 + n and len(data) < sum(len(zs.compress(r)) for r in records) + 8 + n
    one = zs.ZstdDecompressor(dict_data=zs.ZstdCompressionDict(data[8 : 8 + n]))
    a, b = places[123]
    assert one.decompress(data[a : a + b]) == records[123]
    assert [warc.parse(r) for r in records] == list(warc.read_archive(data, places))


@pytest.mark.parametrize("records", [[b"one"], [b"WARC" * n for n in range(1, 9)], [b"", b"x" * 5_000_000]])
def test_few_records_have_a_dictionary_too(records):
    out = io.BytesIO()
    places = warc.write_archive(out, records)
    data = out.getvalue()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    assert [warc.decompressor(data).decompress(data[a : a + n]) for a, n in places] == records


def test_pieces_are_spread_over_the_record():
    raw = bytes(range(256)) * 64
    got = warc.pieces_of(raw)
    assert len(got) == 4096 and got[:1024] == raw[:1024] and got[-1024:] == raw[-1024:]


def test_record_by_its_place(spark, pages):
    index = warc.write(pages, fresh_path(spark, "warc"), archive_bytes=40_000)
    ids = []
    for r in index.collect():
        head, body = warc.read_record(r.path, r["at"], r.length)
        assert head["X-Page-Id"] == ("none" if r.page_id is None else str(r.page_id))
        ids.append(head)
    assert len({h["WARC-Record-ID"] for h in ids}) == len(ids) == pages.count()
    responses = {h["WARC-Record-ID"]: h["WARC-Payload-Digest"] for h in ids if h["WARC-Type"] == "response"}
    assert all(responses[h["WARC-Refers-To"]] == h["WARC-Payload-Digest"] for h in ids if h["WARC-Type"] == "revisit")


def test_query(spark, pages, store):
    """The query by the rule, over rows with null ids, repeated rows and a long payload."""
    got = sorted(map(tuple, warc.op2_warc(spark, store(pages=pages)).collect()), key=str)
    rows, want, first = pages.collect(), [], set()
    body = lambda r: (r.html or "").encode()
    top: dict = {}
    for r in rows:
        top[body(r)] = max(top.get(body(r), -1), -1 if r.page_id is None else r.page_id)
    for r in rows:
        b, to = body(r), top[body(r)]
        response = len(b) < 1000 or (r.page_id == to and b not in first)
        first |= {b} if r.page_id == to else set()
        want.append((r.page_id, len(b), hashlib.sha1(b).hexdigest(), "response" if response else "revisit", None if response else to))
    assert got == sorted(want, key=str)


def test_places_without_scheme(spark, tmp_path):
    assert warc.qualified(spark, str(tmp_path)).startswith("file:/")
    with pytest.raises(ValueError):
        warc.filesystem("/plain/path")


def test_empty(spark):
    listed = warc.write(spark.createDataFrame([], SCHEMA), fresh_path(spark, "warc"))
    assert warc.read(listed).count() == 0
