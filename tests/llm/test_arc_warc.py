import gzip
import hashlib
import io

import pytest

from tracelore.llm import arc_warc as aw

V2 = b"filedesc://x.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 x.arc 40\n2 0 someone\nURL IP-address rest of names"
V1 = b"filedesc://x.arc 0.0.0.0 19970102 text/plain 13\n1 0 someone\nU\nhttp://a b/c 1.2.3.4 19970102030405 text/html 5\nhello\n\nhttp://d 1.2.3.4 19970102 text/html 0\n\n"


def test_version_1_with_space_in_url():
    records = list(aw.read_arc(io.BytesIO(V1)))
    assert [(r.header["url"], r.body) for r in records] == [("http://a b/c", b"hello"), ("http://d", b"")]
    assert aw.warc_date(records[0].header["date"]) == "1997-01-02T03:04:05Z"
    assert aw.warc_date(records[1].header["date"]) == "1997-01-02T00:00:00Z"
    assert aw.warc_date("nonsense") == "1970-01-01T00:00:00Z"


def test_version_2_fields_and_errors():
    head = aw.arc_opening(2, "x.arc.gz", "20010203040506")
    line = aw.arc_line(2, {"url": "http://a/b c", "ip": "1.1.1.1", "date": "20010203040506", "content-type": "t", "result-code": "200", "offset": "9", "filename": "x", "length": "3"})
    (r,) = aw.read_arc(io.BytesIO(head + line + b"abc\n"))
    assert r.header["url"] == "http://a/b%20c" and r.header["checksum"] == "-" and r.body == b"abc"
    for broken in (b"http://no.block 1 2 3 4\n", head + line + b"ab", head + b"one two 3\n", head.replace(b"2 0 trace", b"7 0 trace")):
        with pytest.raises(aw.BadArchive):
            list(aw.read_arc(io.BytesIO(broken)))
    assert list(aw.read_arc(io.BytesIO(b""))) == []


def arc(url, body, kind="text/html"):
    return aw.ArcRecord(7, {"url": url, "ip": "1.2.3.4", "date": "20010203040506", "content-type": kind, "length": str(len(body))}, body)


def test_record_keeps_identity():
    head = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n"
    r = arc("http://u", head + b"hello")
    (fields, block), = aw.read_warc(io.BytesIO(aw.warc_record("a.arc.gz", r, None)))
    assert fields["warc-type"] == "response" and block == head + b"hello" and fields["content-type"] == "application/http; msgtype=response"
    assert fields["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"hello").hexdigest()
    assert fields["warc-record-id"] == aw.record_id("a.arc.gz", 7, r.header) != aw.record_id("a.arc.gz", 8, r.header)
    (fields, block), = aw.read_warc(io.BytesIO(aw.warc_record("a.arc.gz", r, ("<urn:x>", "http://o", "2001-02-03T04:05:06Z"))))
    assert fields["warc-type"] == "revisit" and fields["warc-refers-to"] == "<urn:x>" and b"hello" not in block and b"Content-Length: 5" in block


def test_types_follow_what_was_stored():
    """Nothing is invented for a body without an HTTP head: it stays as it is, under its own content type."""
    for url, kind, want in (("dns:example.org", "text/dns", "resource"), ("metadata:http://x", "text/anvl", "metadata"), ("ftp://h/f", "text/plain", "resource"), ("http://old", "text/html", "resource")):
        (fields, block), = aw.read_warc(io.BytesIO(aw.warc_record("a.arc.gz", arc(url, b"said", kind), None)))
        assert (fields["warc-type"], fields["content-type"], block) == (want, kind, b"said")
    opening = next(aw.read_arc(io.BytesIO(aw.arc_opening(2, "x.arc.gz", "20010203040506")), opening=True))
    (fields, block), = aw.read_warc(io.BytesIO(aw.warc_info("x.arc.gz", opening)))
    assert fields["warc-type"] == "warcinfo" and fields["warc-date"] == "2001-02-03T04:05:06Z" and fields["warc-filename"] == "x.warc.gz" and b"2 0 tracelore" in block


def test_records_without_http_head_are_converted(spark, tmp_path):
    """A file with DNS answers and a page: equal answers are no revisits, as there is no head to keep."""
    body = b"20010203040506\n" + b"example.org. 300 IN A 1.2.3.4\n" * 8
    data = aw.arc_opening(1, "y.arc.gz", "20010203040506")
    for url in ("dns:example.org", "dns:example.net"):
        data += aw.arc_line(1, {"url": url, "ip": "1.2.3.4", "date": "20010203040506", "content-type": "text/dns", "length": str(len(body))}) + body + b"\n"
    (tmp_path / "y.arc.gz").write_bytes(gzip.compress(data))
    index = aw.with_originals(aw.index_arcs(spark.createDataFrame([(f"file://{tmp_path}/y.arc.gz",)], "archive string")))
    records = aw.read_warcs(spark.createDataFrame(aw.convert(index, f"file://{tmp_path}/warc").collect())).collect()
    assert [(r["record_type"], r["payload_bytes"], r["key"]) for r in records] == [("resource", len(body), None)] * 2


def test_round_trip_against_brute_force(spark, tmp_path):
    long, short = "<p>" + "é" * 80 + "</p>", "<p>short</p>"
    rows = [(3, "http://a", long), (1, "http://b c\n", long), (9, None, long), (2, "http://d", short), (4, "http://e", short), (5, "http://f", None), (6, "http://g", ""), (7, "http://h", "x" * 99), (8, "http://i", "x" * 99), (10, "http://j", "y" * 100), (11, "http://k", "y" * 100), (12, "http://l", "z\r\n\r\n" * 5000)]
    pages = spark.createDataFrame([(*r, "extra", 1, 2) for r in rows], "page_id long, url string, html string, record_type string, Key long, c0 long").repartition(3)
    records, warcs = aw.archive(pages, folder=f"file://{tmp_path}", limit=400)
    got = {r["key"]: r for r in records.collect()}
    assert len(got) == len(rows) == records.count()
    for k, _, html in rows:
        data = (html or "").encode()
        same = sorted(i for i, _, h in rows if (h or "").encode() == data)
        revisit = len(data) >= 100 and k != same[0]
        assert got[k]["payload_bytes"] == len(data) and got[k]["payload_digest"] == hashlib.sha256(data).hexdigest()
        assert (got[k]["record_type"], got[k]["refers_to"]) == (("revisit", same[0]) if revisit else ("response", None))
    assert warcs.count() > 1
    for r in warcs.collect():
        with gzip.open(r["archive"].removeprefix("file://")) as f:
            assert [x["warc-type"] == "warcinfo" for x, _ in aw.read_warc(f)] == [True] + [False] * r["records"]


def test_empty_repeats_and_null_keys(spark, tmp_path):
    kind = "page_id long, url string, html string"
    assert aw.archive(spark.createDataFrame([], kind), folder=f"file://{tmp_path}/a")[0].count() == 0
    rows = spark.createDataFrame([(1, "u", "w" * 200), (1, "u", "w" * 200), (None, "v", "w" * 200)], kind)
    out = aw.archive(rows, folder=f"file://{tmp_path}/b")[0].collect()
    assert sorted(r["record_type"] for r in out) == ["response", "revisit", "revisit"]
    assert {r["refers_to"] for r in out if r["record_type"] == "revisit"} == {1}
