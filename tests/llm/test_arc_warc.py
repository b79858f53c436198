import base64
import gzip
import hashlib

import pytest

from histloom.llm import arc_warc


def archive(version, records):
    return arc_warc.arc_start(version, "old.arc") + b"".join(records)


def test_reads_both_versions_by_their_lengths():
    body = b"HTTP/1.0 200 OK\r\n\r\nhello\nworld"
    one = b"http://a.com/ 1.2.3.4 19961022010203 text/html %d\n%s\n" % (len(body), body)
    two = b"http://a.com/ 1.2.3.4 19961022010203 text/html 200 - - 0 old.arc %d\n%s\n" % (len(body), body)
    for version, record in ((1, one), (2, two)):
        start, got, again = arc_warc.parse_arc(archive(version, [record, b"\n", record]))
        assert start.url == "filedesc://old.arc" and got.content == again.content == body
        assert got.version == version and got.fields["Archive-date"] == "19961022010203"
        (fields, block), = arc_warc.parse_warc(arc_warc.convert(got) + arc_warc.RECORD_END)
        assert block == body and fields["WARC-Date"] == "1996-10-22T01:02:03Z"
        digest = base64.b32encode(hashlib.sha1(b"hello\nworld").digest()).decode()
        assert fields["WARC-Payload-Digest"] == f"sha1:{digest}" and fields["WARC-Type"] == "response"


def test_other_types():
    dns = b"dns:a.com 1.2.3.4 19961022010203 text/dns 3\nabc\n"
    ftp = b"ftp://a.com/x 1.2.3.4 19961022010203 image/gif 2\n\xff\n\n"
    kinds = [arc_warc.warc_type(r) for r in arc_warc.parse_arc(archive(1, [dns, ftp]))]
    assert kinds == [("warcinfo", "application/warc-fields"), ("resource", "text/dns"), ("resource", "image/gif")]


@pytest.mark.parametrize("data", [
    b"not an archive\n", arc_warc.arc_start(1) + b"http://a 1 2 text/html 99\nshort\n",
    arc_warc.arc_start(2) + b"http://a 1 2 text/html 1\nx\n", b"http://a 1.1.1.1 19960101 text/html 1\nx\n",
    arc_warc.arc_start(1).replace(b"\n1 0", b"\n7 0"),
])
def test_broken_archives_are_errors(data):
    with pytest.raises(ValueError):
        list(arc_warc.parse_arc(data))


PAGES = [
    (3, "http://a.org/x y\nz", "same"), (1, "http://b.org/", "same"), (2, None, "other\r\n\r\nWARC/1.1\r\nWARC-Type: x"),
    (4, "http://c.org/", None), (5, "http://c.org/", ""), (6, "http://ä.org/", "é" * 70_000), (7, "u", "é" * 70_000),
    (8, "http://d.org/\u0001", "HTTP/1.1 200\r\n\r\n"), (None, "http://e.org", "null id"), (9, "", "null id"), (1, "http://b.org/", "same"),
    (10, "http://f.org/", "\r\n\r\n\n"), (None, "x", "only null"), (None, "x", "only null"),
]


def plain(pages, min_bytes):
    out = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        ids = [i for i, _, h in pages if (h or "").encode() == payload and i is not None]
        revisit = len(payload) >= min_bytes and ids and page_id != min(ids)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page_id, len(payload), digest, "revisit" if revisit else "response", min(ids) if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 1, 10])
def test_round_trip(spark, tmp_path, monkeypatch, min_bytes):
    docs = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    docs = docs.selectExpr("*", "1 as _sha", "2 as record", "3 as _first").repartition(3)
    got = arc_warc.archive_round_trip(docs, str(tmp_path / "w"), min_bytes=min_bytes)
    rows = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid").collect()
    assert all(r["valid"] for r in rows)
    assert sorted((tuple(r)[:5] for r in rows), key=str) == plain(PAGES, min_bytes)
    for path in (tmp_path / "w").glob("*.gz"):
        assert gzip.decompress(path.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    """Small pages share archives; a page above the bound ends its archive, whole."""
    html = "case when id % 10 = 3 then repeat('long ', 8000) else concat('text ', id) end as html"
    docs = spark.range(50).selectExpr("id as page_id", "'http://a.org/' as url", html).coalesce(1)
    got = arc_warc.archive_round_trip(docs, str(tmp_path / "w"), archive_bytes=10_000).collect()
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").glob("*.gz")]
    # one of the five long pages is a response, the others revisit it
    assert len(sizes) >= 4 and sum(n > 20_000 for n in sizes) == 1 and max(sizes) < 10_000 + 42_000
    assert len(got) == 50 and all(r["valid"] for r in got)
    assert sorted(r["payload_bytes"] for r in got)[-5:] == [40_000] * 5


def test_batches_of_rows_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arc_warc, "ROWS_PER_BATCH", 7)
    docs = spark.range(50).selectExpr("id as page_id", "'http://a.org/' as url", "concat('text ', id) as html")
    got = arc_warc.archive_round_trip(docs, str(tmp_path / "w")).collect()
    assert sorted(r["page_id"] for r in got) == list(range(50))


def test_reads_arc_files(spark, tmp_path):
    for version in (1, 2):
        data = arc_warc.archive_of([("1", "http://a.org/ b", b"x"), (None, None, b"")], version)
        (tmp_path / f"v{version}.arc").write_bytes(data)
        (tmp_path / f"v{version}.arc.gz").write_bytes(gzip.compress(data))
    rows = arc_warc.read_arc(spark, str(tmp_path)).collect()
    assert len(rows) == 12 and {r["fields"]["URL"] for r in rows} == {"filedesc://pages.arc", "http://a.org/%20b", "-"}


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "page_id long, url string, html string")
    assert arc_warc.archive_round_trip(docs, str(tmp_path / "w")).count() == 0
