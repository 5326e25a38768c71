import gzip
import html.parser
import random

import pytest

from credlens.llm import warc

BLOCKS = {"title", "p", "h1", "div", "br", "li", "ul", "nav", "article", "footer", "head", "header", "body"}


class Slow(html.parser.HTMLParser):
    """The same text by a parser."""

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def slow_text(page):
    parser = Slow()
    parser.feed(page)
    parser.close()
    return "\n".join(x for raw in "".join(parser.out).split("\n") if (x := " ".join(raw.split())))


def response(payload, headers=(), http="HTTP/1.1 200 OK\r\nContent-Type: text/html", **more):
    block = http.encode() + b"\r\n\r\n" + payload
    return warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:a>"), ("WARC-Target-URI", "http://x.org/a/b"),
                        ("WARC-Date", "2024-05-06T07:08:09Z"), *headers, *more.items()], block)


def test_links_and_headers_are_kept():
    page = b'<html lang=fr><title>A &amp; B</title><a href="../c?d=1&amp;e=2">go</a><script>"<a href=no>"</script><p>text<br>more'
    meta, text = warc.derive(response(page, [("WARC-Payload-Digest", warc.digest(page)), ("X-Own", "kept")]))
    assert meta[0] == "metadata" and text[0] == "conversion" and {meta[2], text[2]} == {"<urn:a>"}
    assert meta[1] != text[1] and meta[3:5] == text[3:5] == ("http://x.org/a/b", "2024-05-06T07:08:09Z")
    assert meta[6] == text[6] == warc.digest(page) and meta[7] is True
    fields = meta[9].split("\r\n")
    assert {"source-X-Own: kept", "title: A & B", "language: fr", "outlink: http://x.org/c?d=1&e=2",
            "http-status-line: HTTP/1.1 200 OK", f"source-WARC-Payload-Digest: {warc.digest(page)}"} <= set(fields)
    assert sum(f.startswith("outlink") for f in fields) == 1
    assert text[9] == "A & B\ngo\ntext\nmore"
    assert warc.derive(response(page)) == warc.derive(response(page))


def test_encodings_and_wrong_digest():
    page = "<p>été</p>".encode("latin-1")
    chunked = b"5\r\n" + page[:5] + b"\r\n5;x=1\r\n" + page[5:] + b"\r\n0\r\n\r\n"
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html;\r\n charset=ISO-8859-1\r\nTransfer-Encoding: chunked"
    rows = warc.derive(response(chunked, [("WARC-Payload-Digest", "sha1:WRONG")], http))
    assert rows[1][9] == "été" and rows[0][7] is False and rows[0][6] == "sha1:WRONG"
    packed = gzip.compress(b"<b>packed</b>")
    assert warc.derive(response(packed, (), "HTTP/1.1 200 OK\r\nContent-Encoding: gzip"))[1][9] == "packed"
    assert warc.derive(response(b"a <b> c", (), "HTTP/1.1 200 OK\r\nContent-Type: text/plain"))[1][9] == "a <b> c"


def test_text_equals_a_parser():
    rng = random.Random(4)
    parts = ["<p>", "</p>", "word", " ", "\n", "&amp;", "&lt;", "<b>", "</b>", "<br>", "<!-- no -->", "<script>x()</script>",
             '<div class="a">', "</div>", "&eacute;", "<li>", "5 "]
    for _ in range(500):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert warc.visible_text(page) == slow_text(page)


def test_pages(spark):
    rows = [(1, "http://a.org/", "<p>x</p>"), (1, "http://a.org/", "<p>x</p>"), (2, None, None), (None, "http://b.org", ""),
            (3, "http://c.org", "<p>" + "long " * 50_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, record string")
    out = warc.build_derivatives(warc.response_records(pages), "record", "page_id").collect()
    assert len(out) == 2 * len(rows) and all(r.digest_valid for r in out)
    assert sorted(len(r.block) for r in out if r.record_type == "conversion") == [0, 0, 1, 1, 5 * 50_000 - 1]
    assert {r.target_uri for r in out if r.page_id == 2} == {None}
    assert warc.build_derivatives(warc.response_records(pages.limit(0)), "record", "page_id").count() == 0


def test_odd_records(spark):
    other = warc.record([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:b>")], b"")
    rows = [(1, None), (2, b"no record"), (3, other), (4, warc.record([("WARC-Type", "response")], b"")), (5, response(b""))]
    out = warc.build_derivatives(spark.createDataFrame(rows, "k bigint, record binary"), "record", "k").collect()
    assert sorted((r.k, r.record_type) for r in out) == [(1, "invalid"), (2, "invalid"), (4, "invalid"), (5, "conversion"), (5, "metadata")]


def test_files_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", f"<p>page {i} é</p>") for i in range(40)], "page_id bigint, url string, html string")
    derived = warc.build_derivatives(warc.response_records(pages.repartition(3)))
    folder = f"file://{tmp_path}/out"
    assert sum(r.records for r in warc.write_warc(derived, folder).collect()) == 80
    want = {r.record_id: r for r in derived.collect()}
    read = warc.read_warc(spark, folder, chunk=100)
    files = sum(1 for p in (tmp_path / "out").iterdir() if p.name.endswith(".warc.gz"))
    assert files > 1 and read.rdd.getNumPartitions() == files  # one task per file, not coalesced into one
    got = [warc.parse_record(bytes(r.record)) for r in read.collect()]
    assert len(got) == 80
    for headers, _, block in got:
        row = want[headers["warc-record-id"]]
        assert block.decode() == row.block and headers["warc-refers-to"] == row.refers_to
        assert headers["warc-block-digest"] == warc.digest(block) == row.block_digest


def test_bad_length():
    with pytest.raises(ValueError):
        warc.parse_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")
