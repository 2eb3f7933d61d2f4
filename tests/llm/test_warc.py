from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import zlib
from html.parser import HTMLParser

from palletwatch.llm.queries import op7_warc_derivatives
from palletwatch.llm.warc import derive, derived_records, page_responses, split_message

HEAD = "HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\nX-Two: a: b\r\n\r\n"
SCHEMA = "record_id string, target_uri string, date string, block string, lang string, header string"


def sha1(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


class Text(HTMLParser):
    """All visible text of a page, with a line feed where a block begins or ends."""

    def __init__(self):
        super().__init__()
        self.parts, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style")
        self.parts.append("" if tag in ("a", "b", "br") else "\n")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style")
        self.parts.append("" if tag in ("a", "b") else "\n")

    def handle_data(self, data):
        if not self.off:
            self.parts.append(" ".join(data.split("\n")))


def test_records_of_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r["page_id"]: r for r in pages.collect()}
    rows = op7_warc_derivatives(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 2 * len(source) and len({r["record_id"] for r in rows}) == len(rows)
    for r in rows:
        page = source[r["page_id"]]
        assert r["target_uri"] == page["url"] and r["refers_to"].startswith("<urn:uuid:")
        assert r["block_digest"] == sha1(r["block"]) and r["content_length"] == len(r["block"].encode())
        for line in (f"WARC-Refers-To: {r['refers_to']}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Type: {r['record_type']}"):
            assert line in r["header"].split("\r\n")
        if r["record_type"] == "metadata":
            assert f"source-payload-digest: {sha1(page['html'])}\r\n" in r["block"]
            assert f"outlinks: {len(re.findall('<a href=', page['html']))}\r\n" in r["block"]
        else:
            reader = Text()
            reader.feed(page["html"])
            lines = [" ".join(line.split()) for line in "".join(reader.parts).split("\n")]
            assert r["block"] == "\n".join(line for line in lines if line)


def test_odd_responses(spark):
    rows = [
        ("<urn:uuid:1>", "http://a", "2024", HEAD + "<title>A  b</title><p>x &amp; y</p>", "en", "mine"),
        ("<urn:uuid:2>", None, None, "HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\u0001\u0002", "en", "mine"),
        ("<urn:uuid:3>", "http://c", "2024", "HTTP/1.0 200 OK\nContent-Type: text/plain\n\nplain <b>", None, None),
        ("<urn:uuid:4>", "http://d", "2024", None, None, None),
        (None, "http://e", "2024", "no message at all", None, None),
        (None, "http://e", "2024", "no message at all", None, None),
        (None, None, None, "", None, None),
    ]
    got = derived_records(spark.createDataFrame(rows, SCHEMA).coalesce(1), keep=("lang",)).collect()
    kinds = [(r["refers_to"], r["record_type"]) for r in got]
    assert kinds.count(("<urn:uuid:2>", "metadata")) == 1 and ("<urn:uuid:2>", "conversion") not in kinds
    by = {(r["refers_to"], r["record_type"]): r for r in got}
    assert by["<urn:uuid:1>", "conversion"]["block"] == "A b\nx & y"
    meta = by["<urn:uuid:1>", "metadata"]["block"]
    assert "http-status: HTTP/1.1 404 Not Found\r\n" in meta and "http-header-x-two: a: b\r\n" in meta and "title: A b\r\n" in meta
    assert by["<urn:uuid:3>", "conversion"]["block"] == "plain <b>"
    assert by["<urn:uuid:4>", "conversion"]["block"] == "" and by["<urn:uuid:4>", "conversion"]["content_length"] == 0
    assert "WARC-Target-URI" not in by["<urn:uuid:2>", "metadata"]["header"]
    assert len(got) == 13 and sum(r["target_uri"] == "http://e" for r in got) == 4
    assert by["<urn:uuid:1>", "metadata"]["lang"] == "en"


def test_empty_table_and_null_pages(spark):
    assert derived_records(spark.createDataFrame([], SCHEMA)).count() == 0
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>x</p>")], "page_id long, url string, html string")
    got = derived_records(page_responses(pages, "2024"), keep=("page_id",)).collect()
    assert len(got) == 4 and {r["block"] for r in got if r["record_type"] == "conversion"} == {"", "x"}


def test_message_parts():
    assert split_message(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nrest\r\n\r\nmore") == ("HTTP/1.1 200 OK", [("A", "b")], b"rest\r\n\r\nmore")
    assert split_message(html.unescape("&lt;p>").encode()) == ("", [], b"<p>")


def made(headers, body):
    rows = list(derive("<urn:uuid:1>", "http://a", "2024", f"HTTP/1.1 200 OK\r\n{headers}\r\n\r\n".encode() + body))
    return {row[0]: row[-1] for row in rows}


PAGE = "<title>Caf&eacute; &amp; über</title><p>Café über</p>"
TEXT = "Café & über\nCafé über"


def chunked(data, size=7):
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    return b"".join(b"%x;x=y\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\nTrailer: x\r\n\r\n"


def raw(data):
    make = zlib.compressobj(wbits=-15)
    return make.compress(data) + make.flush()


def test_bodies_as_sent():
    utf = PAGE.encode()
    for headers, body in [
        ("Content-Type: text/html; charset=iso-8859-1", PAGE.encode("latin-1")),
        ("Content-Type: text/html;\r\n\tcharset=\"ISO-8859-15\"", PAGE.encode("iso-8859-15")),
        ("Content-Type: text/html", b'<meta http-equiv=x content="text/html; charset=windows-1252">' + PAGE.encode("cp1252")),
        ("Content-Type: text/html", b"<meta charset='latin1'>" + PAGE.encode("latin-1")),
        ("Content-Type: text/html; charset=latin1", b"\xef\xbb\xbf" + utf),
        ("Content-Type: text/html", b"\xff\xfe" + PAGE.encode("utf-16-le")),
        ("Content-Type: text/html\r\nContent-Encoding: gzip", gzip.compress(utf[:20]) + gzip.compress(utf[20:])),
        ("Content-Type: text/html\r\nContent-Encoding: deflate", zlib.compress(utf)),
        ("Content-Type: text/html\r\nContent-Encoding: deflate", raw(utf)),
        ("Content-Type: text/html\r\nTransfer-Encoding: chunked", chunked(utf)),
        ("Content-Type: text/html\r\nTransfer-Encoding: chunked\r\nContent-Encoding: x-gzip", chunked(gzip.compress(utf))),
        ("Content-Type: text/html\r\nTransfer-Encoding: gzip, chunked\r\nContent-Encoding: identity", chunked(gzip.compress(utf))),
    ]:
        got = made(headers, body)
        assert got["conversion"] == TEXT, headers
        assert "title: Café & über\r\n" in got["metadata"] and "unreadable" not in got["metadata"]


def test_bodies_that_cannot_be_read_give_metadata_only():
    for headers, body, why in [
        ("Content-Encoding: br", b"xx", "content coding br"), ("Content-Encoding: gzip", b"plain", "broken gzip"),
        ("Content-Encoding: gzip", gzip.compress(b"x" * 99)[:20], "broken gzip"), ("Transfer-Encoding: chunked", b"zz\r\nx", "broken chunks"),
        ("Transfer-Encoding: chunked", b"9\r\nx", "broken chunks"), ("Content-Type: text/html; charset=no-such", b"x", "character set no-such"),
        ("Content-Type: text/plain; charset=hex", b"x", "character set hex"),
    ]:
        got = made(headers, body)
        assert set(got) == {"metadata"} and f"unreadable: {why}\r\n" in got["metadata"], headers
    assert set(made("Content-Type: image/png\r\nContent-Encoding: br", b"x")) == {"metadata"}
    assert made("Content-Encoding: gzip", b"")["conversion"] == ""


def test_folded_header_lines():
    assert split_message(b"HTTP/1.1 200 OK\r\nA: b\r\n  c\r\nD: e\r\n\r\nx")[1] == [("A", "b c"), ("D", "e")]


def test_kept_columns_give_way_to_those_of_the_records(spark):
    rows = [("<urn:uuid:1>", "http://a", "2024", HEAD + "x", "en", "mine")]
    got = derived_records(spark.createDataFrame(rows, SCHEMA), keep=("lang", "header", "record_id", "block", "lang"))
    assert len(set(got.columns)) == len(got.columns) and got.columns[0] == "lang"
    assert all(r["header"].startswith("WARC/1.0") and r["record_id"] != "<urn:uuid:1>" for r in got.collect())
