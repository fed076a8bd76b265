import gzip
import hashlib
import html
from html.parser import HTMLParser

import pytest
from pyspark.sql import types as T

from plumbline.llm import warc
from plumbline.llm.common import work_folder
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


class Text(HTMLParser):
    """Words of a page by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.hidden, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")
        if tag in warc.BREAKING:
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head")
        if tag in warc.BREAKING:
            self.out.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain", "plain"), ("<p>a&amp;b<p>c<br>d", "a&b\nc\nd"), ("a<!-- <p>x -->b", "a b"), ("<script>var t='</p>';</script>x", "x"), ("<b>bo</b>ld  \n text", "bold text"),
    ("<style>p{}", ""), ("<!DOCTYPE html><html><head><title>T</title></head><body>B</body></html>", "B"), ("1 < 2", "1 < 2"), ("&lt;p&gt; &nbsp; x", "<p> x"), ("<a", "<a")])
def test_plain_text(page, text):
    assert warc.plain_text(page) == text


@pytest.mark.parametrize("page,text", [
    ("<html><head><title>x</title><body><p>All the text</p>", "All the text"), ("<head><title>x</title><meta charset=utf-8><p>text</p>", "text"), ("<head><title>a</title></head>b", "b"),
    ("<head><title>x</title><script>1</script>text", "text"), ("<title>open<p>text", "text"),
    *((f"<p>one</p><{x} width=1/><p>two</p>", "one\ntwo") for x in ("svg", "math", "iframe", "object")), *((f"<p>one</p><{x} a=b><p>two</p>", "one\ntwo") for x in ("svg", "math", "iframe", "object", "template", "noscript")),
    ("a<svg><p>b</p><svg>c</svg>d", "a\nb\nd"), ("a<svg>b<svg>c</svg>d</svg>e", "a e"), ("a<iframe/>b<iframe>c</iframe>d", "a b d"),
    ("a<script>b", "a"), ("a<style>b", "a"), ("a<!-- b", "a"), ("a<!-- <script> -->b<script>c</script>d", "a b d"), ("<style-x>a</style-x>b", "ab")])
def test_silent_elements_without_an_end(page, text):
    assert warc.plain_text(page) == text


@pytest.mark.parametrize("header,page,codec,text", [
    ("text/html; charset=ISO-8859-1", "<p>né €", "cp1252", "né €"), ("text/html; charset=Shift_JIS", "<p>日本語", "cp932", "日本語"), ("text/html", "<meta charset=windows-1251><p>мир", "cp1251", "мир"),
    ("text/html; charset=nonsense", "<p>é", "utf-8", "é"), (None, "<p>é", "utf-8", "é"), ("text/html; charset=latin1", "\ufeff<p>é", "utf-16-le", "é"), ("text/html; charset=utf-8", "<meta charset=latin1><p>é", "utf-8", "é"),
    ("text/html; charset=punycode", "<p>é", "utf-8", "é"), (None, "<meta charset=utf-16><p>é", "utf-8", "é")])
def test_stated_charset(spark, header, page, codec, text):
    headers = [{"name": "content-type", "value": header}] if header else None
    record = {n: None for n in warc.NAMES} | {"record_id": "r", "type": "response", "headers": headers, "payload": bytearray(page.encode(codec))}
    rows = warc.derive(spark.createDataFrame([record], warc.SCHEMA)).collect()
    assert [bytes(r.payload).decode() for r in rows if r.type == "conversion"] == [text]


def test_open_silent_elements_take_linear_time():
    for page in ("<svg>" * 100_000, "<svg/>" * 100_000, "<title>" * 100_000, "<script></script>" * 50_000 + "<script>" * 50_000, "<object>" * 50_000 + "</object>" * 50_000):
        warc.plain_text(page)


def test_open_tags_take_linear_time():
    for page in ("<a href=\"x " * 100_000, "<" * 300_000, "<title>" * 50_000, "<!-- " * 100_000, "<script>" * 50_000, "<p " * 100_000):
        warc.plain_text(page), warc.links(page), [p.search(page) for p in (warc.TITLE, warc.LANGUAGE, warc.CHARSET)]


def test_text_of_pages(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").limit(100).collect():
        p = Text()
        p.feed(r.html)
        assert warc.plain_text(r.html).split() == "".join(p.out).split()


def test_op8(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    rows = QUERIES["op8_warc_derivatives"](spark, SF).collect()
    assert len(rows) == 2 * len(pages)
    by_source = {}
    for r in rows:
        by_source.setdefault(r.refers_to, {})[r.type] = r
    for p in pages:
        body = p.html.encode()
        source = warc.name_id("response", str(p.page_id), p.url, warc.digest(body))
        two = by_source[source]
        text = warc.plain_text(p.html).encode()
        assert two["conversion"].payload_sha256 == hashlib.sha256(text).hexdigest() and two["conversion"].payload_digest == warc.digest(text)
        assert {r.target_uri for r in two.values()} == {p.url} and {r.source_digest for r in two.values()} == {warc.digest(body)} and two["metadata"].n_headers == 2


PAGES = T.StructType().add("page_id", T.LongType()).add("url", T.StringType()).add("html", T.StringType()).add("type", T.StringType()).add("payload", T.StringType())
ODD = [(None, None, None, "x", "y"), (1, "http://a/", "", None, None), (2, "http://b/\r\nX: y", "<a href='/q?a=1&amp;b=2'>é 😀</a>" + "<p>long " * 20_000, None, None), (2, "http://b/", "<p>same", None, None), (2, "http://b/", "<p>same", None, None)]


def test_round_trip(spark):
    pages = spark.createDataFrame(ODD, PAGES)
    r = warc.responses(pages, "2024-01-01T00:00:00Z").cache()
    everything = r.union(warc.derive(r)).cache()
    folder = work_folder(spark, "warc-test")
    files = warc.write(everything, folder, records_per_file=2)
    assert files.agg({"records": "sum"}).first()[0] == 15
    clean = lambda x: None if x is None else warc.clean(x)
    key = lambda x: (x.record_id, x.type, x.date, clean(x.target_uri), x.refers_to, tuple(map(tuple, x.headers)), x.content_type, bytes(x.payload), x.payload_digest, x.source_digest)
    assert sorted(map(key, warc.read(spark, folder).collect()), key=repr) == sorted(map(key, everything.collect()), key=repr)
    two = next(x for x in everything.collect() if x.type == "metadata" and b"outlink" in bytes(x.payload))
    assert b"outlink: /q?a=1&b=2\r\n" in bytes(two.payload) and b"source-content-type: text/html; charset=utf-8\r\n" in bytes(two.payload)
    none = work_folder(spark, "warc-none")
    warc.write(warc.derive(warc.responses(pages.limit(0), "d")), none)
    assert warc.read(spark, none).count() == 0


def test_broken_records():
    record = dict(record_id="<urn:uuid:x>", type="conversion", date="d", target_uri="u", refers_to=None, headers=[], content_type="text/plain", payload=b"abc", payload_digest="p", source_digest=None)
    raw = warc.to_bytes(record)
    assert {k: v for k, v in warc.from_bytes(raw).items() if v != record[k]} == {}
    for bad in (raw[:-6], raw.replace(b"abc", b"abd"), b"nothing"):
        with pytest.raises(ValueError):
            warc.from_bytes(bad)
    packed = warc.member(raw) * 3
    assert gzip.decompress(packed) == raw * 3 and list(warc.split_members([packed[:50], packed[50:]])) == [raw] * 3
    with pytest.raises(ValueError):
        list(warc.split_members([packed[:-20]]))
    assert html.unescape("&amp;") == "&"


def test_files_are_read_in_small_pieces():
    """What is left of a piece is copied once for each member in it, so a large piece costs its square."""
    data = [b"record %d " % i * 20 for i in range(3000)]
    raw = b"".join(warc.member(x) for x in data)
    pieces = [raw[i:i + warc.PIECE] for i in range(0, len(raw), warc.PIECE)]
    assert len(pieces) > 5 and list(warc.split_members(iter(pieces))) == data


def test_white_space_of_a_page_does_not_end_lines():
    page = "\n <p>a\r\n\x0b b\x85 c&amp\x0cd</p\n>e\x1c<br\t/>f &#10; g<!-- x\n\n --> h\xa0 "
    assert warc.plain_text(page) == "a b c& d\ne\nf\ng h"
