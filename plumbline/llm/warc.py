"""WARC derivatives: metadata and plain-text conversion records for response records.

A record is a row: record_id, type, date, target_uri, refers_to, headers (of the HTTP
response or of the WARC record, an array of name and value), content_type, payload,
payload_digest. ``write`` puts records into gzip files with one member each, ``read``
parses such files again; both work partition by partition, in any file system that
Spark (reading) and pyarrow (writing) know.

From each response come two records that refer to it (WARC-Refers-To): the metadata
record has title, language, character set, outgoing links and the source's headers;
the conversion record has the plain text. All records of one capture share target URI
and date; the derivatives carry the source's payload digest besides their own.

Defined results: a response without payload gives an empty text and no links; a null
URI or header is left out of the record; ids are name-based (a hash of the record's type
and what it refers to, and of the payload), so repeated runs and repeated tasks write
the same ids, and repeated rows give repeated records; an empty table gives no files.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.token_index import place

SCHEMA = (
    "record_id string, type string, date string, target_uri string, refers_to string,"
    " headers array<struct<name:string,value:string>>, content_type string, payload binary, payload_digest string, source_digest string")
NAMES = [c.split()[0] for c in re.sub(r"<.*?>+", "", SCHEMA).split(", ")]
ARROW = pa.schema([
    *[(n, pa.string()) for n in ("record_id", "type", "date", "target_uri", "refers_to")],
    ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("content_type", pa.string()), ("payload", pa.binary()),
    ("payload_digest", pa.string()), ("source_digest", pa.string())])
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace
#: Elements whose content is no text (up to the first closing tag, or nested), of them those that run
#: to the end of the page without one and those that "/>" closes, and elements that end a line. A head is as silent as
#: the elements in it: its end may be left out.
RAW, NESTED, OPEN_ENDED, SELF_CLOSING = "script style title", "template noscript svg math iframe object", ("script", "style"), ("svg", "math", "iframe", "object")
BREAKS = "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td th thead tr ul"

SILENT = "|".join(f"{RAW} {NESTED}".split())
TOKENS = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<silent>{SILENT})(?=[\s/>])(?P<rest>[^<>]*)>|</?(?P<tag>[a-zA-Z][a-zA-Z0-9]*)\b[^<>]*>|<[!?][^<>]*>", re.DOTALL | re.IGNORECASE)
PAIRS = re.compile(rf"<(?P<close>/?)(?P<name>{SILENT})(?=[\s/>])(?P<rest>[^<>]*)>", re.IGNORECASE)
BREAKING = frozenset(BREAKS.split())
# Nothing reaches over the next "<": time stays linear in pages full of open tags.
TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.IGNORECASE)
LANGUAGE = re.compile(r"""<html\b[^<>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", re.IGNORECASE)
CHARSET = re.compile(r"""<meta\b[^<>]*?\bcharset\s*=\s*["']?([A-Za-z0-9_-]+)""", re.IGNORECASE)
META_CHARSET = re.compile(CHARSET.pattern.encode(), re.IGNORECASE)
HTTP_CHARSET = re.compile(r"""\bcharset\s*=\s*["']?([A-Za-z0-9_.:-]+)""", re.IGNORECASE)
#: Byte order marks, Python's codecs that are no character sets of pages, and what browsers take instead of some.
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
NO_CHARSETS = frozenset("utf-7 utf7 utf_7 idna punycode unicode_escape unicode-escape raw_unicode_escape raw-unicode-escape undefined".split())
AS_BROWSERS = {"iso8859-1": "cp1252", "ascii": "cp1252", "gb2312": "gb18030", "gbk": "gb18030", "shift_jis": "cp932", "euc_kr": "cp949", "iso8859-9": "cp1254", "tis-620": "cp874", "utf-16": "utf-16-le"}
LINK = re.compile(r"""<a\b[^<>]*?\bhref\s*=\s*(?:"([^"<>]*)"|'([^'<>]*)'|([^\s<>"']+))""", re.IGNORECASE)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def name_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(31).join(parts))}>"


def self_closed(name: str, rest: str) -> bool:
    return name in SELF_CLOSING and rest.endswith("/")


class Silence:
    """Where the silent elements of a page end, found in one pass."""

    def __init__(self, page: str):
        self.size, self.page = len(page), page
        self.closed: dict[int, int] = {}
        self.starts: dict[str, list[int]] = {n: [] for n in RAW.split()}
        self.ends: dict[int, int] = {}
        is_open: dict[str, list[int]] = {n: [] for n in NESTED.split()}
        for m in PAIRS.finditer(page):
            name = m["name"].lower()
            if name in self.starts:
                if m["close"]:
                    self.starts[name].append(m.start())
                    self.ends[m.start()] = m.end()
            elif not m["close"]:
                if not self_closed(name, m["rest"]):
                    is_open[name].append(m.start())
            elif is_open[name]:
                self.closed[is_open[name].pop()] = m.end()

    def end(self, m: re.Match) -> int:
        """Where the text goes on after an opening tag."""
        name = m["silent"].lower()
        if name not in self.starts:
            return self.closed.get(m.start(), m.end())
        i = bisect_left(self.starts[name], m.end())
        if i < len(self.starts[name]):
            return self.ends[self.starts[name][i]]
        if name in OPEN_ENDED:
            return self.size
        at = self.page.find("<", m.end())  # an open title, as TITLE reads it
        return self.size if at < 0 else at


def plain_text(page: str) -> str:
    """Text of a page: silent elements and comments go, block elements end lines, white
    space is folded, character references are resolved, empty lines go. Of a silent
    element that is not closed the tag goes, unless it is a script or a style."""
    page = page.replace("\n", " ")  # other white space is folded line by line, below
    out, at, silence = [], 0, None
    while m := TOKENS.search(page, at):
        out.append(page[at:m.start()])
        at = m.end()
        if m["silent"]:
            silence = silence or Silence(page)
            at = silence.end(m)
            out.append(" ")
        elif not m["tag"]:
            out.append(" ")
        elif m["tag"].lower() in BREAKING:
            out.append("\n")
    out.append(page[at:])
    lines = (" ".join(x.split()) for x in html.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x)


@lru_cache(1000)
def codec(label: str) -> str | None:
    """Python's name of a stated character set, as browsers read it; None if there is none."""
    label = label.strip().lower()
    if label in NO_CHARSETS:
        return None
    try:
        name = codecs.lookup(label).name
        b"".decode(name, "replace")
    except (LookupError, ValueError):
        return None
    return AS_BROWSERS.get(name, name)


def decoded(payload: bytes, headers: list[dict] | None) -> str:
    """A page by its byte order mark, the charset of its HTTP header, that of its first
    meta element, or else as UTF-8. What has no meaning there becomes U+FFFD."""
    for mark, name in MARKS:
        if payload.startswith(mark):
            return payload[len(mark):].decode(name, "replace")
    for h in headers or []:
        if (h["name"] or "").lower() == "content-type" and (m := HTTP_CHARSET.search(h["value"] or "")) and (name := codec(m[1])):
            return payload.decode(name, "replace")
    if (m := META_CHARSET.search(payload)) and (name := codec(m[1].decode())):
        return payload.decode("utf-8" if name.startswith("utf-16") or name.startswith("utf-32") else name, "replace")
    return payload.decode("utf-8", "replace")


def links(page: str) -> list[str]:
    return [html.unescape(next(x for x in m.groups() if x is not None)).strip() for m in LINK.finditer(page)]


# -- derivatives --------------------------------------------------------------------------------------------------------

def responses(pages: DataFrame, date: str) -> DataFrame:
    """Response records for pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, url, page in zip(*(b.column(c) for c in ("page_id", "url", "html")), strict=True):
                body = (page.as_py() or "").encode("utf-8", "surrogatepass")
                d = digest(body)
                http = [{"name": "Content-Type", "value": "text/html; charset=utf-8"}, {"name": "Content-Length", "value": str(len(body))}]
                rows.append((name_id("response", str(i.as_py()), url.as_py() or "", d), "response", date, url.as_py(), None, http, "application/http; msgtype=response", body, d, d))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)] if rows else [pa.array([], f.type) for f in ARROW], schema=ARROW)

    own = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, SCHEMA)


def fields(pairs: list[tuple[str, str | None]]) -> bytes:
    return "".join(f"{k}: {clean(v)}\r\n" for k, v in pairs if v is not None).encode("utf-8", "surrogatepass")


def clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value) if "\n" in value or "\r" in value else value


def derive(records: DataFrame) -> DataFrame:
    """The metadata and the conversion record of each response; other records give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                page = decoded(r["payload"] or b"", r["headers"])
                title, language, charset = (m[1] if (m := p.search(page)) else None for p in (TITLE, LANGUAGE, CHARSET))
                title = None if title is None else re.sub(r"\s+", " ", html.unescape(title)).strip()
                about = fields([("title", title), ("language", language), ("charset", charset), *[("source-" + h["name"].lower(), h["value"]) for h in r["headers"] or []],
                                *[("outlink", x) for x in links(page)]])
                for kind, mime, body in (("metadata", "application/warc-fields", about), ("conversion", "text/plain", plain_text(page).encode("utf-8", "surrogatepass"))):
                    d = digest(body)
                    rows.append((name_id(kind, r["record_id"] or "", d), kind, r["date"], r["target_uri"], r["record_id"], r["headers"], mime, body, d, r["payload_digest"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)] if rows else [pa.array([], f.type) for f in ARROW], schema=ARROW)

    return records.where("type = 'response'").select(*NAMES).mapInArrow(run, SCHEMA)


# -- files --------------------------------------------------------------------------------------------------------------

REASONS = {"response": "HTTP/1.1 200 OK\r\n"}


def to_bytes(r: dict) -> bytes:
    block = r["payload"] or b""
    if r["type"] in REASONS:
        block = REASONS[r["type"]].encode() + fields([(h["name"], h["value"]) for h in r["headers"] or []]) + b"\r\n" + block
    extra = [] if r["type"] in REASONS else [("X-Source-" + h["name"], h["value"]) for h in r["headers"] or []]
    head = fields([
        ("WARC-Type", r["type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Refers-To", r["refers_to"]),
        ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", r["payload_digest"]), ("X-Source-Payload-Digest", r["source_digest"]),
        ("Content-Type", r["content_type"]), *extra, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parse_fields(lines: list[bytes]) -> list[tuple[str, str]]:
    return [(k.decode(), v.decode("utf-8", "surrogatepass").strip()) for k, _, v in (x.partition(b":") for x in lines if x)]


def from_bytes(raw: bytes) -> dict:
    """One record; raises ValueError where version, length or block digest are wrong."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    own = parse_fields(lines)
    f = dict(own)
    block = rest[:int(f.get("Content-Length", -1))]
    if not mark or not version.startswith(b"WARC/1.") or len(block) != int(f["Content-Length"]) or digest(block) != f.get("WARC-Block-Digest", digest(block)):
        raise ValueError("not a whole WARC record")
    headers = [{"name": k[9:], "value": v} for k, v in own if k.startswith("X-Source-") and k != "X-Source-Payload-Digest"]
    if f["WARC-Type"] in REASONS:
        http, _, block = block.partition(b"\r\n\r\n")
        headers = [{"name": k, "value": v} for k, v in parse_fields(http.split(b"\r\n")[1:])]
    return {
        "record_id": f.get("WARC-Record-ID"), "type": f.get("WARC-Type"), "date": f.get("WARC-Date"), "target_uri": f.get("WARC-Target-URI"), "refers_to": f.get("WARC-Refers-To"),
        "headers": headers, "content_type": f.get("Content-Type"), "payload": block, "payload_digest": f.get("WARC-Payload-Digest"), "source_digest": f.get("X-Source-Payload-Digest")}


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(records: DataFrame, folder: str, records_per_file: int = 50_000) -> DataFrame:
    """Write ``*.warc.gz`` files; returns the table of them (file, records, bytes), which
    is what a reader should go by: files of tasks that were lost are not in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, out, name, n, size = place(folder), None, "", 0, 0

        def done():
            return pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    name, n, size = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = where[0].open_output_stream(f"{where[1]}/data/{name}", compression=None)
                packed = member(to_bytes(r))
                out.write(packed)
                n, size = n + 1, size + len(packed)
                if n == records_per_file:
                    out.close()
                    out = None
                    yield done()
        if out is not None:
            out.close()
            yield done()

    where = place(folder)
    where[0].create_dir(f"{where[1]}/data")
    records.select(*NAMES).mapInArrow(run, "file string, records bigint, bytes bigint").write.parquet(f"{folder}/files")
    return records.sparkSession.read.parquet(f"{folder}/files")


#: Bytes read at a time: what is left of a piece is copied once for each member in it.
PIECE = 1 << 14


def split_members(raw) -> Iterator[bytes]:
    """The members of a gzip stream, from an iterator of its pieces: one member in memory."""
    z, held = zlib.decompressobj(31), []
    for piece in raw:
        while piece:
            held.append(z.decompress(piece))
            piece = z.unused_data
            if z.eof:
                yield b"".join(held)
                z, held = zlib.decompressobj(31), []
    if any(held):
        raise ValueError("a gzip member is cut off")


def read(spark: SparkSession, folder: str, batch_bytes: int = 1 << 23) -> DataFrame:
    """The records of the files that ``write`` reports in ``folder``, file by file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = place(folder)
        for b in batches:
            for file in b.column("file").to_pylist():
                rows, size = [], 0
                with where[0].open_input_stream(f"{where[1]}/data/{file}", compression=None) as f:
                    for raw in split_members(iter(lambda f=f: f.read(PIECE), b"")):
                        rows.append(from_bytes(raw))
                        size += len(raw)
                        if size > batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    files = spark.read.parquet(f"{folder}/files")
    return files.repartition(F.col("file")).select("file").mapInArrow(run, SCHEMA)
