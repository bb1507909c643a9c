"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

Each response record of a web archive gives a ``metadata`` record with the fields of the source (its
WARC headers, its HTTP status and headers, its digests, the links it holds) and, if its payload is text, a
``conversion`` record with its plain text. Both refer to the response by its id, uri and
date and to each other by ``WARC-Concurrent-To``. Chunked transfer and gzip or deflate coding are
undone first; the payload's digest is of the bytes without transfer coding. HTML is read as parser
events, text of other types is kept as it is, and images or other bytes have no conversion. Ids are name-based, so a rerun, also one after a
lost executor, writes the same records. Records are whole WARC/1.1 records as bytes; written one
after another they are an archive.

Every record is worked on alone where it lies: no shuffle, no state. Records of other types, and
rows that are null or no readable record, have no derivatives. A response without an id gets one
from its bytes. Repeated rows give repeated derivatives with the same ids; pages that share an id and
url but not their bytes have ids of their own. Parsing is linear in the payload, which is taken whole
however long. Columns asked for are carried along; others are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
EPOCH = "1970-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:derivatives")

_FIELDS = ["warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_digest", "record"]
_KINDS = {"content_length": "bigint", "record": "binary"}
_RESULT = "array<struct<" + ", ".join(f"{k}: {_KINDS.get(k, 'string')}" for k in _FIELDS) + ">>"
_ARROW = pa.list_(pa.struct([(k, {"bigint": pa.int64(), "binary": pa.binary()}.get(_KINDS.get(k, ""), pa.string())) for k in _FIELDS]))

# fixed values: elements of HTML
_HIDDEN = {"script", "style", "noscript", "template"}
_BLOCKS = set("address article aside blockquote body br center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_PIECE = 1 << 16
_CHARSET = re.compile(r"charset=\"?([\w-]+)", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record's bytes; its length is added to the headers."""
    lines = [VERSION, *(f"{k}: {_one_line(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def _one_line(value: str) -> str:
    return " ".join(value.splitlines())


def _fields(head: str) -> list[tuple[str, str]]:
    """Named fields; a line that begins with white space goes on with the field before."""
    out: list[tuple[str, str]] = []
    for line in head.split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def parse(record: bytes) -> tuple[list[tuple[str, str]], bytes] | None:
    """Headers and block of a record, or None if it is none."""
    head, end, rest = record.partition(_END)
    first, _, fields = head.decode("utf-8", "replace").partition("\r\n")
    if not end or not first.startswith("WARC/"):
        return None
    headers = _fields(fields)
    size = dict((k.lower(), v) for k, v in headers).get("content-length", "")
    if not size.isascii() or not size.isdigit() or int(size) > len(rest):
        return None
    return headers, rest[:int(size)]


class _Page(HTMLParser):
    """The text that a page shows, block by block, and where its links lead."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden: list[str] = []
        self.parts: list[str] = []
        self.lines: list[str] = []
        self.links: list[str] = []

    def end_line(self) -> None:
        line = " ".join("".join(self.parts).split())
        if line:
            self.lines.append(line)
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _HIDDEN:
            self.hidden.append(tag)
            self.parts.append(" ")
        elif tag in _BLOCKS:
            self.end_line()
        if tag == "a" and not self.hidden:
            to = next((v for k, v in attrs if k == "href"), None)
            if to is not None:
                self.links.append(_one_line(to))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in _HIDDEN and self.hidden:
            self.hidden.pop()

    def handle_endtag(self, tag: str) -> None:
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
        elif tag in _BLOCKS:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)

    def unknown_decl(self, data: str) -> None:
        pass


def read_page(html: str) -> tuple[str, list[str]]:
    """All text that a page shows, a line for each block, and its links."""
    page = _Page()
    html = re.sub(r"<!\[(?!CDATA\[)", "&lt;![", html)
    for at in range(0, len(html), _PIECE):
        page.feed(html[at:at + _PIECE])
    page.close()
    page.end_line()
    return "\n".join(page.lines), page.links


def plain_text(html: str) -> str:
    return read_page(html)[0]


def links(html: str) -> list[str]:
    return read_page(html)[1]


def unchunked(body: bytes) -> bytes:
    """A body without its chunked transfer coding; one that breaks off ends there, one that was never
    chunked stays."""
    out, at = [], 0
    while at < len(body):
        end = body.find(b"\r\n", at, at + 1024)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return b"".join(out) if out else body
        n = int(size, 16)
        if not n:
            break
        out.append(body[end + 2:end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def uncoded(body: bytes, coding: str) -> bytes | None:
    """A body without gzip or deflate, as far as it can be read; None for a coding that is not known."""
    for name in reversed([x.strip().lower() for x in coding.split(",") if x.strip()]):
        if name == "identity":
            continue
        if name not in ("gzip", "x-gzip", "deflate"):
            return None
        for bits in ((47,) if name != "deflate" else (15, -15)):  # deflate comes with and without its header
            reader, out = zlib.decompressobj(bits), []
            try:
                out.append(reader.decompress(body))
                while reader.eof and bits == 47 and reader.unused_data[:2] == b"\x1f\x8b":  # members one after another
                    rest = reader.unused_data
                    reader = zlib.decompressobj(bits)
                    out.append(reader.decompress(rest))
                out.append(reader.flush())
            except zlib.error:
                if not out:
                    continue
            body = b"".join(out)
            break
        else:
            return None
    return body


def _text_kind(kind: str, payload: bytes) -> str | None:
    """html, plain, or None for a payload that is no text."""
    name = kind.partition(";")[0].strip().lower()
    if name in ("text/html", "application/xhtml+xml"):
        return "html"
    if name.startswith("text/") or name in ("application/json", "application/xml", "application/javascript") or name.endswith(("+json", "+xml")):
        return "plain"
    if name:
        return None
    if b"\0" in payload[:1024]:
        return None
    return "html" if payload.lstrip()[:1] == b"<" else "plain"


def _decoded(payload: bytes, kind: str, html: bool) -> str:
    """By the charset that the header names, else the page's own, else UTF-8."""
    found = _CHARSET.search(kind) or (_CHARSET.search(payload[:1024].decode("latin-1")) if html else None)
    try:
        return payload.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(record: bytes | None) -> list[dict]:
    """The metadata record of a response and, if it is text, the conversion record."""
    parsed = parse(record) if record else None
    if parsed is None:
        return []
    headers, block = parsed
    h = {k.lower(): v for k, v in headers}
    if h.get("warc-type", "").lower() != "response":
        return []
    http, end, payload = block.partition(_END)
    if not end:
        http, payload = b"", block
    status, _, fields = http.decode("utf-8", "replace").partition("\r\n")
    http_fields = _fields(fields)
    of_http = {k.lower(): v for k, v in http_fields}
    if "chunked" in of_http.get("transfer-encoding", "").lower():
        payload = unchunked(payload)
    kind, content = of_http.get("content-type", ""), uncoded(payload, of_http.get("content-encoding", ""))
    shown = None if content is None else _text_kind(kind, content)
    text, outlinks = None, []
    if shown:
        text = _decoded(content, kind, shown == "html")
        if shown == "html":
            text, outlinks = read_page(text)
    source = h.get("warc-record-id") or f"<urn:uuid:{uuid.uuid5(_NAMES, hashlib.sha256(record).hexdigest())}>"
    uri, date = h.get("warc-target-uri", ""), h.get("warc-date", EPOCH)
    payload_digest = h.get("warc-payload-digest") or digest(payload)
    about = [(f"source-{k}", v) for k, v in headers] + [("source-payload-digest", payload_digest), ("http-status", status)] + [(f"http-{k}", v) for k, v in http_fields]
    about += [("outlink", x) for x in outlinks]
    bodies = {"metadata": ("application/warc-fields", "".join(f"{k}: {_one_line(v)}\r\n" for k, v in about).encode())}
    if text is not None:
        bodies["conversion"] = ("text/plain; charset=utf-8", text.encode("utf-8", "replace"))
    ids = {k: f"<urn:uuid:{uuid.uuid5(_NAMES, f'{k} {source}')}>" for k in bodies}
    out = []
    for name, (content_type, body) in bodies.items():
        twin = next((ids[k] for k in bodies if k != name), None)
        head = [("WARC-Type", name), ("WARC-Record-ID", ids[name]), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
        head += [("WARC-Concurrent-To", twin)] * (twin is not None) + [("WARC-Block-Digest", digest(body)), ("Content-Type", content_type)]
        out.append({"warc_type": name, "record_id": ids[name], "refers_to": source, "concurrent_to": twin, "target_uri": uri, "warc_date": date, "content_type": content_type, "content_length": len(body), "block_digest": digest(body), "source_digest": payload_digest, "record": build(head, body)})
    return out


def _each(function, result: str, kind: pa.DataType):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([function(x.as_py()) for x in batch], kind)

    return F.arrow_udf(run, result).asNondeterministic()


def response(page: dict | None) -> bytes | None:
    """The response record of a fetched page: url, html, and date if it has one."""
    if page is None or page["html"] is None:
        return None
    payload = page["html"].encode("utf-8", "replace")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = page["url"] or ""
    name = uuid.uuid5(_NAMES, f"response {page['page_id']} {uri} {digest(payload)}")
    head = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", EPOCH), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(http + payload)), ("Content-Type", "application/http; msgtype=response")]
    return build(head, http + payload)


def responses(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as an archive's response records: page_id, record."""
    return pages.select("page_id", _each(response, "binary", pa.binary())(F.struct("page_id", "url", "html")).alias("record"))


def derivatives(records: DataFrame, *carried: str) -> DataFrame:
    """records(record) -> the carried columns, and a row for each derived record."""
    made = records.select(*carried, _each(derive, _RESULT, _ARROW)("record").alias("made"))
    return made.select(*carried, F.inline("made"))


def archive_of(pages: DataFrame) -> DataFrame:
    """Response records of pages and the derivatives of each: page_id, warc_type, ..., record."""
    return derivatives(responses(pages), "page_id")
