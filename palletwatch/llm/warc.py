"""Derived web archive records: metadata and plain text for each response.

Each response record gives a metadata record and, where its payload is text, a conversion record. Both name
the response they refer to, keep its target and date, and carry their own digest; the metadata keeps the
response's HTTP status and headers and its digests. Bodies are read as they were sent: chunks are put together, gzip and
deflate undone, and the characters read as the header, a byte order mark or the page says.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palletwatch.llm.blocks import pieces
from palletwatch.llm.html_blocks import blocks
from palletwatch.llm.rows import SLICE_BYTES

TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
LINK = re.compile(r"<a\s[^<>]*\bhref\s*=", re.I)
CHARSET = re.compile(r"charset\s*=\s*[\"']?([^\s\"';,>]+)", re.I)
PAGE_CHARSET = re.compile(r"<meta\b[^<>]*\bcharset\s*=[^<>]*>", re.I)
DERIVED = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, " \
    "block_digest string, content_length long, header string, block string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, refers_to: str) -> str:
    """A name-based id, so that a task that runs again gives the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {refers_to}')}>"


def split_message(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP message; lenient about line ends."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark:
        head, mark, payload = block.partition(b"\n\n")
    if not head.startswith(b"HTTP/"):
        return "", [], block
    lines = re.sub(r"\n[ \t]+", " ", head.decode("utf-8", "replace").replace("\r\n", "\n")).split("\n")  # folded lines go on
    fields = [line.partition(":") for line in lines[1:] if ":" in line]
    return lines[0], [(name.strip(), value.strip()) for name, _, value in fields], payload


class Unreadable(Exception):
    """A body that cannot be read, and why."""


def dechunked(body: bytes) -> bytes:
    """A body sent in chunks, put together; extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.find(b"\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            raise Unreadable("broken chunks")
        n, at = int(size, 16), end + 1
        if not n:
            return b"".join(parts)
        if at + n > len(body):
            raise Unreadable("broken chunks")
        parts.append(body[at : at + n])
        at += n
        at += 2 if body[at : at + 2] == b"\r\n" else 1 if body[at : at + 1] == b"\n" else 0


def inflated(body: bytes, kind: str) -> bytes:
    """A body without its content coding."""
    if kind in ("", "identity"):
        return body
    if kind not in ("gzip", "x-gzip", "deflate"):
        raise Unreadable(f"content coding {kind}")
    if not body:
        return body
    for window in (31,) if "gzip" in kind else (15, -15):  # deflate comes with and without its wrapper
        out, rest = [], body
        try:
            while rest:  # gzip members may follow one another
                undo = zlib.decompressobj(window)
                out.append(undo.decompress(rest) + undo.flush())
                if not undo.eof:
                    raise Unreadable(f"broken {kind}")
                rest = undo.unused_data if "gzip" in kind else b""
            return b"".join(out)
        except zlib.error:
            continue
    raise Unreadable(f"broken {kind}")


def entity(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """The body behind transfer and content codings, undone in the order opposite to that of their names."""

    def named(header: str) -> list[str]:
        return [part.strip().lower() for n, v in headers if n.lower() == header for part in v.split(",") if part.strip()]

    body = payload
    for kind in reversed(named("transfer-encoding")):
        body = dechunked(body) if kind == "chunked" else inflated(body, kind)
    for kind in reversed(named("content-encoding")):
        body = inflated(body, kind)
    return body


def decoded(body: bytes, kind: str) -> str:
    """Text in the character set of a byte order mark, the content type, or a page's own tag; UTF-8 where none is named."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    named = CHARSET.search(kind)
    if not named and "html" in kind:
        named = CHARSET.search(" ".join(PAGE_CHARSET.findall(body[:4096].decode("latin-1"))))
    name = named[1].lower() if named else "utf-8"
    try:
        known = codecs.lookup({"iso-8859-1": "cp1252", "latin1": "cp1252", "us-ascii": "cp1252"}.get(name, name))
        return body.decode(known.name, "replace")
    except (LookupError, UnicodeError, ValueError) as error:
        raise Unreadable(f"character set {name}") from error


def plain_text(page: str, kind: str) -> str | None:
    """All text blocks of a page, or a plain text as it is; None for other content."""
    if "html" in kind:
        return "\n".join(block.text for block in blocks(page))
    return page if kind.startswith("text/") else None


def derive(response_id: str, target: str, date: str, block: bytes) -> Iterator[tuple]:
    """The derived records of one response, as rows of ``DERIVED``."""
    status, headers, payload = split_message(block)
    kind = next((v for n, v in headers if n.lower() == "content-type"), "text/html").lower()
    page, text, problem = "", None, []
    if "html" in kind or kind.startswith("text/"):
        try:
            page = decoded(entity(headers, payload), kind)
            text = plain_text(page, kind)
        except Unreadable as error:
            problem = [("unreadable", str(error))]
    if "html" not in kind:
        page = ""
    title = TITLE.search(page)
    facts = [
        ("source-block-digest", digest(block)), ("source-payload-digest", digest(payload)),
        ("source-length", str(len(block))), ("http-status", status), *((f"http-header-{n.lower()}", v) for n, v in headers),
        ("title", " ".join(html.unescape(title[1]).split()) if title else ""), ("outlinks", str(len(LINK.findall(page)))), *problem,
    ]
    made = [("metadata", "application/warc-fields", "".join(f"{n}: {v}\r\n" for n, v in facts))]
    if text is not None:
        made.append(("conversion", "text/plain", text))
    for record_type, content_type, content in made:
        data = content.encode()
        own = record_id(record_type, response_id)
        head = {
            "WARC-Type": record_type, "WARC-Record-ID": own, "WARC-Refers-To": response_id, "WARC-Target-URI": target,
            "WARC-Date": date, "WARC-Block-Digest": digest(data), "Content-Type": content_type, "Content-Length": str(len(data)),
        }
        header = "WARC/1.0\r\n" + "".join(f"{n}: {v}\r\n" for n, v in head.items() if v)
        yield record_type, own, response_id, target, date, content_type, digest(data), len(data), header, content


def derived_records(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One or two rows of ``DERIVED`` for each response, and the columns named in ``keep``, but for those that ``DERIVED`` has itself.

    ``responses`` has ``record_id``, ``target_uri`` and ``date`` (strings) and ``block`` (the HTTP message, binary or
    string). A null block counts as empty, a null target or date as missing: its header line is left out. Without a
    record id a response gets one from its target and content. Content without a type counts as HTML. A body whose coding or
    character set is unknown or broken gives a metadata record only, which says so. No shuffle.
    """
    taken = [part.split()[0] for part in DERIVED.split(", ")]
    keep = tuple(dict.fromkeys(name for name in keep if name not in taken))
    fields = [responses.schema[name] for name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [DERIVED])
    names = [part.split()[0] for part in DERIVED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = [batch[name].to_pylist() for name in ("record_id", "target_uri", "date")]
            for lo, hi, messages in pieces(batch["block"], SLICE_BYTES):
                rows, source = [], []
                for i in range(lo, hi):
                    block = messages[i - lo] or b""
                    target, date = facts[1][i] or "", facts[2][i] or ""
                    own = facts[0][i] or record_id("response", f"{target} {digest(block)}")
                    new = list(derive(own, target, date, block))
                    rows += new
                    source += [i] * len(new)
                kept = [batch[name].take(pa.array(source, pa.int64())) for name in keep]
                kinds = [pa.int64() if name == "content_length" else pa.string() for name in names]
                made = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(kept + made, [*keep, *names])

    needed = dict.fromkeys([*keep, "record_id", "target_uri", "date", "block"])
    return responses.select(*needed).mapInArrow(run, schema)


def page_responses(pages: DataFrame, date: str) -> DataFrame:
    """Response records of crawled pages: the page behind a status line and headers, with an id from its number and address."""
    name = F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), "url").cast("binary"))
    parts = [F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    page = F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(page).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(
        "page_id", F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.concat(head, page).alias("block"),
    )
