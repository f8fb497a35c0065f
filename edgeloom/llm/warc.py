"""WARC derivatives: responses become linked metadata and plain-text conversion records.

`derive` reads WARC/1.1 response records (one a row, as bytes) and yields, for each, a metadata record with facts of the response
and a conversion record with its plain text. Both refer to the response by WARC-Refers-To, WARC-Refers-To-Target-URI and
WARC-Refers-To-Date, keep its target URI, date and payload digest, carry digests of their own blocks, and have ids derived from the response's id, so reruns
agree. Source HTTP headers are kept in the metadata block as `http-header: name: value` lines.

Rows that are null, no WARC record, or of another type yield nothing. A response without a body, or whose content is no text, has a conversion
with an empty block. `read_files` reads WARC files, plain or compressed record by record (a file must fit into a task). `responses` builds such records from a table of pages; a null html is an empty body and a null url the empty URI.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH, small_batches

_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs (RFC 4122)
DATE = "2024-01-01T00:00:00Z"
_HIDDEN = re.compile(r"<!--|<(script|style|noscript|template|head|title)\b", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s{{0,64}}>", re.I) for name in ("script", "style", "noscript", "template", "head", "title")}
#: Tags are read up to MOST characters, so that unclosed ones cost no more than that each.
MOST = 4096
_BREAK = re.compile(rf"<(?:br|/?(?:p|div|li|ul|ol|tr|table|h[1-6]|section|article|nav|header|footer|main|blockquote|pre|title))\b[^>]{{0,{MOST}}}>", re.I)
_TAG = re.compile(r"<[^<>]*>")
_TITLE = re.compile(rf"<title\b[^>]{{0,{MOST}}}>", re.I)
_LINK = re.compile(rf"""<a\b[^<>]{{0,{MOST}}}?\bhref\s{{0,64}}=\s{{0,64}}["']?([^"'\s>]+)""", re.I)
_LENGTH = re.compile(rb"\r\n[Cc]ontent-[Ll]ength:[ \t]*([0-9]+)")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-cased name, block) of one record; folded header lines join."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not gap:
        raise ValueError("no WARC record")
    found: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and last:
            found[last] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            found[last] = value.strip()
    size = int(found.get("content-length", "0"))
    if len(rest) < size:
        raise ValueError("a block is shorter than its length")
    return found, rest[:size]


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, body) of an HTTP response."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/"):
        return "", [], block
    lines = head.decode("latin-1").split("\r\n")
    pairs = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
    return lines[0], pairs, body if gap else b""


def _shown(text: str) -> str:
    """text with a space for each comment, script and the like, in one forward scan; what is never closed stays."""
    made, at, look, open_ = [], 0, 0, set()
    while found := _HIDDEN.search(text, look):
        look, kind = found.end(), (found[1] or "-").lower()
        if kind in open_:
            continue
        if kind == "-":
            end = text.find("-->", look) + 3
        else:
            tag = text.find(">", look) + 1
            closed = _CLOSE[kind].search(text, tag) if tag else None
            end = closed.end() if closed else 2
        if end <= 2:
            open_.add(kind)  # nothing closes it from here on
            continue
        made += [text[at : found.start()], " "]
        at = look = end
    return "".join([*made, text[at:]])


def plain(text: str) -> str:
    """Readable text of HTML: no scripts, styles or comments; block elements end lines; entities resolved; spaces of a line joined."""
    text = _TAG.sub("", _BREAK.sub("\n", _shown(text)))
    lines = (" ".join(x.split()) for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def title(markup: str) -> str:
    """Text of the first title that is closed; empty without one."""
    begin = _TITLE.search(markup)
    end = _CLOSE["title"].search(markup, begin.end()) if begin else None
    return " ".join(html.unescape(markup[begin.end() : end.start()]).split()) if end else ""


def split_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of a WARC file, plain or compressed record by record; offsets count in the file. A damaged rest yields nothing."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            try:
                record_ = member.decompress(data[at:] if at == 0 else memoryview(data)[at:])
            except zlib.error:
                return
            if not member.eof:
                return
            yield at, record_
            at = len(data) - len(member.unused_data)
            continue
        head = data.find(b"\r\n\r\n", at)
        size = _LENGTH.search(data, at, head) if head >= 0 else None
        if not data.startswith(b"WARC/", at) or size is None or head + 4 + int(size[1]) > len(data):
            return
        end = head + 4 + int(size[1])
        yield at, data[at:end] + b"\r\n\r\n"
        at = end
        while data[at : at + 2] == b"\r\n":
            at += 2


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, warc): the records of WARC files, one file a task at a time; page_id is the file's path, # and the offset."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                rows: list[tuple[str, bytes]] = []
                held = 0
                for at, whole in split_records(bytes(data)):
                    rows.append((f"{name}#{at}", whole))
                    held += len(whole)
                    if held >= BATCH:
                        yield pd.DataFrame(rows, columns=["page_id", "warc"])
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=["page_id", "warc"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "page_id string, warc binary")


def _decoded(body: bytes, kind: str) -> str:
    charset = _CHARSET.search(kind)
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def response(page: object, url: str, text: str) -> bytes:
    body = text.encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    identity = uuid.uuid5(_NAMES, f"{page}:{url}:{hashlib.sha256(body).hexdigest()}")
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{identity}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block))]
    return record(headers, block)


def derivatives(data: bytes) -> list[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, record) of the metadata and the conversion record of a response; none for other records."""
    source, block = parse(data)
    if source.get("warc-type") != "response":
        return []
    status, http, body = split_http(block)
    kind = next((v for k, v in http if k.lower() == "content-type"), "text/html")
    markup = _decoded(body, kind) if kind.lower().startswith(("text/", "application/xhtml")) else ""
    text = plain(markup) if "html" in kind.lower() else markup
    identity = source.get("warc-record-id", "").strip("<>")
    names = [uuid.uuid5(_NAMES, f"{identity}#{role}") for role in ("metadata", "conversion")]
    facts = [("status", status), *(("http-header", f"{k}: {v}") for k, v in http), ("title", title(markup)), ("outlinks", str(len(_LINK.findall(markup)))), ("plain-text-length", str(len(text))), ("conversion", f"<urn:uuid:{names[1]}>")]
    # the response's own digest is kept where it has one, also if it differs from the body
    payload = source.get("warc-payload-digest") or digest(body)
    common = [("WARC-Date", source.get("warc-date", DATE)), ("WARC-Target-URI", source.get("warc-target-uri", "")), ("WARC-Refers-To", f"<{identity}>"), ("WARC-Refers-To-Target-URI", source.get("warc-target-uri", "")), ("WARC-Refers-To-Date", source.get("warc-date", DATE))]
    made = []
    for role, name, content, out in (("metadata", names[0], "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in facts).encode()), ("conversion", names[1], "text/plain; charset=utf-8", text.encode())):
        headers = [("WARC-Type", role), ("WARC-Record-ID", f"<urn:uuid:{name}>"), *common, ("Content-Type", content), ("WARC-Source-Payload-Digest", payload), ("WARC-Block-Digest", digest(out))]
        made.append((dict(headers), out, record(headers, out)))
    return made


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, warc): one response record for each page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"page_id": frame["page_id"], "warc": [response(*row) for row in zip(frame["page_id"], frame["url"], frame["html"], strict=True)]})

    slim = small_batches(pages).select("page_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("url", "html")))
    return slim.mapInPandas(run, f"page_id {dict(pages.dtypes)['page_id']}, warc binary")


def derive(records: DataFrame) -> DataFrame:
    """(page_id, record_type, record_id, refers_to, target_uri, payload_digest, block_digest, content_type, block, record) of rows (page_id, warc)."""
    names = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Source-Payload-Digest", "block_digest": "WARC-Block-Digest", "content_type": "Content-Type"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, held = [], 0
            for page, data in zip(frame["page_id"], frame["warc"], strict=True):
                try:
                    made = derivatives(bytes(data)) if data is not None else []
                except ValueError:
                    made = []
                rows += [(page, *(headers[h] for h in names.values()), block, whole) for headers, block, whole in made]
                held += sum(len(block) + len(whole) for _, block, whole in made)
                if held >= BATCH:
                    yield pd.DataFrame(rows, columns=["page_id", *names, "block", "record"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["page_id", *names, "block", "record"])

    fields = ", ".join(f"{c} string" for c in names)
    return small_batches(records).select("page_id", "warc").mapInPandas(run, f"page_id {dict(records.dtypes)['page_id']}, {fields}, block binary, record binary")
