"""Derivatives of web archive records: each response gives a metadata record and a plain-text conversion record.

Both refer to the response by its id and keep its target, date, source headers and digests. Ids of derived records follow from
the response's id, so a task that runs again writes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import html_extract

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the UUID namespace of URLs
_LINK = re.compile(r"<(a|link|img|script|iframe|area|form)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
_TARGET = re.compile(r"\b(href|src|action)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_META = re.compile(r"<meta\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
_ATTR = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_QUIET = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def derived_id(of: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{of} {kind}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _headers(lines: list[str]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:  # folded
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def parse(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of one record; ValueError if it is none."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("no record")
    headers = _headers(lines[1:])
    length = int(dict((k.lower(), v) for k, v in headers).get("content-length", "-1"))
    if length < 0 or length > len(rest):
        raise ValueError("wrong length")
    return headers, rest[:length]


#: Bytes that are inflated at a time.
_STEP = 1 << 16


def _inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of gzip members one after the other; what isn't compressed comes as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at, member = memoryview(data), 0, None
    while at < len(view):
        if member is None:
            member = zlib.decompressobj(31)
        step = view[at : at + _STEP]
        yield member.decompress(step)
        at += len(step)
        if member.eof:
            at -= len(member.unused_data)
            member = None
            while at < len(view) and view[at] == 0:  # padding
                at += 1
    if member is not None:
        raise ValueError("file ends inside a gzip member")


def split(data: bytes) -> Iterator[bytes]:
    """The records of a file's bytes, gzip members or plain, inflated and cut step by step. An empty file has none; ValueError where no whole record is."""
    held = bytearray()
    for piece in _inflated(data):
        held += piece
        at = 0
        while True:
            while at < len(held) and held[at] in b"\r\n":
                at += 1
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            m = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", held[at : end + 2])
            if held[at : at + 5] != b"WARC/" or not m:
                raise ValueError("no record")
            stop = end + 4 + int(m[1])
            if stop > len(held):
                break
            yield bytes(held[at:stop]) + b"\r\n\r\n"
            at = stop
        del held[:at]
    if held.strip():
        raise ValueError("file ends inside a record")


def _payload(block: bytes) -> tuple[int, list[tuple[str, str]], bytes]:
    """Status, headers and decoded body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    status = re.match(r"HTTP/\S+ (\d{3})", lines[0])
    headers = _headers(lines[1:])
    h = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in h.get("transfer-encoding", ""):
        out, rest = [], body
        while (m := re.match(rb"([0-9a-fA-F]+)[^\r\n]*\r\n", rest)) and int(m[1], 16):
            n = int(m[1], 16)
            out.append(rest[m.end() : m.end() + n])
            rest = rest[m.end() + n + 2 :]
        body = b"".join(out)
    if h.get("content-encoding") in ("gzip", "x-gzip", "deflate"):
        body = zlib.decompress(body, 15 + 32 if "gzip" in h["content-encoding"] else 15)
    return int(status[1]) if status else 0, headers, body


def _text(headers: list[tuple[str, str]], body: bytes) -> str:
    kind = dict((k.lower(), v) for k, v in headers).get("content-type", "")
    m = re.search(r"charset=[\"']?([\w-]+)", kind, re.I)
    try:
        return body.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def page_metadata(page: str, url: str) -> dict:
    """Title, meta elements and links of a page; links are resolved against its address."""
    quiet = _QUIET.sub(" ", page)
    links = []
    for tag, attrs in _LINK.findall(quiet):
        for m in _TARGET.finditer(attrs):
            at = html.unescape(m[2] or m[3] or m[4] or "").strip()
            try:
                at = urljoin(url, at)
            except ValueError:
                pass
            links.append({"path": f"{tag.upper()}@/{m[1].lower()}", "url": at})
    metas = [{k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(x)} for x in _META.findall(quiet)]
    t = _TITLE.search(quiet)
    return {"Title": " ".join(html.unescape(t[1]).split()) if t else None, "Metas": metas, "Links": links}


def derive(data: bytes) -> list[dict]:
    """The metadata record and, of a text response, the conversion record of one response record; none of other records."""
    headers, block = parse(data)
    h = dict((k.lower(), v) for k, v in headers)
    if h.get("warc-type") != "response":
        return []
    of = h.get("warc-record-id", "")
    target = h.get("warc-target-uri")
    status, http, body = _payload(block)
    kind = dict((k.lower(), v.lower()) for k, v in http).get("content-type", "")
    is_text = kind.startswith(("text/html", "application/xhtml", "text/plain")) or not kind
    page = _text(http, body) if is_text else ""
    is_html = is_text and not kind.startswith("text/plain")
    shared = [*([("WARC-Target-URI", target)] if target is not None else []), *([("WARC-Date", h["warc-date"])] if "warc-date" in h else []), ("WARC-Refers-To", of)]
    conversion_id = derived_id(of, "conversion") if is_text else None
    seen = {
        "Envelope": {
            "WARC-Header-Length": len(data) - len(block) - 4,
            "WARC-Header-Metadata": [list(x) for x in headers],
            "Block-Digest": h.get("warc-block-digest") or digest(block),
            "Payload-Metadata": {
                "Status": status,
                "Headers": [list(x) for x in http],
                "Entity-Length": len(body),
                "Entity-Digest": h.get("warc-payload-digest") or digest(body),
                "HTML-Metadata": page_metadata(page, target or "") if is_html else None,
            },
        },
        "Conversion": conversion_id,
    }
    blocks = [("metadata", derived_id(of, "metadata"), "application/json", json.dumps(seen, ensure_ascii=False, sort_keys=True).encode())]
    if is_text:
        text = "\n".join(b[0] for b in html_extract.blocks(page)) if is_html else page
        blocks.append(("conversion", conversion_id, "text/plain; charset=utf-8", text.encode()))
    out = []
    for name, own, content, made in blocks:
        head = [("WARC-Type", name), ("WARC-Record-ID", own), *shared, ("Content-Type", content), ("WARC-Block-Digest", digest(made))]
        out.append(
            {
                "record_type": name, "record_id": own, "refers_to": of, "target_uri": target, "content_type": content, "block_digest": digest(made),
                "source_payload_digest": seen["Envelope"]["Payload-Metadata"]["Entity-Digest"], "n_links": len((seen["Envelope"]["Payload-Metadata"]["HTML-Metadata"] or {"Links": ()})["Links"]),
                "content_length": len(made), "block": made.decode(), "record": record(head, made), "error": None,
            }
        )
    return out


_FIELDS = "record_type string, record_id string, refers_to string, target_uri string, content_type string, block_digest string, source_payload_digest string, n_links int, content_length long, block string, record binary, error string"


def derivatives(records: DataFrame, record_col: str = "record", keep: list[str] | None = None) -> DataFrame:
    """The derived records of each row's response record, with the columns `keep` (none) of that row.

    Records of other types give no rows; a null or broken record gives one with an error and nulls. Repeated records are
    treated each (with equal ids, as ids follow from the response). Each record's bytes are in `record`.
    """
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        types = [pa.int32() if n == "n_links" else pa.int64() if n == "content_length" else pa.binary() if n == "record" else pa.string() for n in names]
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                rows, at = [], []
                for i, data in enumerate(batch.column(len(keep)).to_pylist()):
                    try:
                        got = derive(data or b"")
                    except (ValueError, zlib.error) as e:
                        got = [dict.fromkeys(names) | {"error": str(e) or type(e).__name__}]
                    rows += got
                    at += [i] * len(got)
                index = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(index) for i in range(len(keep))), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True))], names=[*(f"k{i}" for i in range(len(keep))), *names])

    ddl = "".join(f"k{i} {records.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    out = records.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(record_col).alias("r")).mapInArrow(run, ddl + _FIELDS)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *(f.split()[0] for f in _FIELDS.split(", ")))


def responses(pages: DataFrame, url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages with `record`: each page as a response record. A null page is an empty one; without an address the record has no target."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def made(url, page):
        out = []
        for u, p in zip(url, page, strict=True):
            body = (p or "").encode()
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
            own = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{u} {digest(body)}')}>"
            target = [("WARC-Target-URI", u)] if u is not None else []
            head = [("WARC-Type", "response"), ("WARC-Record-ID", own), *target, ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block))]
            out.append(record(head, block))
        import pandas as pd

        return pd.Series(out, dtype=object)

    return pages.withColumn("record", made(F.col(url_col), F.col(html_col)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, record) of the records of .warc and .warc.gz files; a file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for r in split(data):
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([r], pa.binary())], names=["path", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, record binary")


def write(records: DataFrame, folder: str, record_col: str = "record") -> None:
    """Each partition's records as one file of gzip members in `folder`, a path that executors and driver have mounted.

    A file gets its name when it is whole, so a task that runs again replaces it.
    """

    def save(k: int, rows: Iterator) -> Iterator:
        import os

        os.makedirs(folder, exist_ok=True)
        part = f"{folder}/.part-{k:05d}-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            for r in rows:
                if r[0] is not None:
                    f.write(gzip.compress(bytes(r[0]), mtime=0))
        os.replace(part, f"{folder}/part-{k:05d}.warc.gz")
        return iter(())

    records.select(record_col).rdd.mapPartitionsWithIndex(save).count()
