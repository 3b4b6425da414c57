"""Operator 2: metadata and conversion records derived from WARC responses.

Each response gives a ``metadata`` record (the source's headers and digests as fields) and a ``conversion`` record
(its plain text).  Both name the response in WARC-Refers-To, are concurrent with nothing else, and carry their own block
digests.  Record ids are name-based, so a task that runs again writes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import SLICE_BYTES, prepare, slices
from tempora.llm.html_text import MARKUP, RAW, attributes, blocks

FIELDS = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_payload_digest string, header string, content string"
KINDS = [("page_id", pa.int64()), *((n, pa.string()) for n in "record_type record_id refers_to target_uri date content_type".split()), ("content_length", pa.int64()), *((n, pa.string()) for n in "block_digest source_payload_digest header content".split())]
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:derivatives")


def digest(body: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def clean(value: str | None) -> str:
    """A header value on one line."""
    return " ".join((value or "").split())


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(10).join(parts))}>"


def declared(page: str, with_charset: bool = True) -> tuple[str, str]:
    """(language, charset) of the first html tag and of the first meta tag that names a charset, wherever they are."""
    lang = found = None
    at = 0
    while (m := MARKUP.search(page, at)) and (lang is None or with_charset and found is None):
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if m[1] or m[4] or not name:
            continue
        raw = (m[3] if m[2] else m[6]) or ""
        if name == "html" and lang is None:
            of = attributes(raw)
            lang = of.get("lang") or of.get("xml:lang") or ""
        elif name == "meta" and found is None:
            of = attributes(raw)
            named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", of.get("content", ""), re.I)
            found = of.get("charset") or (named[1] if named else None)
        elif name in RAW and not raw.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*/?\s*>", re.I).search(page, at)
            at = end.end() if end else at
    lang = re.match(r"\s*([\w-]+)", lang or "")
    return lang[1] if lang else "", (found or "").strip().lower()


def header_of(fields: list[tuple[str, str]]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v != "") + "\r\n"


def derive(source: dict) -> list[tuple]:
    """The rows of one response: record_id, target_uri, date, http_status, http_headers, payload, page_id."""
    payload = source["payload"] or ""
    uri, date = clean(source["target_uri"]), clean(source["date"])
    refers = clean(source["record_id"]) or record_id("response", uri, date)
    http = [(k.strip(), clean(v)) for k, _, v in (x.partition(":") for x in (source["http_headers"] or "").splitlines()) if k.strip()]
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    body = payload.encode()
    of_payload = digest(body)
    text = "\n".join(b.text for b in blocks(payload))
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind, re.I)
    lang, charset = declared(payload, not named)
    charset = named[1].lower() if named else charset
    title = re.search(r"<title[^>]*>(.*?)</title", payload, re.I | re.S)
    facts = [("source-record-id", refers), ("http-status", "" if source["http_status"] is None else str(source["http_status"]))]
    facts += [(f"http-header-{k.lower()}", v) for k, v in http]
    facts += [("charset", charset), ("language", lang), ("title", clean(title[1]) if title else ""), ("source-payload-length", str(len(body))), ("source-payload-digest", of_payload), ("conversion-record-id", record_id("conversion", refers)), ("conversion-payload-digest", digest(text.encode()))]
    made = [("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in facts if v)), ("conversion", "text/plain; charset=utf-8", text)]
    rows = []
    for what, content_type, content in made:
        raw = content.encode()
        own = record_id(what, refers)
        head = header_of([("WARC-Type", what), ("WARC-Record-ID", own), ("WARC-Refers-To", refers), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", digest(raw)), ("WARC-Source-Payload-Digest", of_payload), ("Content-Type", content_type), ("Content-Length", str(len(raw)))])
        rows.append((source["page_id"], what, own, refers, uri, date, content_type, len(raw), digest(raw), of_payload, head, content))
    return rows


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "payload"):
        rows = [r for source in batch.to_pylist() for r in derive(source)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(KINDS)], names=[n for n, _ in KINDS])


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows for each response (page_id, record_id, target_uri, date, http_status, http_headers, payload, ...).

    A null or empty payload gives an empty conversion; a null record_id is made from URI and date; null headers are left
    out.  Line breaks inside header values are folded.  Payloads of any length are converted whole, a slice of bounded bytes, or one, at a time.  Repeated responses give repeated records with equal ids; extra
    columns are ignored; an empty table gives an empty result.  One narrow pass.
    """
    prepare(responses.sparkSession)
    return responses.select(F.col("page_id").cast("long").alias("page_id"), "record_id", "target_uri", "date", F.col("http_status").cast("int").alias("http_status"), "http_headers", "payload").mapInArrow(_derived, FIELDS)


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records for a table of pages (page_id, url, html)."""
    key = F.sha1(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.lit(date)))
    uid = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(key, 1, 8), F.substring(key, 9, 4), F.concat(F.lit("5"), F.substring(key, 14, 3)), F.concat(F.lit("8"), F.substring(key, 18, 3)), F.substring(key, 21, 12)), F.lit(">"))
    return pages.select("page_id", uid.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.lit(200).alias("http_status"), F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string")).alias("http_headers"), F.col("html").alias("payload"))


def serialized(records: DataFrame) -> DataFrame:
    """(page_id, record_type, warc): each record as the bytes of a WARC file; concatenated, they are one."""
    return records.select("page_id", "record_type", F.encode(F.concat("header", "content", F.lit("\r\n\r\n")), "UTF-8").alias("warc"))


def members(data: bytes) -> Iterator[bytes]:
    """The records of a file that is compressed record by record, or the file as it is."""
    if not data.startswith(b"\x1f\x8b"):
        yield data
        return
    rest = memoryview(data)
    while len(rest):
        unzip = zlib.decompressobj(31)
        yield unzip.decompress(rest)
        rest = rest[len(rest) - len(unzip.unused_data) :] if unzip.eof else rest[:0]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names=["path", "headers", "content"])

    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            size = 0
            for part in members(data):
                at = 0
                while (end := part.find(b"\r\n\r\n", at)) >= 0:
                    head = dict(x.partition(":")[::2] for x in part[at:end].decode().split("\r\n")[1:])
                    head = {k: v.strip() for k, v in head.items()}
                    length = int(head["Content-Length"])
                    held.append((path, list(head.items()), part[end + 4 : end + 4 + length]))
                    at = end + 8 + length
                    size += length
                    if size >= SLICE_BYTES:
                        yield out()
                        held.clear()
                        size = 0
            if held:
                yield out()
                held.clear()


def read_records(files: DataFrame) -> DataFrame:
    """(path, headers, content) of the records in WARC files, plain or compressed record by record, as binaryFile gives them (path, content, ...).

    A file is one row, so files have to fit a task; their records are handed on a slice at a time.
    """
    prepare(files.sparkSession)
    return files.select("path", "content").mapInArrow(_split, "path string, headers map<string,string>, content binary")
