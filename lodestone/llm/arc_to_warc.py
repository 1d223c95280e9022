"""Operator 4: legacy ARC archives to WARC records.

An ARC file opens with a version block (``filedesc://``) whose second line gives the version and whose third names
the fields of the header lines that follow: five in version 1 (URL, IP, date, content type, length),
ten in version 2 (also result code, checksum, location, offset, file name). Each record is its header
line, then as many bytes as it declares, then a newline. Records are taken by declared length, never by
searching for the next header; where a length is wrong or missing, reading resumes at the next line that parses as a header and
the fault is noted. A length that ends beyond the file or within a line is too long if a sound header, whose own length fits, stands within the body;
the record then ends before it. URLs may be relative or bare hosts if the other fields are well formed.

Each becomes a WARC 1.0 record: identifier ``urn:uuid`` from a digest of URL, date, payload and place (the same in
every run), date in ISO 8601, type by content (``warcinfo`` for the version block, ``response`` for an
HTTP answer, ``resource`` for others and for FTP or DNS), and SHA-1 block and payload digests in base 32. The block of a ``warcinfo`` record has
named fields: the version of the archive, the names of its header fields, and the text of its version block, percent-encoded.

Nulls and ties: null or empty archives give no records. A header with an impossible date keeps the record,
with the date of the archive, or 1970 if that has none, and the fault ``date``. A version block that names no URL first or no length last is ignored, with the fault
``names``, and the names of its version hold. What can be read of a damaged gzip member is read, the next record (or the last, if none follows) has the fault ``gzip``, and reading resumes
at the next member. Fields given as ``-`` are null, but for the URL. Records that repeat one another have identifiers of
their own, as their places differ; repeated archives of one id give equal records. In a page table, null ids, URLs and texts become
``-`` or empty fields; other columns are ignored. Records of any length are taken whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

V1 = ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length")
V2 = ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")
#: Pages in one archive made by `pages_to_arc`.
PAGES = 200

_IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]*")
_MIME = re.compile(r"[\w.+\-]+/[\w.+\-]+;?|no-type|unknown")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:")
_GZIP = b"\x1f\x8b\x08"
_HTTP = re.compile(rb"HTTP/\d\.\d +(\d{3})")


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _date(text: str | None) -> str | None:
    text = (text or "") + "00000000"[: max(0, 14 - len(text or ""))] if 8 <= len(text or "") <= 14 else ""
    try:
        return datetime.strptime(text[:14], "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def _header(line: bytes, names: tuple[str, ...]) -> dict[str, str | None] | None:
    """The fields of a header line; None if it isn't one. Spaces in a URL are allowed, as the other fields have none."""
    text = line.decode("utf-8", "replace").rstrip("\r\n")
    fields = text.rsplit(" ", len(names) - 1)
    if len(fields) != len(names) or not fields[0].strip() or not re.fullmatch(r"[0-9]+", fields[-1]):
        return None
    out = {n: (None if v == "-" and n != "URL" else v) for n, v in zip(names, fields)}
    if not (re.fullmatch(r"\d{8,17}", out.get("Archive-date") or "0") or not out.get("Archive-date")):
        return None
    # without a scheme the URL says little, so the other fields must be what they ought to be
    return out if ":" in fields[0] or _sound(out) else None


def _sound(fields: dict[str, str | None]) -> bool:
    """Whether address, date, type and result code of a header are well formed."""
    ip, mime, code = fields.get("IP-address"), fields.get("Content-type"), fields.get("Result-code")
    return bool(fields.get("Archive-date")) and (ip is None or bool(_IP.fullmatch(ip))) and (mime is None or bool(_MIME.fullmatch(mime))) and (code is None or code.isdigit())


def _next_header(data: bytes, begin: int, end: int, names: tuple[str, ...]) -> int | None:
    """Where within a body, after a newline, a line stands that is a sound header of a record that ends where a record may end."""
    at = data.find(b"\n", begin, end)
    while at >= 0:
        stop = data.find(b"\n", at + 1)
        stop = len(data) if stop < 0 else stop
        line = data[at + 1 : stop]
        if line[-1:].isdigit() or line[-2:-1].isdigit():
            fields = _header(line, names)
            if fields and _sound(fields):
                after = stop + 1 + int(fields["Archive-length"])
                if after == len(data) or data[after : after + 1] in (b"\n", b"\r"):
                    return at + 1
        at = data.find(b"\n", at + 1, end)
    return None


def _inflated(data: bytes, step: int = 65_536) -> tuple[bytes, list[int]]:
    """The contents of all gzip members, and the places in them where a damaged member broke off."""
    out, bad, size, at = [], [], 0, 0
    while at < len(data):
        d, place, whole = zlib.decompressobj(31), at, True
        while not d.eof and place < len(data):
            try:
                out.append(d.decompress(data[place : place + step]))
            except zlib.error:
                whole = False
                break
            size += len(out[-1])
            place += step
        if whole and d.eof:
            at = min(place, len(data)) - len(d.unused_data)
        else:
            bad.append(size)
            at += 2
        if data[at : at + 3] != _GZIP:
            at = data.find(_GZIP, at)
            if at < 0:
                break
    return b"".join(out), bad


def _version_fields(name: str, version: int, names: tuple[str, ...], body: bytes) -> bytes:
    """The block of a warcinfo record."""
    fields = ("format", "WARC File Format 1.0"), ("isPartOf", quote(name)), ("arcVersion", version), ("arcFields", " ".join(names)), ("arcVersionBlock", quote(body))
    return "".join(f"{k}: {v}\r\n" for k, v in fields).encode()


def records(data: bytes, name: str = "") -> Iterator[dict]:
    """The WARC records of one ARC file (plain or gzip, of one or many members)."""
    bad: list[int] = []
    if data[:3] == _GZIP:
        data, bad = _inflated(data)
    at, names, version, seq, born = 0, V1, 1, 0, None
    fault = None
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end]
        if not line.strip():
            at = end + 1
            continue
        fields = None
        if line.startswith(b"filedesc:"):
            fields = _header(line, V1) or _header(line, V2)
        fields = fields or _header(line, names)
        if fields is None:
            at, fault = end + 1, "header"
            continue
        body = data[end + 1 : end + 1 + int(fields["Archive-length"])]
        if len(body) < int(fields["Archive-length"]):
            fault = "short"
        at = end + 1 + len(body)
        if len(body) < int(fields["Archive-length"]) or (at < len(data) and data[at : at + 1] not in (b"\n", b"\r")):
            fault = fault or "length"
            # the length is wrong: a body too long holds the records that follow
            inner = _next_header(data, end + 1, at, names)
            if inner is not None:
                fault, at = "length", inner
                body = data[end + 1 : inner - 1]
        info = line.startswith(b"filedesc:")
        if info:
            rows = body.decode("utf-8", "replace").splitlines()
            version = 2 if rows and rows[0].startswith("2") else 1
            told = tuple(rows[1].split(" ")) if len(rows) > 1 and rows[1] else ()
            sound = len(told) > 1 and told[0] == "URL" and told[-1] == "Archive-length" and len(set(told)) == len(told)
            names = told if sound else V2 if version == 2 else V1
            if told and not sound:
                fault = fault or "names"
            body = _version_fields(name, version, names, body)
        date = _date(fields.get("Archive-date"))
        born = date if info else born
        if bad and bad[0] <= at:
            fault, bad = "gzip", [x for x in bad if x > at]
        answer = _HTTP.match(body)
        web = fields["URL"].lower().startswith("http") or not _SCHEME.match(fields["URL"])
        kind = "warcinfo" if info else "response" if answer and web else "resource"
        payload = body
        if kind == "response":
            split = re.search(rb"\r?\n\r?\n", body)
            payload = body[split.end() :] if split else b""
        mime = "application/warc-fields" if info else "application/http; msgtype=response" if kind == "response" else fields.get("Content-type") or "application/octet-stream"
        block = _digest(body)
        ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}|{seq}|{fields['URL']}|{fields.get('Archive-date')}|{block}")
        yield {
            "seq": seq, "arc_version": version, "warc_type": kind, "record_id": f"<urn:uuid:{ident}>", "warc_date": date or born or "1970-01-01T00:00:00Z", "target_uri": None if info else fields["URL"],
            "ip_address": None if fields.get("IP-address") in (None, "0.0.0.0") else fields["IP-address"], "content_type": mime, "payload_type": None if info else fields.get("Content-type"),
            "status": int(answer.group(1)) if kind == "response" else None, "content_length": len(body), "block_digest": block, "payload_digest": None if info else _digest(payload),
            "fault": fault or (None if date else "date"), "block": body,
        }
        seq, fault = seq + 1, None


def serialise(record: dict) -> bytes:
    """One record of `records` as WARC bytes."""
    lines = ["WARC/1.0", f"WARC-Type: {record['warc_type']}", f"WARC-Record-ID: {record['record_id']}"]
    for title, field in (("WARC-Date", "warc_date"), ("WARC-Target-URI", "target_uri"), ("WARC-IP-Address", "ip_address"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type")):
        if record[field] is not None:
            lines.append(f"{title}: {record[field]}")
    lines.append(f"Content-Length: {record['content_length']}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + record["block"] + b"\r\n\r\n"


_FIELDS = [("seq", pa.int64()), ("arc_version", pa.int32()), ("warc_type", pa.string()), ("record_id", pa.string()), ("warc_date", pa.string()), ("target_uri", pa.string()), ("ip_address", pa.string()), ("content_type", pa.string()), ("payload_type", pa.string()), ("status", pa.int32()), ("content_length", pa.int64()), ("block_digest", pa.string()), ("payload_digest", pa.string()), ("fault", pa.string())]
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
OUT = "archive string, " + ", ".join(f"{n} {_SQL[t]}" for n, t in _FIELDS) + ", warc binary"


def convert(archives: DataFrame, name_col: str = "path", data_col: str = "content") -> DataFrame:
    """The WARC records of a table of ARC files, such as ``spark.read.format("binaryFile")`` gives; ``warc`` has each as bytes."""

    def converted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, data in zip(part.column("archive"), part.column("data")):
                name, held, size = name.as_py(), [], 0
                for r in records(data.as_py() or b"", name or ""):
                    r |= {"archive": name, "warc": serialise(r)}
                    held.append(r)
                    size += len(r["warc"])
                    if size > 2_000_000:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        names = [("archive", pa.string()), *_FIELDS, ("warc", pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in names], names=[n for n, _ in names])

    return archives.select(F.col(name_col).cast("string").alias("archive"), F.col(data_col).cast("binary").alias("data")).mapInArrow(converted, OUT)


def arc_record(version: int, url: str, date: str, body: bytes, mime: str, status: int) -> bytes:
    fields = [url, "0.0.0.0", date, mime] + ([str(status), "-", "-", "0", "-"] if version == 2 else []) + [str(len(body))]
    return " ".join(fields).encode() + b"\n" + body + b"\n"


def arc_file(name: str, version: int, items: list[tuple[str | None, str | None, str]]) -> bytes:
    """An ARC file of ``(url, html, date)`` items, as a crawler would have written it."""
    info = f"{version} 0 synthetic\n{' '.join(V2 if version == 2 else V1)}\n".encode()
    out = [arc_record(1, f"filedesc://{name}", items[0][2] if items else "19960101000000", info, "text/plain", 200)]
    for url, page, date in items:
        body = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n" + (page or "").encode()
        out.append(arc_record(version, (url or "http:-").replace(" ", "%20").replace("\n", "%0A"), date, body, "text/html", 200))
    return b"".join(out)


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", per_file: int = PAGES) -> DataFrame:
    """ARC files ``(path, content)`` of a page table, versions 1 and 2 in turn; dates follow from the ids.

    An archive has the pages of ``per_file`` neighbouring ids, at most so many; pages without an id go by a hash of what they hold. So the archives are the same however the table is read.
    """

    def one(rows: list[tuple]) -> pa.RecordBatch:
        version = 1 + (rows[0][1] or 0) % 2
        name = f"{hashlib.sha1(repr([r[1:3] for r in rows]).encode()).hexdigest()[:16]}.arc"
        items = [(u, h, f"{1996 + (i or 0) % 12}0{1 + (i or 0) % 9}15{(i or 0) % 24:02d}3000") for _, i, u, h in rows]
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([arc_file(name, version, items)], pa.binary())], names=["path", "content"])

    def made(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part in parts:
            for row in zip(*(part.column(c).to_pylist() for c in "aiuh")):
                if held and (held[0][0] != row[0] or len(held) == per_file):
                    yield one(held)
                    held = []
                held.append(row)
        if held:
            yield one(held)

    own = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("h"))
    archive = F.coalesce(F.floor(F.col("i") / per_file), -1 - F.pmod(F.xxhash64("u", "h"), F.lit(2**20)))
    return own.withColumn("a", archive.cast("long")).repartition("a").sortWithinPartitions("a", "i", "u", "h").select("a", "i", "u", "h").mapInArrow(made, "path string, content binary")
