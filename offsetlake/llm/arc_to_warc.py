"""Legacy archive converter: ARC versions 1 and 2 to WARC 1.1, and a reader of what it wrote.

Archives are byte strings of some MB in a table (archive, content); a row is one archive file. So they are written and read by
Spark on any store, and a lost executor costs a rerun of its archives only.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offsetlake.llm.scratch import materialise
from offsetlake.llm.skew import hot_join, hot_keys

ARCHIVE_BYTES = 8 << 20
MIN_DEDUP_BYTES = 100
_GZIP_STEP = 8 << 10
_PAGE = b"X-Page-Id"

#: The field lines of the two ARC versions.
ARC_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


#: A header line: URL (blanks may be in it), address, date, type (blanks may be in it), the other fields of version 2, length.
_HEADER = {v: re.compile(rb"(.+?) ([0-9A-Fa-f.:]+|-) ([0-9]{4,17}) (.*)" + b" ([^ ]+)" * (len(fields.split()) - 5) + rb" ([0-9]+)") for v, fields in ARC_FIELDS.items()}


def arc_archive(name: str, version: int, records: Iterator[tuple[str | None, str, bytes]]) -> bytes:
    """An ARC file of (url, 14-digit date, HTTP response) records with the header lines of that version."""
    out = io.BytesIO()
    about = b"%d %d offsetlake\n" % (version, 0) + ARC_FIELDS[version] + b"\n"

    def line(url: str, ip: str, date: str, kind: str, code: str, size: int) -> bytes:
        url = url.replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D").replace("\t", "%09") or "-"
        extra = [code, "-", "-", str(out.tell()), name] if version == 2 else []
        return " ".join([url, ip, date, kind, *extra, str(size)]).encode() + b"\n"

    out.write(line(f"filedesc://{name}", "0.0.0.0", "20240101000000", "text/plain", "200", len(about)) + about + b"\n")
    for url, date, body in records:
        out.write(line(url or "-", "0.0.0.0", date, "text/html", "200", len(body)) + body + b"\n")
    return out.getvalue()


def gunzip(content: bytes) -> bytes:
    """What a gzip file's members hold, in time linear in it; zero bytes after a member are padding.

    A member gets pieces of _GZIP_STEP bytes until it ends, so at most one piece is read again for the next. `gzip.decompress` hands every member the
    whole rest of the file, which for a member a record costs the square of the file's size.
    """
    data, at, parts = memoryview(content), 0, []
    while at < len(data):
        member = zlib.decompressobj(wbits=16 + zlib.MAX_WBITS)
        while not member.eof:
            piece = data[at : at + _GZIP_STEP]
            if not piece:
                raise EOFError("gzip member is cut short")
            parts.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        while at < len(data) and not data[at]:
            at += 1
    return b"".join(parts)


def read_arc(content: bytes) -> Iterator[dict]:
    """Records of an ARC file, which may be gzipped: its first block names the version, whose fields are counted from both ends of a header line.

    Blanks in the URL or the content type belong to these: address and date stand between them, and the version's last fields are at the end.
    A header's declared length bounds the record; blank lines between records are skipped. A line with too few fields or a length that is no
    number or beyond the file raises ValueError: a damaged archive is an error, not a shorter archive.
    """
    content = gunzip(content) if content[:2] == b"\x1f\x8b" else content
    at, version = 0, 0
    while at < len(content):
        end = content.find(b"\n", at)
        end = len(content) if end < 0 else end
        line = content[at:end].rstrip(b"\r")
        if not line:
            at = end + 1
            continue
        if not version:
            size = line.rsplit(b" ", 1)[-1]
            body = content[end + 1 : end + 1 + int(size)] if size.isdigit() else b""
            mark = body.split(b" ", 1)[0]
            version = int(mark) if mark.isdigit() else 0
            if version not in ARC_FIELDS or not line.startswith(b"filedesc:"):
                raise ValueError("no ARC version block")
            at = end + 1 + len(body)
            continue
        fields = _HEADER[version].fullmatch(line)
        if not fields:
            raise ValueError(f"bad ARC header at {at}")
        url, ip, date, kind, *_, size = fields.groups()
        if end + 1 + int(size) > len(content):
            raise ValueError(f"ARC record at {at} is cut short")
        yield {"offset": at, "url": url.decode("utf-8", "replace"), "ip": ip.decode(), "date": date.decode(), "type": kind.decode("utf-8", "replace"), "body": content[end + 1 : end + 1 + int(size)]}
        at = end + 1 + int(size)


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(header block, payload) of an HTTP response; a body without a header block is all payload."""
    at = body.find(b"\r\n\r\n")
    return (body[: at + 4], body[at + 4 :]) if body.startswith(b"HTTP/") and at >= 0 else (b"", body)


def http_field(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower():
            return value.strip()
    return None


def warc_id(archive: str, offset: int) -> str:
    """A record identifier that the archive's name and the record's offset fix."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{archive}#{offset}')}>"


def warc_date(date: str) -> str:
    """yyyymmddhhmmss as an ISO 8601 time; missing digits count as the earliest time."""
    d = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of a WARC file of gzip members."""
    data, at = gunzip(content), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content): ARC files of about archive_bytes, in turn of version 1 and 2. Null html is an empty payload; a null id is left out of the HTTP header.

    An archive is named by the partition that wrote it and its number there, so names are unique in the table. Header lines count in its size, so
    archives of empty pages are bounded too.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made, part = [], 0, 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal held, size, made
            made += 1
            name = f"part-{part:06d}-{made:06d}.arc"
            content = arc_archive(name, 1 + made % 2, iter(held))
            held, size = [], 0
            return pa.RecordBatch.from_pydict({"archive": [name], "content": [content]}, schema=pa.schema([("archive", pa.string()), ("content", pa.binary())]))

        for batch in batches:
            ids, urls, pages_ = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())
            for i, url, html in zip(ids, urls, pages_, strict=True):
                payload = html.as_py() or b""
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + (b"%s: %d\r\n" % (_PAGE, i) if i is not None else b"") + b"Content-Length: %d\r\n\r\n" % len(payload)
                held.append((url, date, head + payload))
                size += len(head) + len(payload) + len(url or "") + 100
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(pack, "archive string, content binary")


_INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64())])


def index_arc(archives: DataFrame) -> DataFrame:
    """(archive, offset, page_id, digest, payload_bytes) of every HTTP response in the ARC files."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for r in read_arc(content.as_py()):
                    head, payload = split_http(r["body"])
                    if head:
                        rows.append((name, r["offset"], _number(http_field(head, _PAGE)), hashlib.sha256(payload).hexdigest(), len(payload)))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(_INDEX)], schema=_INDEX)

    return archives.select("archive", "content").mapInArrow(parse, "archive string, offset long, page_id long, digest string, payload_bytes long")


def _number(text: bytes | str | None) -> int | None:
    return int(text) if text is not None else None


def arc_to_warc(archives: DataFrame, min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """(archive, content): one WARC file (a gzip member a record) for each ARC file.

    Of HTTP records with equal payloads of at least min_bytes, those with the smallest page id are responses (repeated rows all are), the others are
    revisits of the first of these by archive and offset: HTTP header only, with the payload's digest and the response's record id. A record without
    an HTTP header is a resource with its own content type. Identifiers are made from archive name and offset, times from the ARC date, digests from
    the payload. A record without page id is never a revisit.

    Only each archive's list of revisits is grouped with it (archives are of bounded size, and some four of them are a task's); payloads are neither
    sorted nor compared, digests are.
    """
    index = index_arc(archives)
    large = index.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    first = materialise(large.groupBy("digest").agg(F.min(F.struct("page_id", "archive", "offset")).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    again = hot_join(large, first.select("digest", "first"), ["digest"], hot_keys(first, "digest")).where(F.col("page_id") > F.col("first.page_id"))
    again = again.select("archive", "offset", F.col("first.page_id").alias("page_id"), F.col("first.archive").alias("of"), F.col("first.offset").alias("at"))

    def convert(arc: pa.Table, revisits: pa.Table) -> pa.Table:
        named = {o: (p, a, k) for o, p, a, k in zip(*(revisits[c].to_pylist() for c in ("offset", "page_id", "of", "at")), strict=True)}
        out = {"archive": [], "content": []}
        for name, content in zip(arc["archive"].to_pylist(), arc["content"], strict=True):
            parts = [warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", warc_id(name, 0)), ("WARC-Date", warc_date("20240101000000")), ("Content-Type", "application/warc-fields")], f"software: offsetlake\r\nconverted-from: {name}\r\n".encode())]
            for r in read_arc(content.as_py()):
                head, payload = split_http(r["body"])
                about = [("WARC-Record-ID", warc_id(name, r["offset"])), ("WARC-Date", warc_date(r["date"])), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}")]
                about = [(k, v) for k, v in about if (k, v) != ("WARC-IP-Address", "-")]
                if not head:
                    parts.append(warc_record([("WARC-Type", "resource"), *about, ("Content-Type", r["type"] or "application/octet-stream")], payload))
                    continue
                about += [("Content-Type", "application/http; msgtype=response"), ("WARC-Identified-Payload-Type", r["type"])]
                if r["offset"] in named:
                    page, of, at = named[r["offset"]]
                    about = [("WARC-Type", "revisit"), *about, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", warc_id(of, at)), ("WARC-Refers-To-Page", str(page)), ("WARC-Truncated", "length")]
                    parts.append(warc_record(about, head))
                else:
                    parts.append(warc_record([("WARC-Type", "response"), *about], r["body"]))
            out["archive"].append(name.removesuffix(".gz").removesuffix(".arc") + ".warc.gz")
            out["content"].append(b"".join(parts))
        return pa.table(out, schema=pa.schema([("archive", pa.string()), ("content", pa.binary())]))

    dealt = archives.select("archive", "content").repartition(max(1, archives.count() // 4), "archive")
    return dealt.groupBy("archive").cogroup(again.groupBy("archive")).applyInArrow(convert, "archive string, content binary")


_RECORD = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_to_id", pa.string())])


def read_archives(archives: DataFrame) -> DataFrame:
    """One row for each response, revisit or resource record of the WARC files; a payload that is there is measured and hashed anew and must match its digest."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in read_warc(content.as_py()):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit", "resource"):
                        continue
                    head, payload = split_http(block) if kind != "resource" else (b"", block)
                    digest, size = fields["warc-payload-digest"].partition(":")[2], len(payload)
                    if kind == "revisit":
                        size = int(http_field(head, b"Content-Length") or 0)
                    elif hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                    rows.append((_number(http_field(head, _PAGE)), fields["warc-record-id"], fields.get("warc-target-uri"), size, digest, kind, _number(fields.get("warc-refers-to-page")), fields.get("warc-refers-to")))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(_RECORD)], schema=_RECORD)

    return archives.select("content").mapInArrow(parse, "page_id long, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_to_id string")
