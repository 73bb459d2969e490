"""WARC archives: writing with segmented records, and reading with segment reassembly.

Writing: a gzip member for every record, so that each can be read alone, in files of at most about ``FILE_BYTES``. A page is
one record, whose block is an HTTP response with its body in chunked transfer framing; a block over ``SEGMENT`` characters is
cut (between characters) into a first record and continuation records, which may lie in different files. Of pages with equal
payloads of at least ``LEAST_REVISIT`` bytes the one with the smallest id is written whole, the others as revisits that name
its record. Spark's text writer writes the members: it is given each without its last byte, which is zero for any member of
less than 16 MB (the high byte of its length), and that zero as line end.

Reading: a streaming parser goes by Content-Length. Whole records are decoded at once; segments are grouped by their
origin's record id, ordered by segment number, checked (numbers without gaps, total length), joined, and then decoded.

Defined cases: page ids are whole numbers (others are refused); null html is an empty payload, a null url leaves out the target; a null page id is kept as null (and is
never what a revisit refers to); repeated rows become records of their own, all of them responses if their id is the
smallest, and revisits name the first of them. A damaged record (missing segment, wrong length, bad framing, wrong digest) comes back with ``problem`` set and
no payload. Extra columns are not written.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, shared_path, utf8, whole_number, written

SEGMENT, CHUNK = 32_768, 8_192
LEAST_REVISIT = 100
#: Bytes of a file; a row of the reader is one file.
FILE_BYTES = 32 << 20
#: Effort of the compression, 1 to 9.
LEVEL = 4
DATE = "2000-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- writing --------------------------------------------------------------------


def chunked(body: str, size: int = CHUNK) -> str:
    """The body in chunked transfer framing, cut between characters."""
    parts = []
    for at in range(0, len(body), size):
        piece = body[at : at + size]
        parts.append(f"{len(utf8(piece)):x}\r\n{piece}\r\n")
    return "".join(parts) + "0\r\n\r\n"


def _record(headers: list[tuple[str, str | int | None]], block: str) -> str:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(utf8(block))}\r\n\r\n{block}\r\n\r\n"


def _name(page_id: int | None, uid: int) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{uid}>"


def records(page_id: int | None, uid: int, url: str | None, html: str, digest: str, size: int, refers_to: tuple[int, int] | None, segment: int = SEGMENT) -> Iterator[str]:
    """The records of one page; ``refers_to`` is the page id and uid of the response that it revisits."""
    name = _name(page_id, uid)
    uri = None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=-._~")
    about = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", size)]
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *about, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", _name(*refers_to)), ("Content-Type", "application/http;msgtype=response")], _HTTP)
        return
    block = _HTTP + chunked(html)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    many = len(parts) > 1
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", name), *about, ("WARC-Segment-Number", 1 if many else None), ("Content-Type", "application/http;msgtype=response")], parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = len(utf8(block)) if k == len(parts) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Number", k), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Total-Length", total)], part)


def _member(record: str) -> bytes:
    """A gzip member (several for a record of 8 MB or more, which only a url of such length makes)."""
    data, out = utf8(record), []
    for at in range(0, len(data), 8 << 20):
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out += [z.compress(data[at : at + (8 << 20)]), z.flush()]
    return b"".join(out)


def write(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Writes the archive files below ``path`` (in folders ``file=N``)."""
    prepare(pages.sparkSession)
    rows = pages.select(whole_number(pages, "page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    if rows.groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        rows = rows.withColumn("uid", F.lit(0).cast("long"))
    else:  # repeated ids: records are told apart by row numbers, written once so that they stay
        rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    # One short row a repeated payload; the pages' side of the join may be split where one payload is hot.
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "uid"))
    first = rows.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min(known).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    rows = rows.join(first, "digest", "left").withColumn("refers", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first")))
    rows = rows.withColumn("html", F.when(F.col("refers").isNull(), F.col("html")).otherwise("")).select("page_id", "uid", "url", "html", "digest", "size", F.col("refers.page_id").alias("to_page"), F.col("refers.uid").alias("to_uid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = filled = 0
        for b in batches:
            made, files = [], []
            for *row, to_page, to_uid in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for r in records(*row, None if to_page is None else (to_page, to_uid), segment):
                    member = _member(r)
                    filled += len(member)
                    if filled > FILE_BYTES:
                        number, filled = number + 1, len(member)
                    made.append(member[:-1])
                    files.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(files, pa.int32())], names=["member", "file"])

    members = rows.mapInArrow(run, "member binary, file int")
    members.select(F.col("member").cast("string").alias("value"), "file").write.partitionBy("file").options(lineSep="\0", compression="none").text(path)


# -- reading --------------------------------------------------------------------


def parse(data: bytes, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of one file, plain or gzipped (any number of members)."""
    buffer, at = bytearray(), 0
    source = _plain(data, step)

    def more() -> bool:
        nonlocal at
        if at > step:
            del buffer[:at]
            at = 0
        piece = next(source, None)
        if piece is None:
            return False
        buffer.extend(piece)
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0 or bytes(buffer[at : at + 2]) == b"\r\n":
            if bytes(buffer[at : at + 2]) == b"\r\n":
                at += 2  # blank lines between records
            elif not more():
                return
        head = bytes(buffer[at:end]).decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        size = int(headers.get("content-length", 0))
        at = end + 4
        while len(buffer) - at < size and more():
            pass
        yield headers, bytes(buffer[at : at + size])
        at += size


def _plain(data: bytes, step: int) -> Iterator[bytes]:
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), step):
            yield data[at : at + step]
        return
    at, tail = 0, b""  # members are fed in small pieces, so what one leaves over is short
    while tail or at < len(data):
        d = zlib.decompressobj(31)
        while not d.eof:
            if not tail:
                if at >= len(data):
                    return
                tail, at = bytes(view[at : at + _FEED]), at + _FEED
            if piece := d.decompress(tail, step):
                yield piece
            tail = d.unconsumed_tail
        tail = d.unused_data


_FEED = 1 << 16


def body(block: bytes) -> bytes:
    """The payload of an HTTP message; raises ValueError on bad framing."""
    head, blank, rest = block.partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("no end of the HTTP headers")
    if b"transfer-encoding: chunked" not in head.lower():
        return rest
    out, at = [], 0
    while True:
        line = rest.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunked framing ends early")
        size = int(rest[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if rest[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk has another length")
        out.append(rest[at : at + size])
        at += size + 2


def reassembled(segments: list[tuple[int, bytes, int | None]]) -> bytes:
    """Joins ``(number, block, total length)``; raises ValueError where a segment is missing or the length differs."""
    segments = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("segment numbers have gaps")
    block = b"".join(s[1] for s in segments)
    if segments[-1][2] is None or segments[-1][2] != len(block):
        raise ValueError("the total length differs")
    return block


def _page(urn: str | None) -> int | None:
    told = (urn or "").strip("<>").split(":")
    return int(told[2]) if len(told) > 2 and told[2].lstrip("-").isdigit() else None


def _decoded(headers: dict, block: bytes, problem: str | None = None) -> dict:
    """The row of one page."""
    kind, digest = headers.get("warc-type"), (headers.get("warc-payload-digest") or "").removeprefix("sha256:")
    row = {"page_id": _page(headers.get("warc-record-id")), "record_type": kind, "url": headers.get("warc-target-uri"), "refers_to": _page(headers.get("warc-refers-to")), "payload": None, "payload_digest": digest, "payload_bytes": int(headers.get("x-payload-length") or 0), "problem": problem}
    if kind == "response" and problem is None:
        try:
            row["payload"] = body(block)
            row["payload_digest"], row["payload_bytes"] = hashlib.sha256(row["payload"]).hexdigest(), len(row["payload"])
            if digest and digest != row["payload_digest"]:
                row |= {"problem": "the payload's digest differs", "payload": None}
        except ValueError as e:
            row |= {"problem": str(e), "payload": None}
    return row


_PAGE = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("problem", pa.string())])
_PART = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
_PAGE_SQL = "page_id long, record_type string, url string, refers_to long, payload binary, payload_digest string, payload_bytes long, problem string"
_PART_SQL = "origin string, number int, total long, headers map<string, string>, block binary"
_BOTH = pa.schema([("page", pa.struct(list(_PAGE))), ("part", pa.struct(list(_PART)))])
_ROWS_OUT, _BYTES_OUT = 512, 4 << 20


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row a response or revisit record of the files of ``path``."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for b in batches:
            for content in b.column(0):
                for headers, block in parse(content.as_py()):
                    kind = headers.get("warc-type")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    if "warc-segment-number" in headers:
                        total = headers.get("warc-segment-total-length")
                        origin = headers.get("warc-segment-origin-id") or headers.get("warc-record-id")
                        rows.append({"page": None, "part": {"origin": origin, "number": int(headers["warc-segment-number"]), "total": total and int(total), "headers": list(headers.items()), "block": block}})
                        size += len(block)
                    else:
                        page = _decoded(headers, block)
                        if not with_payload:
                            page["payload"] = None
                        rows.append({"page": page, "part": None})
                        size += len(page["payload"] or b"")
                    if len(rows) >= _ROWS_OUT or size >= _BYTES_OUT:
                        yield pa.RecordBatch.from_pylist(rows, schema=_BOTH)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_BOTH)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.column(0).to_pylist():
                first = min(row, key=lambda s: s["number"])
                headers = dict(first["headers"])
                try:
                    page = _decoded(headers, reassembled([(s["number"], s["block"], s["total"]) for s in row]))
                except ValueError as e:
                    page = _decoded(headers, b"", str(e))
                if not with_payload:
                    page["payload"] = None
                out.append(page)
            yield pa.RecordBatch.from_pylist(out, schema=_PAGE)

    # Both branches below read the parsed records, so they are kept in the shared folder.
    parsed = written(files.mapInArrow(run, f"page struct<{_typed(_PAGE_SQL)}>, part struct<{_typed(_PART_SQL)}>"), "records")
    whole = parsed.filter("page is not null").select("page.*")
    # A group is one record: its segments are no more than the page itself.
    groups = parsed.filter("part is not null").select("part.*").groupBy("origin").agg(F.collect_list(F.struct("number", "total", "headers", "block")).alias("s")).select("s")
    return whole.unionByName(groups.mapInArrow(join, _PAGE_SQL))


def _typed(ddl: str) -> str:
    """``a int, b map<string, string>`` as the inside of ``struct<...>``."""
    out = []
    for field in ddl.replace("map<string, string>", "map<string;string>").split(", "):
        name, kind = field.split(" ", 1)
        out.append(f"{name}: {kind.replace(';', ', ')}")
    return ", ".join(out)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives and reads them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path)
    return read(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
