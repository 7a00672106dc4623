"""A WARC reader that salvages damaged archives (operator 2).

Both kinds of archive are read from files with random access: one gzip member for each record, or plain
records.  A record counts only if all its checks hold: the member's own CRC and length, the
version line, the header block, a Content-Length that the block fills, the closing blank lines
and, if there is one, the SHA-1 block digest (in base 32 or in hexadecimal, in either case; digests of other
kinds aren't checked).  After a check fails the reader searches for the next place where a
member or version line stands from which a record does pass, goes on there, and logs the bytes
between as quarantined with the reason of the first failure.

Memory holds one record and a buffer of ``CHUNK`` bytes: a plain record's end is looked at before its block is
read, so a damaged Content-Length costs nothing.  Two limits are checks like the others, and what exceeds
them is logged as a gap with its place and length, not lost from sight: a header block has at most
``HEADER_BYTES``, as a lost blank line would else take in all that follows, and a block has at most
``BLOCK_BYTES``, as it must fit in a row.

Defined results: a null or empty archive has no rows, and neither has an empty table; bytes that hold no
record at all are one gap; a record that no next record follows must still be complete.  Every byte of an archive is
in exactly one row.  Archives that are repeated, or share a name, are read each.  Extra columns are ignored.
:func:`pack` leaves out pages with a null id, as their record couldn't be named; repeated pages are a record each.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
HEADER_BYTES, BLOCK_BYTES = 1 << 18, 1 << 30

GZIP = b"\x1f\x8b\x08"
START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d{1,2}\r\n")
VERSION = re.compile(rb"WARC/\d\.\d{1,2}\r\n")
#: A header's name is a token: without this check a stray version line could take in what stands before another record's headers.
NAME = re.compile(r"[!#$%&'*+\-.^_`|~0-9A-Za-z]+")


class Failed(Exception):
    """A check of a record failed; the argument says which."""


class Entry(NamedTuple):
    kind: str  # record or gap
    offset: int
    length: int
    reason: str | None
    headers: dict[str, str] | None
    block: bytes | None


class _Source:
    """A file with random access, read through one buffer."""

    def __init__(self, f: BinaryIO):
        self.f, self.base, self.buf = f, 0, b""
        self.size = f.seek(0, 2)

    def get(self, begin: int, end: int) -> bytes:
        """The bytes from begin to end, or to the file's end."""
        end = min(end, self.size)
        if end - begin > CHUNK:
            self.f.seek(begin)
            return self.f.read(end - begin)
        if begin < self.base or end > self.base + len(self.buf):
            self.f.seek(begin)
            self.base, self.buf = begin, self.f.read(CHUNK)
        return self.buf[begin - self.base : end - self.base]

    def next_start(self, at: int) -> int | None:
        """The first place from ``at`` on where a member or a version line stands."""
        while at < self.size:
            self.get(at, min(at + 1, self.size))
            m = START.search(self.buf, at - self.base)
            if m:
                return self.base + m.start()
            at = max(at + 1, self.base + len(self.buf) - 16) if self.base + len(self.buf) < self.size else self.size
            if at < self.size:
                self.f.seek(at)
                self.base, self.buf = at, self.f.read(CHUNK)
        return None


def parse(raw: bytes) -> tuple[dict[str, str], int]:
    """Headers of the record at the start of raw, and where its block begins."""
    if not VERSION.match(raw):
        raise Failed("no version line")
    headers: dict[str, str] = {}
    last, pos = "", raw.find(b"\r\n") + 2
    while (end := raw.find(b"\r\n", pos, HEADER_BYTES)) != pos:  # an empty line ends the block
        if end < 0:
            raise Failed("header block doesn't end")
        text = raw[pos:end].decode("utf-8", "replace")
        pos = end + 2
        if text[:1] in (" ", "\t") and last:
            headers[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon or not NAME.fullmatch(name.strip()):
            raise Failed("malformed header")
        last = name.strip().lower()
        headers[last] = value.strip()
    if not re.fullmatch(r"\d{1,15}", headers.get("content-length", "")):
        raise Failed("no content length")
    return headers, pos + 2


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def _verify(headers: dict[str, str], block: bytes) -> None:
    kind, _, want = headers.get("warc-block-digest", "").partition(":")
    if kind.strip().lower() in ("sha1", "sha-1"):
        have = hashlib.sha1(block)
        if want.strip().upper().rstrip("=") not in (base64.b32encode(have.digest()).decode(), have.hexdigest().upper()):
            raise Failed("block digest differs")


def _member(src: _Source, at: int) -> Entry:
    z, out, pos = zlib.decompressobj(31), bytearray(), at
    try:
        while not z.eof:
            piece = z.unconsumed_tail or src.get(pos, pos + (1 << 16))
            if not piece:
                raise Failed("member is cut off")
            if not z.unconsumed_tail:
                pos += len(piece)
            out += z.decompress(piece, CHUNK)
            if len(out) > 32 and not VERSION.match(out):
                raise Failed("no version line")
            if len(out) > BLOCK_BYTES + HEADER_BYTES + 8:
                raise Failed("block is too long for a row")
    except zlib.error:
        raise Failed("member is damaged") from None
    end = pos - len(z.unused_data)
    headers, start = parse(bytes(out[:HEADER_BYTES]))
    n = int(headers["content-length"])
    if len(out) != start + n + 4 or out[start + n :] != b"\r\n\r\n":
        raise Failed("content length differs")
    if n > BLOCK_BYTES:
        raise Failed("block is too long for a row")
    block = bytes(memoryview(out)[start : start + n])
    _verify(headers, block)
    return Entry("record", at, end - at, None, headers, block)


def _plain(src: _Source, at: int) -> Entry:
    head = src.get(at, at + (1 << 14))
    headers, start = parse(head if b"\r\n\r\n" in head else src.get(at, at + HEADER_BYTES))
    n = int(headers["content-length"])
    if at + start + n + 4 > src.size:
        raise Failed("record is cut off")
    if src.get(at + start + n, at + start + n + 4) != b"\r\n\r\n":
        raise Failed("content length differs")
    if n > BLOCK_BYTES:
        raise Failed("block is too long for a row")
    block = src.get(at + start, at + start + n)
    _verify(headers, block)
    return Entry("record", at, start + n + 4, None, headers, block)


def salvage(f: BinaryIO) -> Iterator[Entry]:
    """Records and gaps of an archive, in order."""
    src, at, gap, reason = _Source(f), 0, None, None
    while at is not None and at < src.size:
        try:
            got = _member(src, at) if src.get(at, at + 3) == GZIP else _plain(src, at)
        except Failed as e:
            if gap is None:
                gap, reason = at, str(e)
            at = src.next_start(at + 1)
            continue
        if gap is not None:
            yield Entry("gap", gap, at - gap, reason, None, None)
            gap = None
        yield got
        at += got.length
    if gap is not None:
        yield Entry("gap", gap, src.size - gap, reason, None, None)


def record(headers: dict[str, str], block: bytes, compress: bool = True) -> bytes:
    """A record's bytes, with its length and digest."""
    head = {**headers, "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    raw = b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    if not compress:
        return raw
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def rows(entries: Iterator[Entry], archive: str) -> Iterator[tuple]:
    for e in entries:
        h = e.headers or {}
        yield archive, e.kind, e.offset, e.length, e.reason, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), e.block


FIELDS = "archive string, kind string, offset long, length long, reason string, warc_type string, record_id string, target_uri string, block binary"
_ARROW = pa.schema([("archive", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("block", pa.binary())])


def _batches(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in found:
        held.append(r)
        size += len(r[-1] or b"") + 200
        if size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records and gaps of archives, each read by one task; paths: whatever pyarrow's filesystems open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path in b.column("path").to_pylist():
                at, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with at.open_input_file(name) as f:
                    yield from _batches(rows(salvage(f), path))

    if not paths:
        return spark.createDataFrame([], FIELDS)
    src = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return src.mapInArrow(run, FIELDS)


def read_column(archives: DataFrame, name: str = "archive", content: str = "content") -> DataFrame:
    """Records and gaps of archives that stand in a binary column."""
    import io

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = (r for a, c in zip(b.column(0).to_pylist(), b.column(1)) if c.is_valid for r in rows(salvage(io.BytesIO(c.as_buffer())), a))
            yield from _batches(found)

    return archives.select(F.col(name).cast("string"), F.col(content).cast("binary")).mapInArrow(run, FIELDS)


DAMAGES = ("byte", "cut", "junk", "digest", "length")


def damage(data: bytes, kind: str, key: int) -> bytes:
    """The bytes of a record, harmed in one of the ways of DAMAGES."""
    n = len(data)
    if kind == "byte":
        at = 20 + key * 7919 % max(1, n - 28)
        return data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
    if kind == "cut":
        return data[: n // 2]
    if kind == "junk":
        return data + b"\x1f\x8b\x08WARC/1.0\r\n" + bytes(key % 251 for _ in range(40))
    return data


def pack(pages: DataFrame, per_archive: int = 64, harm_every: int = 10) -> DataFrame:
    """Archives ``archive, content`` of pages, ``per_archive`` page ids each, one record in ``harm_every`` harmed.

    The harm depends on the page's id alone.  Every fourth archive is plain, the others have a gzip member a record.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["page_id", "url", "html"], na_position="first", kind="stable")
        k = int(part["archive"].iloc[0])
        out = []
        for key, url, text in zip(part["page_id"], part["url"], part["html"]):
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + (text or "").encode("utf-8", "replace")
            headers = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{key}>", "WARC-Target-URI": re.sub(r"\s", "%20", url or "")}
            h = int.from_bytes(hashlib.blake2b(str(key).encode(), digest_size=6).digest(), "big")
            kind = DAMAGES[h // harm_every % len(DAMAGES)] if h % harm_every == 0 else ""
            data = record(headers, block, compress=False)
            if kind == "digest":
                data = data[:-6] + bytes([data[-6] ^ 1]) + data[-5:]
            elif kind == "length":
                data = re.sub(rb"Content-Length: (\d+)", lambda m: b"Content-Length: %d" % (int(m[1]) + 3), data, count=1)
            if k % 4:
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = z.compress(data) + z.flush()
            out.append(damage(data, kind, h))
        return pd.DataFrame({"archive": [f"pages-{k:06d}.warc" + (".gz" if k % 4 else "")], "content": [b"".join(out)]})

    src = pages.where("page_id is not null").select(F.floor(F.col("page_id") / per_archive).cast("long").alias("archive"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.groupBy("archive").applyInPandas(run, "archive string, content binary")


def salvage_pages(pages: DataFrame, per_archive: int = 64, harm_every: int = 10) -> DataFrame:
    """What the reader gets back of archives packed from pages: ``archive, kind, offset, length, reason, page_id, url, html``."""
    got = read_column(pack(pages, per_archive, harm_every))
    page = F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    body = F.expr("substring(decode(block, 'UTF-8'), instr(decode(block, 'UTF-8'), '\\r\\n\\r\\n') + 4)")
    return got.select("archive", "kind", "offset", "length", "reason", page.alias("page_id"), F.col("target_uri").alias("url"), body.alias("html"))
