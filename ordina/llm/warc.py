"""WARC archives: a writer with revisit records and a reader that salvages what it can.

The writer uses Spark's own text sink for the bytes of the gzip members, so its
commit protocol covers lost executors and repeated tasks, and any file system that
Spark reaches will do.  The reader checks every record (lengths, the closing line
ends, digests); where a check fails it searches for the next valid gzip member or
version line, goes on there, and reports the bytes in between.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordina.llm.common import materialise, named

VERSION = b"WARC/1.1\r\n"
MEMBER = b"\x1f\x8b\x08"
#: Records in a file: a file is what one task reads.
RECORDS_PER_FILE = 2000
#: Bytes of a file that come to the parser at once, and that a member gives at once.
RANGE, STEP = 8 << 20, 1 << 16
#: The longest header, and the longest block of a record: more doesn't fit a row.
HEADER, LARGEST = 1 << 20, 1 << 30
#: Bytes of a member that stay at hand, to search them for another member should it prove damaged.
KEPT = 64 << 20
#: Digests that go to the writing pass as a broadcast (some 40 bytes each); more are joined by shuffle.
BROADCAST_DIGESTS = 200_000
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: str, url: str | None, payload: bytes, digest: bytes, refers_to: str | None, date: str) -> bytes:
    """One record: a response with the payload, or a revisit that has the HTTP header only. digest: the payload's SHA-1."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <urn:ordina:page:%s>" % page.encode(), b"WARC-Date: " + date.encode()]
    if url is not None:
        fields.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode()))
    fields += [b"WARC-Payload-Digest: sha1:" + base64.b32encode(digest), b"WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest())]
    if refers_to is not None:
        fields += [b"WARC-Refers-To: <urn:ordina:page:%s>" % refers_to.encode(), b"WARC-Profile: " + PROFILE]
    fields += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return VERSION + b"\r\n".join(fields) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A record as a gzip member of its own; the last byte is 0, if need be of an empty member that follows."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + member(b"")  # the last byte holds the size's highest bits


class Window:
    """Bytes that arrive in pieces, by their offset in the whole; ``total`` is the whole's size, if it is known."""

    def __init__(self, pieces: Iterable[bytes], total: int | None = None) -> None:
        self.pieces, self.data, self.base, self.total = iter(pieces), bytearray(), 0, total
        self.clear = (0, 0)  # no blank line starts in this range

    def fill(self, end: int) -> bool:
        """Whether the bytes up to ``end`` are there."""
        while self.base + len(self.data) < end:
            if (piece := next(self.pieces, None)) is None:
                return False
            self.data += piece
        return True

    def drop(self, at: int) -> None:
        del self.data[: at - self.base]
        self.base = at

    def slice(self, a: int, b: int) -> bytes:
        return bytes(self.data[a - self.base : b - self.base])

    def blank_line(self, at: int) -> int:
        """Where the next blank line starts, -1 if none does within HEADER bytes."""
        begin = max(at, self.clear[1]) if self.clear[0] <= at <= self.clear[1] else at
        first = min(at, self.clear[0]) if begin != at else at
        while begin < at + HEADER:
            there = self.fill(begin + STEP)
            if (found := self.data.find(b"\r\n\r\n", begin - self.base, at + HEADER - self.base)) >= 0:
                self.clear = (first, found + self.base)
                return found + self.base
            begin = max(begin, min(at + HEADER, self.base + len(self.data)) - 3)
            self.clear = (first, begin)
            if not there:
                return -1
        return -1

    def next_mark(self, at: int) -> int:
        """Where the next member or version line may start; -1 if none does. Forgets what comes before."""
        while True:
            self.fill(at + STEP)
            if found := _MARKS.search(self.data, at - self.base):
                return found.start() + self.base
            at = max(at, self.base + len(self.data) - 9)  # the longest mark has 10 bytes
            self.drop(at)
            if not self.fill(at + 10):
                return -1


#: A member's fixed header with the values that its last two bytes may have, or a version line.
_MARKS = re.compile(re.escape(MEMBER) + rb"[\x00-\x1f].{4}[\x00\x02\x04][\x00-\x0d\xff]|WARC/\d\.\d\r\n", re.S)


def digest_of(said: str) -> tuple[str, bytes] | None:
    """Algorithm and bytes of a digest field in hex or base32 of any case; None for forms not known here, which aren't checked."""
    name, _, text = said.strip().partition(":")
    name = name.strip().lower().replace("-", "")
    size = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}.get(name)
    text = text.strip()
    if size and re.fullmatch(rf"[0-9a-fA-F]{{{2 * size}}}", text):
        return name, bytes.fromhex(text)
    try:
        found = base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except (binascii.Error, ValueError):
        return None
    return (name, found) if len(found) == size else None


def _agrees(said: str, data: bytes) -> bool | None:
    """Whether the data have that digest; None if it can't be told."""
    return None if (d := digest_of(said)) is None else hashlib.new(d[0], data).digest() == d[1]


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The body of an HTTP message, else the whole block."""
    http = fields.get("content-type", "application/http").lower().startswith("application/http")
    return block.partition(b"\r\n\r\n")[2] if http else block


def _parse(w: Window, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """Headers, block and end of the record at that offset, or what is wrong with it."""
    w.fill(at + 10)
    if not re.match(rb"WARC/\d\.\d\r\n", w.slice(at, at + 10)):
        return "no version line"
    if (stop := w.blank_line(at)) < 0:
        return "header is cut off"
    fields, last = {}, None
    for line in w.slice(at, stop).split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:  # a folded line goes on with the value before
            fields[last] = f"{fields[last]} {line.strip().decode('utf-8', 'replace')}".strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return "header line without a colon"
        last = name.strip().lower().decode("latin-1")
        fields[last] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,15}", fields.get("content-length", "")):
        return "no content length"
    start, size = stop + 4, int(fields["content-length"])
    if size > LARGEST:
        return "block is too long for a row"
    if (w.total is not None and start + size + 4 > w.total) or not w.fill(start + size + 4) or w.slice(start + size, start + size + 4) != b"\r\n\r\n":
        return "length doesn't end at a record's end"
    block = w.slice(start, start + size)
    whole = _agrees(fields.get("warc-block-digest", ""), block)
    if whole is False:
        return "block digest differs"
    if whole is None and fields.get("warc-type") == "response" and _agrees(fields.get("warc-payload-digest", ""), payload_of(fields, block)) is False:
        return "payload digest differs"
    return fields, block, start + size + 4


class Member:
    """The content of the gzip member at an offset, as pieces. Afterwards ``end`` is where it ends, or ``wrong`` says why it doesn't."""

    def __init__(self, w: Window, at: int) -> None:
        self.w, self.at, self.end, self.wrong = w, at, None, ""

    def __iter__(self) -> Iterator[bytes]:
        z, at, step, some = zlib.decompressobj(31), self.at, 512, False
        while not z.eof:
            if not some and at - self.at > STEP:
                self.wrong = "member has no content"
                return
            if at - self.w.base > 2 * KEPT:
                self.w.drop(at - KEPT)
            self.w.fill(at + step)
            if not (piece := self.w.slice(at, at + step)):
                self.wrong = "member is cut off"
                return
            before, whole = z.copy(), piece
            try:
                out = z.decompress(piece, 16 * STEP)
                some = some or bool(out)
                while z.unconsumed_tail:
                    yield out
                    before, piece = z.copy(), z.unconsumed_tail
                    out = z.decompress(piece, 16 * STEP)
                yield out
            except zlib.error as e:
                self.wrong = f"member: {e}"
                try:  # what can be read before the damage
                    for i in range(len(piece)):
                        yield before.decompress(piece[i : i + 1])
                except zlib.error:
                    pass
                return
            at += len(whole)
            step = min(2 * step, STEP)
        self.end = at - len(z.unused_data)


def _sequence(w: Window, members: bool) -> Iterator[tuple]:
    at, gap, reason = 0, None, ""
    while w.fill(at + 1):
        if members and w.fill(at + 3) and w.slice(at, at + 3) == MEMBER:
            content = Member(w, at)
            for kind, start, end, _, _, *rest in _sequence(Window(content), False):
                if not (kind == "gap" and content.wrong and start == 0):  # a member that gives nothing is part of a gap of the file
                    yield kind, at, None, start, end, *rest
            got = content.wrong if content.end is None else (None, None, content.end)
        else:
            got = _parse(w, at)
        if isinstance(got, str):
            if gap is None and at >= w.base and w.slice(at, at + 1) in (b"\r", b"\n"):
                at += 1
            else:
                if gap is None:
                    gap, reason = at, got
                if (at := w.next_mark(max(at + 1, w.base))) < 0:
                    break
            w.drop(at)
            continue
        if gap is not None:
            yield "gap", gap, at, None, None, reason
            gap = None
        yield ("member", at, got[2], None, None) if got[0] is None else ("record", at, got[2], None, None, got[0], got[1])
        at = got[2]
        w.drop(at)
    if gap is not None:
        yield "gap", gap, w.base + len(w.data), None, None, reason


def salvage(pieces: Iterable[bytes], total: int | None = None) -> Iterator[tuple]:
    """What a file holds, from its bytes in pieces: (kind, start, end, inner start, inner end, ...).

    Kinds are 'record' (with headers and block), 'gap' (with a reason) and
    'member'.  Together their ranges from start to end cover the whole file, but for
    line ends between records, which are padding.  A record or a gap inside a gzip
    member has the member's start, no end, and its place in the member's content;
    a member may hold any number of records.  From a damaged member the records
    before the damage are read, and the member is part of a gap; what is at hand of
    it, KEPT bytes at least, is searched for the next.  No more is held than that,
    a record and a piece.
    """
    return _sequence(Window(pieces, total), True)


_READ = pa.schema(
    [("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("inner_start", pa.int64()), ("inner_end", pa.int64()), ("reason", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)
_READ_TYPE = "path string, kind string, start bigint, end bigint, inner_start bigint, inner_end bigint, reason string, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes bigint, payload binary"


def _rows(path: str, pieces: Iterable[bytes], total: int, payloads: bool) -> Iterator[tuple]:
    for kind, start, end, a, b, *rest in salvage(pieces, total):
        if kind != "record":
            yield path, kind, start, end, a, b, rest[0] if rest else None, None, None, None, None, None, None, None
            continue
        fields, block = rest
        payload = payload_of(fields, block)
        said = digest_of(fields.get("warc-payload-digest", ""))
        digest, size = base64.b32encode(said[1]).decode() if said and said[0] == "sha1" else None, len(payload)
        if fields.get("warc-type") == "revisit":  # the HTTP header has the length of the full payload
            m = re.search(rb"(?im)^content-length:\s*(\d+)", block.partition(b"\r\n\r\n")[0])
            size = int(m[1]) if m else None
        yield path, kind, start, end, a, b, None, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), digest, size, payload if payloads else None


def _reader(payloads: bool) -> Callable:
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
        for batch in batches:
            for path, length, part in zip(*(batch.column(c) for c in ("path", "length", "part")), strict=True):
                yield path.as_py(), length.as_py(), part.as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

        for (path, length), parts in groupby(ranges(batches), lambda r: r[:2]):
            for row in _rows(path, (p for _, _, p in parts), length, payloads):
                rows.append(row)
                held += len(row[-1] or b"") + 200
                if held > 8_000_000:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of kind 'record', 'member' and 'gap', as ``salvage`` says, for each file; a gap has a reason.

    A file, at most the 2 GB that Spark's binary source reads, goes through one
    task; it comes to the parser in ranges, so that Python holds a range and a
    record of it.  payload_bytes and payload_digest are those of the full payload,
    for revisits too; the digest, bare upper-case base32, is null unless the record
    names a SHA-1.  Digests in forms not known aren't checked; a payload's is
    checked where no block digest was.  An empty file has no rows.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(RANGE).cast("bigint"))).alias("at")
    parts = files.select("path", "length", "content", starts).select("path", "length", F.substring(F.col("content"), F.col("at").cast("int") + 1, F.lit(RANGE)).alias("part"))
    return parts.mapInArrow(_reader(payloads), _READ_TYPE)


def with_first(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """page, url, payload, digest, first: of pages of equal payloads the smallest id if the row isn't that one, else null."""
    read = pages.select(named(id_col).alias("page"), named(url_col).alias("url"), F.coalesce(named(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    read = read.withColumn("digest", F.unhex(F.sha1("payload")))
    groups = read.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    groups = materialise(groups.select("digest", "first"), "payloads")
    small = groups.count() <= BROADCAST_DIGESTS
    joined = read.join(F.broadcast(groups) if small else groups, "digest", "left")
    return joined.withColumn("first", F.when(F.col("page").eqNullSafe(F.col("first")) | (F.length("payload") < least_bytes), None).otherwise(F.col("first")))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes a record for each row, a gzip member each, to WARC files in the folder ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with the
    smallest id becomes a response and the others revisit it.  A null payload is an
    empty one; a null url is left out; a null id is written as an empty name, never
    is the response that others refer to, and reads back as null.  Rows that share
    the smallest id and the payload are responses all.  Other columns are not read.
    """
    rows = with_first(pages, id_col, url_col, payload_col, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                some = batch.slice(part, 256)
                cols = [some.column(c).to_pylist() for c in ("page", "url", "payload", "digest", "first")]
                # The sink ends each row by a zero byte: the member's last.
                yield pa.record_batch([pa.array([member(record(p or "", u, b, d, f, date))[:-1] for p, u, b, d, f in zip(*cols, strict=True)], pa.binary())], names=["value"])

    text = rows.select(F.col("page").cast("string").alias("page"), "url", "payload", "digest", F.col("first").cast("string").alias("first")).mapInArrow(run, "value binary")
    text.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)
