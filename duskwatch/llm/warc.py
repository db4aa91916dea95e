"""WARC files: a writer, and a reader that salvages what it can from damaged ones.

The reader goes from record to record.  A record passes if its gzip member (where there is one) decompresses with the right checksum and length, its version line and headers parse,
its block is as long as ``Content-Length`` says and ends with two line ends, and its ``WARC-Block-Digest``, if it has a SHA-1 one, is right.  After a failed check the
reader searches for the next gzip member or version line that begins a record that passes, goes on from there, and logs the bytes between as a quarantined gap.

Plan: compressed files are read in splits of `split_bytes`.  A record belongs to the split in which its member begins; a split finds its first member by the same search that salvages, and
goes on past its end to the next one, so that what lies between two splits is read or logged once, by the former.  An uncompressed file is one split, since a page may quote a version line.
A task holds one block of the file, and `held` bytes of a member or record at most: what is longer is checked as a stream first, and read again in parts.
Nothing is shuffled but the list of splits.

Defined results
---------------
* Each record and each gap is one row; empty files and folders give none.  A file of noise is one gap.
* A block longer than `held` comes in several rows: the record, then rows of kind ``continuation`` with the same offsets and parts numbered from 1.  No length is refused.
* Several records in one member are all read; of such a member, a part that fails is a gap with its place inside the member, and the records after it are recovered.
* Of a member that does not decompress to the end, or whose checksum is wrong, only records with a right SHA-1 digest are trusted.  The member is a gap all the same, whose `inner_offset` says up to where it was read.
* Headers end within `MOST_HEADERS` bytes, else the record fails.
* The writer gives null bodies and null addresses back as nulls, empty ones as empty, repeated rows as often as they come; ids may be null.
  White space within an address becomes one blank.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, new_path

SPLIT_BYTES = 32 << 20
HELD = 64 << 20
MOST_HEADERS = 64 << 20
BLOCK = 1 << 20
MAGIC = b"\x1f\x8b\x08"
SCHEMA = "path string, kind string, offset long, length long, inner_offset long, part int, warc_type string, target_uri string, headers map<string,string>, body binary, reason string"
_VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
_NAMES = ["path", "kind", "offset", "length", "inner_offset", "part", "warc_type", "target_uri", "headers", "body", "reason"]


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One uncompressed record."""
    own = {**headers, "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in own.items()).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member of its own."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def head(data: bytes, at: int) -> tuple[int, dict[str, str], int] | str:
    """Of the record at a place: where its block begins, its headers, and the length that it says; or what is wrong."""
    m = _VERSION.match(data, at)
    if not m:
        return "version line"
    top = m.end()
    ends = [(k, n) for k, n in ((data.find(b"\r\n\r\n", top - 2), 4), (data.find(b"\n\n", top - 1), 2)) if k >= 0]
    if not ends:
        return "headers"
    stop, skip = min(ends)
    headers: dict[str, str] = {}
    last = ""
    for line in data[top : max(stop, top)].decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
        elif line:
            name, colon, value = line.partition(":")
            if not colon or not name or name != name.strip():
                return "headers"
            last = name
            headers[name] = value.strip()
    size = _header(headers, "content-length")
    if not size.isascii() or not size.isdigit():
        return "content length"
    return stop + skip, headers, int(size)


def _header(headers: dict[str, str], name: str) -> str:
    return {k.lower(): v for k, v in headers.items()}.get(name, "")


def _tail(tail: bytes) -> int:
    """The length of the two line ends after a block; 0 if they aren't there."""
    return 4 if tail == b"\r\n\r\n" else 2 if tail[:2] == b"\n\n" else 0


def _digested(headers: dict[str, str]) -> bool:
    return _header(headers, "warc-block-digest").lower().startswith("sha1:")


def parse(data: bytes, at: int) -> tuple[int, dict[str, str], bytes] | str:
    """The record at a place: its end, headers and block; or what is wrong."""
    got = head(data, at)
    if isinstance(got, str):
        return got
    begin, headers, size = got
    end = begin + size
    block = data[begin:end]
    if len(block) < size:
        return "truncated"
    if not (skip := _tail(data[end : end + 4])):
        return "record end"
    if _digested(headers) and _header(headers, "warc-block-digest").upper() != digest(block).upper():
        return "digest"
    return end + skip, headers, block


class Source:
    """A file read block by block, looking forward only as far as needed."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size = file, file.size()
        self.begin, self.held = 0, b""

    def at(self, offset: int, n: int) -> bytes:
        """`n` bytes from an offset, fewer at the end of the file."""
        stop = min(self.size, offset + n)
        if offset < self.begin or stop > self.begin + len(self.held):
            self.begin, self.held = offset, self.file.read_at(max(0, min(self.size - offset, max(n, BLOCK))), offset)
        return self.held[offset - self.begin : stop - self.begin]

    def find(self, offset: int) -> int | None:
        """The next place from `offset` on where a member or a version line may begin."""
        while offset < self.size:
            part = self.at(offset, BLOCK)
            hits = [k for k in (part.find(MAGIC), part.find(b"WARC/")) if k >= 0]
            if hits:
                return offset + min(hits)
            if offset + len(part) >= self.size:
                return None
            offset += len(part) - 4
        return None

    def inflate(self, offset: int) -> Iterator[tuple[bytes, int, str | None]]:
        """The pieces that the gzip member at a place holds, and how far each was read; the last is empty and says what is wrong, or nothing."""
        d, at = zlib.decompressobj(31), offset
        while not d.eof:
            part = self.at(at, BLOCK // 16)
            if not part:
                yield b"", at, "truncated member"
                return
            rest = part
            while rest and not d.eof:
                before = d.copy()
                try:
                    piece = d.decompress(rest, BLOCK)
                except zlib.error:  # what can be had before it
                    at += len(part) - len(rest)
                    for k in range(len(rest)):
                        try:
                            piece = before.decompress(rest[k : k + 1])
                        except zlib.error:
                            yield b"", at + k, "member"
                            return
                        if piece:
                            yield piece, at + k + 1, None
                    yield b"", at + len(rest), "member"
                    return
                rest = d.unconsumed_tail
                yield piece, at + len(part) - len(rest), None
            at += len(part) - len(d.unused_data)
        yield b"", at, ""

    def member(self, offset: int, held: int) -> tuple[int, int, bytes | None, str]:
        """Of the gzip member at a place: its end (or how far it could be read), the length of what it holds, that itself if it is no longer than `held`, and what is wrong."""
        out, total, at, why = [], 0, offset, ""
        for piece, at, why in self.inflate(offset):  # noqa: B007
            total += len(piece)
            if total <= held:
                out.append(piece)
            else:
                out = []
        return at, total, b"".join(out) if total <= held else None, why or ""


class Flow:
    """Bytes that are not held: those of the file, or those that the gzip member at `start` holds, as far as it can be read.  Going back in a member begins anew."""

    def __init__(self, src: Source, start: int | None, size: int, held: int) -> None:
        self.src, self.start, self.size, self.held = src, start, size, held
        self.begin, self.buf, self.pieces = 0, b"", None

    def get(self, at: int, n: int) -> bytes:
        """`n` bytes from a place on, fewer at the end."""
        stop = min(self.size, at + n)
        if self.start is None:
            return self.src.at(at, n) if n <= BLOCK else b"".join(self.src.at(k, min(BLOCK, stop - k)) for k in range(at, stop, BLOCK))
        if self.pieces is None or at < self.begin:
            self.begin, self.buf, self.pieces = 0, b"", self.src.inflate(self.start)
        parts = [self.buf]
        have = self.begin + len(self.buf)
        while have < stop:
            piece, _, over = next(self.pieces)
            if over is not None:
                break
            have += len(piece)
            if have <= at:  # only passed over
                self.begin, parts = have, []
            else:
                parts.append(piece)
        self.buf = b"".join(parts)
        if at > self.begin:
            self.buf, self.begin = self.buf[at - self.begin :], at
        return self.buf[: stop - at]

    def search(self, at: int) -> int:
        """The next version line from a place on, or the end."""
        while at < self.size:
            part = self.get(at, BLOCK)
            if m := _VERSION.search(part):
                return at + m.start()
            if at + len(part) >= self.size:
                break
            at += len(part) - 12
        return self.size

    def parse(self, at: int) -> tuple[int, dict[str, str], bytes | Iterable[bytes]] | str:
        """The record at a place: its end, headers and block, in parts if it is longer than what is held; or what is wrong."""
        n = 1 << 14
        while True:
            data = self.get(at, n)
            got = head(data, 0)
            if got != "headers" or at + len(data) >= self.size or n >= MOST_HEADERS:
                break
            n *= 4
        if isinstance(got, str):
            return got
        begin, headers, size = at + got[0], got[1], got[2]
        if begin + size > self.size:
            return "truncated"
        if size <= self.held:
            whole = parse(self.get(at, got[0] + size + 4), 0)
            return whole if isinstance(whole, str) else (at + whole[0], headers, whole[2])
        h = hashlib.sha1()
        for k in range(begin, begin + size, BLOCK):
            h.update(self.get(k, min(BLOCK, begin + size - k)))
        if not (skip := _tail(self.get(begin + size, 4))):
            return "record end"
        if _digested(headers) and _header(headers, "warc-block-digest").upper() != ("sha1:" + base64.b32encode(h.digest()).decode()).upper():
            return "digest"
        return begin + size + skip, headers, (self.get(k, min(self.held, begin + size - k)) for k in range(begin, begin + size, self.held))


class Held:
    """As `Flow`, of bytes that are held."""

    def __init__(self, data: bytes) -> None:
        self.data, self.size = data, len(data)

    def search(self, at: int) -> int:
        m = _VERSION.search(self.data, at)
        return m.start() if m else self.size

    def parse(self, at: int) -> tuple[int, dict[str, str], bytes] | str:
        return parse(self.data, at)


def _inside(view: Flow | Held, length: int, sound: bool) -> Iterator[tuple]:
    """Rows (kind, inner offset, length, headers, block, reason) of the records in a member, and of the gaps between them.  Where the member isn't sound, only of records with a digest."""
    p, bad, why = 0, None, ""
    while p < view.size:
        one = view.parse(p)
        if isinstance(one, str) or not (sound or _digested(one[1])):
            if bad is None:
                bad, why = p, one if isinstance(one, str) else "no digest"
            p = view.search(p + 1)
            continue
        if bad is not None and sound:
            yield "gap", bad, p - bad, None, None, why
        bad = None
        yield "record", p, length, one[1], one[2], None
        p = one[0]
    if bad is not None and sound:
        yield "gap", bad, view.size - bad, None, None, why


def read_one(src: Source, at: int, held: int = HELD) -> tuple[int | None, Iterable[tuple], str]:
    """What begins at a place: its end, and rows as those of `_inside`; or no end, the rows that can be trusted all the same, and what is wrong."""
    first = src.at(at, 5)
    if first[:3] == MAGIC:
        end, total, data, why = src.member(at, held)
        rows = _inside(Flow(src, at, total, held) if data is None else Held(data), end - at, not why)
        if why:
            return None, rows, why
        seen: list[tuple] = []
        for r in rows:
            seen.append(r)
            if r[0] == "record":
                return end, chain(seen, rows), ""
        return None, (), seen[0][5] if seen else "empty member"
    if first == b"WARC/":
        got = Flow(src, None, src.size, held).parse(at)
        return (None, (), got) if isinstance(got, str) else (got[0], [("record", 0, got[0] - at, got[1], got[2], None)], "")
    return None, (), "noise"


def salvage(src: Source, start: int, end: int, held: int = HELD) -> Iterator[tuple]:
    """(kind, offset, length, inner offset, headers, block, reason) of the split [start, end): all from its first gzip member up to the first member at or after
    `end`, gaps included.  The first split has all from the beginning.  Only members mark where a split begins, since a page may hold a version line."""
    at, gap, inner_end, why, synced = start, None, None, "", start == 0
    while at < src.size:
        if not synced and at >= end:
            return
        zipped = src.at(at, 3) == MAGIC
        stop, rows, wrong = read_one(src, at, held) if synced or zipped else (None, (), "not a member")
        if stop is None:
            if synced:
                if gap is None:
                    gap = at
                for kind, inner, length, headers, body, reason in rows:
                    inner_end = inner
                    yield kind, at, length, inner, headers, body, reason
            why = why or wrong
            nxt = src.find(at + 1)
            at = src.size if nxt is None else nxt
            continue
        synced = True
        if gap is not None:
            yield "gap", gap, at - gap, inner_end, None, None, why
        gap, inner_end, why = None, None, ""
        if at >= end and zipped:
            return
        for kind, inner, length, headers, body, reason in rows:
            yield kind, at, length, inner, headers, body, reason
        at = stop
    if gap is not None:
        yield "gap", gap, src.size - gap, inner_end, None, None, why


def splits(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, start, stop) of the splits of a file or of all .warc and .warc.gz files below a folder."""
    fs, root = filesystem(path)
    info = fs.get_file_info(root)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    rows = []
    for f in sorted((f for f in found if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz"))), key=lambda f: f.path):
        step = split_bytes if f.path.endswith(".gz") else max(1, f.size)
        rows += [(prefix + f.path, a, min(f.size, a + step)) for a in range(0, f.size, step)]
    df = spark.createDataFrame(rows, "path string, start long, stop long")
    return df.repartition(max(1, min(len(rows), 100_000)), "path", "start")


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, held_bytes: int = HELD) -> DataFrame:
    """Records and quarantined gaps of WARC files, in the columns of `SCHEMA`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start, stop in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, root = filesystem(name)
                with fs.open_input_file(root) as f:
                    held: list[tuple] = []
                    size = 0
                    for kind, offset, length, inner, headers, body, reason in salvage(Source(f), start, stop, held_bytes):
                        for part, piece in enumerate([body] if body is None or isinstance(body, bytes) else body):
                            own = headers if part == 0 else None
                            low = {k.lower(): v for k, v in (own or {}).items()}
                            held.append((name, "continuation" if part else kind, offset, length, inner, part if kind == "record" else None, low.get("warc-type"), low.get("warc-target-uri"), list(own.items()) if own else None, piece, reason))
                            size += len(piece or b"")
                            if size > 4 * BLOCK or len(held) >= 2000:
                                yield _rows(held)
                                held, size = [], 0
                    if held:
                        yield _rows(held)

    return splits(spark, path, split_bytes).mapInArrow(run, SCHEMA)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _KINDS, strict=True)], names=_NAMES)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "2024-01-01T00:00:00Z", damage: Callable[[int | None], bytes] | None = None) -> None:
    """Write pages as records, a gzip member each, one file a task.  `damage` says which bytes to slip in before a page, to rehearse salvage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        temp = f"{root}/_{name}-{uuid.uuid4().hex}"
        out, n = None, 0
        for b in batches:
            for page, url, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = out or fs.open_output_stream(temp)
                raw = (body or "").encode("utf-8", "surrogatepass")
                key = hashlib.md5(f"{page}\n{url}\n".encode() + raw).hexdigest()
                headers = {"WARC-Type": "resource", "WARC-Record-ID": f"<urn:uuid:{uuid.UUID(key)}>", "WARC-Date": date, "Content-Type": "text/html; charset=utf-8"}
                if url is not None:
                    headers["WARC-Target-URI"] = re.sub(r"\s+", " ", url)
                if page is not None:
                    headers["X-Page-ID"] = str(page)
                if body is None:
                    headers["X-No-Body"] = "true"
                if damage:
                    out.write(damage(page))
                out.write(member(record(headers, raw)))
                n += 1
        if out is not None:
            out.close()
            fs.move(temp, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["file", "records"])

    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("u"), F.col(body_col).alias("b")).mapInArrow(run, "file string, records long").write.parquet(f"{path}/_manifest")


def noise(page: int | None) -> bytes:
    """24 bytes that look like a member but are none, before one page in sixteen (by hash)."""
    h = hashlib.md5(str(page).encode()).hexdigest()
    return MAGIC + h[:21].encode() if page is not None and h[0] == "0" else b""


def rehearse(pages: DataFrame) -> DataFrame:
    """Write `pages` with noise between the records and read them back: (kind, page_id, url, html, gap_bytes)."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, damage=noise)
    got = read_warc(spark, path)
    body = F.when(F.col("kind").eqNullSafe("record") & F.col("headers")["X-No-Body"].isNull(), F.decode("body", "UTF-8"))
    return got.select("kind", F.col("headers")["X-Page-ID"].cast("long").alias("page_id"), F.col("target_uri").alias("url"), body.alias("html"), F.when(F.col("kind") == "gap", F.col("length")).alias("gap_bytes"))


SQL = """
SELECT 'record' AS kind, page_id, url, html, CAST(NULL AS BIGINT) AS gap_bytes FROM pages
UNION ALL
SELECT 'gap', NULL, NULL, NULL, 24 FROM pages WHERE substr(md5(CAST(page_id AS VARCHAR)), 1, 1) = '0'
"""
