"""WARC and ARC files as tables, and tables as WARC files.

A file is read as a stream, in steps: a task holds one record at a time, and
none of its body where bodies aren't asked for. Members of a compressed file can
only be found in order, so a file of more than SPLIT bytes is gone through once
for their offsets alone, without hashing or keeping anything, and what is written
of that is one row for each SPLIT bytes; the ranges then go to as many tasks. A
record that can't be read is tried once more, from its own offset; if that fails
too, the rest of its range is left out, and one row says why.

Streams come from any file system that pyarrow knows. From one that only Spark
knows, its binary reader gives whole files, of 2 GB at most. Writing goes through
a data source whose tasks start a new file when one is large enough.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from cairn.sources.shared import written

SCHEMA = (
    "warc_file string, record_offset long, record_type string, record_id string, target_uri string, warc_date string, payload_digest string, "
    "refers_to_id string, refers_to_uri string, refers_to_date string, http_status int, http_headers array<struct<name:string,value:string>>, "
    "content_type string, content_length long, body binary, error string, hash_matched boolean"
)
COLUMNS = [c.split(" ")[0] for c in SCHEMA.replace("array<struct<name:string,value:string>>", "x").split(", ")]
_ARROW = pa.schema(
    [(c, pa.string()) for c in COLUMNS]
).set(1, pa.field("record_offset", pa.int64())).set(10, pa.field("http_status", pa.int32())).set(11, pa.field("http_headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])))).set(13, pa.field("content_length", pa.int64())).set(14, pa.field("body", pa.binary())).set(16, pa.field("hash_matched", pa.bool_()))


#: Bytes that are read and inflated at a time, and most bytes of a record's head.
STEP, HEAD = 1 << 18, 1 << 20
#: Bytes of a file that one task reads, about; larger bodies than BODY are left out.
SPLIT, BODY = 64 << 20, 1 << 30
GZIP = b"\x1f\x8b"


class Plain:
    """What stands in an uncompressed file from an offset on."""

    def __init__(self, stream: BinaryIO, at: int) -> None:
        self.stream, self.ended = stream, False
        stream.seek(at)

    def more(self) -> bytes:
        got = self.stream.read(STEP)
        self.ended = not got
        return got

    def forward(self, n: int) -> int:
        """Goes over n bytes; how many of them are missing."""
        here = self.stream.tell()
        size = self.stream.seek(0, io.SEEK_END)
        self.stream.seek(min(here + n, size))
        return max(0, here + n - size)


class Member(Plain):
    """What a gzip member holds; end is the offset behind it, once all of it was read."""

    def __init__(self, stream: BinaryIO, at: int) -> None:
        super().__init__(stream, at)
        self.z, self.end, self.fed = zlib.decompressobj(31), at, at

    def more(self) -> bytes:
        while not self.z.eof:
            step = self.z.unconsumed_tail
            if not step:
                step = self.stream.read(STEP)
                self.fed += len(step)
                if not step:
                    raise ValueError("the member breaks off")
            if got := self.z.decompress(step, STEP):
                return got
        self.end, self.ended = self.fed - len(self.z.unused_data), True
        return b""

    def forward(self, n: int) -> int:
        while n > 0 and (got := self.more()):
            n -= len(got)
            self.over = got[len(got) + n :] if n < 0 else b""
        return max(n, 0)


class Buffer:
    """Bytes that come in pieces, to be taken by number or up to a mark."""

    def __init__(self, source: Plain) -> None:
        self.source, self.held, self.at = source, b"", 0

    def _fill(self, n: int) -> bool:
        """Whether n bytes are held, after reading as far as needed."""
        parts, size = [self.held], len(self.held)
        while size < n and not self.source.ended and (got := self.source.more()):
            parts.append(got)
            size += len(got)
        self.held = b"".join(parts) if len(parts) > 1 else parts[0]
        return size >= n

    def starts(self, mark: bytes) -> bool:
        self._fill(len(mark))
        return self.held.startswith(mark)

    def upto(self, mark: bytes) -> bytes | None:
        """What stands before the next mark, which is taken too; None without one in HEAD bytes."""
        size = STEP
        while (end := self.held.find(mark)) < 0:
            if len(self.held) > HEAD or not self._fill(min(len(self.held) + 1, size)):
                return None
        out = self.held[:end]
        self.held = self.held[end + len(mark) :]
        self.at += end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        if not self._fill(n):
            raise ValueError("the record breaks off")
        out, self.held = self.held[:n], self.held[n:]
        self.at += n
        return out

    def drop(self, n: int) -> None:
        """Goes over n bytes without holding them."""
        rest = n - len(self.held)
        if rest <= 0:
            self.held = self.held[n:]
        else:
            self.held, self.source.over = b"", b""
            if self.source.forward(rest):
                raise ValueError("the record breaks off")
            self.held = self.source.over
        self.at += n

    def blank(self) -> bool:
        """Goes over line ends; whether more follows."""
        while self._fill(1) and (plain := self.held.lstrip(b"\r\n")) != self.held:
            self.at += len(self.held) - len(plain)
            self.held = plain
        return bool(self.held)


#: Content encodings that are undone, and zlib's window bits for them; deflate may come without its header. Fixed values.
ENCODINGS = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}


def unpacked(body: bytes, encoding: str | None) -> bytes:
    """A body without its content encoding; what can't be undone comes back as it is."""
    for bits in ENCODINGS.get((encoding or "").strip().lower(), ()):
        try:
            return zlib.decompress(body, bits)
        except zlib.error:
            continue
    return body


def headers(block: bytes) -> list[tuple[str, str]]:
    """Header lines as pairs; folded lines go to the value before them."""
    out: list[tuple[str, str]] = []
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], out[-1][1] + " " + line.strip())
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def dechunked(body: bytes) -> bytes:
    """A chunked body put together; what isn't chunked comes back as it is."""
    parts: list[bytes] = []
    at = 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end > 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return body
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def arc_record(line: bytes) -> tuple[int, dict] | None:
    """(length, row) of an ARC record's first line: URL, address, 14-digit time, type, ..., length."""
    parts = line.decode("utf-8", "replace").split(" ")
    if len(parts) < 5 or not parts[-1].isdigit() or len(parts[2]) != 14 or not parts[2].isdigit():
        return None
    t = parts[2]
    date = f"{t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:]}Z"
    return int(parts[-1]), {"record_type": "warcinfo" if parts[0].startswith("filedesc:") else "arc", "target_uri": parts[0], "warc_date": date, "content_type": parts[3]}


def http_parts(block: bytes) -> dict:
    """Status, headers, type and body of an HTTP response; the body without transfer and content encodings."""
    top, _, body = block.partition(b"\r\n\r\n")
    status = top.split(b"\r\n", 1)[0].split(b" ")
    pairs = headers(top)
    own = {k.lower(): v for k, v in pairs}
    if own.get("transfer-encoding", "").lower() == "chunked":
        body = dechunked(body)
    return {"http_status": int(status[1]) if len(status) > 1 and status[1].isdigit() else None, "http_headers": [{"name": k, "value": v} for k, v in pairs], "content_type": own.get("content-type"), "body": body, "content_encoding": own.get("content-encoding")}


def heads(buffer: Buffer) -> Iterator[tuple[int, dict, int]]:
    """(offset, row, length) of the records that a buffer holds; between two steps the block of that length must be taken or dropped."""
    while buffer.blank():
        at = buffer.at
        if buffer.starts(b"WARC/"):
            top = buffer.upto(b"\r\n\r\n")
            if top is None:
                raise ValueError("no end of a record's head")
            own = {k.lower(): v for k, v in headers(top)}
            row = {
                "record_type": own.get("warc-type"), "record_id": own.get("warc-record-id"), "target_uri": own.get("warc-target-uri", "").strip("<>") or None, "warc_date": own.get("warc-date"), "payload_digest": own.get("warc-payload-digest"),
                "refers_to_id": own.get("warc-refers-to"), "refers_to_uri": own.get("warc-refers-to-target-uri"), "refers_to_date": own.get("warc-refers-to-date"), "content_type": own.get("content-type"),
            }
            yield at, row, int(own.get("content-length", 0))
        else:
            line = buffer.upto(b"\n")
            found = arc_record(line) if line else None
            if found is None:
                raise ValueError("no record")
            yield at, found[1], found[0]


def whole(row: dict, block: bytes, inflate: bool) -> dict:
    """A record's row with what its block holds. Digests are of bodies without transfer encoding; hash_matched says whether a record's own digest is that."""
    row = dict.fromkeys(COLUMNS) | row | {"body": block}
    if row["record_type"] in ("response", "revisit", "arc") and block.startswith(b"HTTP/"):
        row |= http_parts(block)
        encoding = row.pop("content_encoding")
        row["hash_matched"] = row["payload_digest"] in digests(row["body"]) if row["payload_digest"] else None
        row["body"] = unpacked(row["body"], encoding) if inflate else row["body"]
    elif row["record_type"] == "resource":
        row["http_status"] = 200
        row["hash_matched"] = row["payload_digest"] in digests(block) if row["payload_digest"] else None
    return row


def record_rows(buffer: Buffer, base: int, packed: bool, inflate: bool, light: bool) -> Iterator[dict]:
    """The records of a member (or of a file that isn't packed); light: of blocks the HTTP head at most."""
    for at, row, size in heads(buffer):
        row |= {"record_offset": base if packed else base + at, "content_length": size}
        if light or size > BODY:
            top = buffer.take(min(size, 1 << 14))
            buffer.drop(size - len(top))
            http = http_parts(top) if row["record_type"] in ("response", "revisit", "arc") and top.startswith(b"HTTP/") else {}
            named = {k: v for k, v in http.items() if k not in ("body", "content_encoding")}
            yield dict.fromkeys(COLUMNS) | row | named | ({} if light else {"error": f"its {size} bytes are left out"})
        else:
            yield whole(row, buffer.take(size), inflate)


def padded(stream: BinaryIO, at: int) -> int | None:
    """The offset of the next member from at on, over zeros between members; None at the end."""
    stream.seek(at)
    while got := stream.read(STEP):
        if plain := got.lstrip(b"\0"):
            return at + len(got) - len(plain)
        at += len(got)
    return None


def members(data: bytes | memoryview) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each gzip member of a file in memory, or of the whole if it isn't compressed."""
    stream, at = io.BytesIO(data), 0
    if bytes(data[:2]) != GZIP:
        yield 0, bytes(data)
        return
    while (at := padded(stream, at)) is not None:
        member = Member(stream, at)
        yield at, b"".join(iter(member.more, b""))
        at = member.end


def streamed(stream: BinaryIO, start: int = 0, end: int | None = None, inflate: bool = True, light: bool = False) -> Iterator[dict]:
    """The records that begin from start on and before end, where start is the offset of a member (of a record, in a file that isn't compressed)."""
    stream.seek(0)
    if stream.read(2) != GZIP:
        for row in record_rows(Buffer(Plain(stream, start)), start, False, inflate, light):
            if end is not None and row["record_offset"] >= end:
                return
            yield row
        return
    at = start
    while (at := padded(stream, at)) is not None and (end is None or at < end):
        member = Member(stream, at)
        yield from record_rows(Buffer(member), at, True, inflate, light)
        while member.more():
            pass
        at = member.end


def records(data: bytes | memoryview, inflate: bool = True) -> Iterator[dict]:
    """The records of a WARC or ARC file in memory, with the offset of the member they begin in."""
    return streamed(io.BytesIO(data), inflate=inflate)


def ranges(stream: BinaryIO, size: int, split: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of whole members (or records) of about split bytes each. What stands behind a break is in the last one."""
    begin = 0
    try:
        for row in streamed(stream, light=True):
            if row["record_offset"] - begin >= split:
                yield begin, row["record_offset"]
                begin = row["record_offset"]
    except (ValueError, zlib.error):
        pass
    yield begin, size


def digests(body: bytes) -> set[str]:
    """The usual ways to write a payload's digest."""
    sha1 = hashlib.sha1(body)
    return {"sha1:" + sha1.hexdigest(), "sha1:" + base64.b32encode(sha1.digest()).decode(), "sha256:" + hashlib.sha256(body).hexdigest(), "md5:" + hashlib.md5(body).hexdigest()}


def opened(path: str) -> BinaryIO:
    """A file of any store that pyarrow knows, as a stream."""
    store, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return store.open_input_file(name)


def retried(make: Callable[[], BinaryIO], start: int, end: int | None, inflate: bool, light: bool) -> Iterator[dict]:
    """streamed(), which goes on from a failed record's offset with a new stream once; a second failure there ends with a row that says why."""
    at, done, failed_at = start, 0, -1
    while True:
        try:
            with make() as stream:
                skip = done  # records of the member at `at` that are out already
                for row in streamed(stream, at, end, inflate, light):
                    if row["record_offset"] == at and skip:
                        skip -= 1
                        continue
                    at, done = row["record_offset"], done + 1 if row["record_offset"] == at else 1
                    yield row
            return
        except Exception as why:  # whatever a store or a broken file gives
            if (at, done) == failed_at:
                yield dict.fromkeys(COLUMNS) | {"record_offset": at, "error": f"after the record at {at}: {why}"}
                return
            failed_at = (at, done)


def _batches(rows: Iterator[dict], name: str, bodies: bool, types: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0
    for row in rows:
        if types and row["record_type"] not in types and not row["error"]:
            continue
        held.append(row | {"warc_file": name.rsplit("/", 1)[-1], **({} if bodies else {"body": None})})
        size += len(held[-1]["body"] or b"")
        if size > 16 << 20 or len(held) > 5000:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the WARC and ARC files under path; nothing is read of them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,arc}*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length")


def split_ranges(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, first, last) of the ranges of files (path, length) that tasks read; files of more than split bytes are gone through for their members' offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(path) as stream:
                    found = list(ranges(stream, length, split))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["path", "first", "last"])

    large = files.where(F.col("length") > split)
    most = max(1, min(large.count(), 4096))
    cut = large.repartition(most, "path").mapInArrow(run, "path string, first long, last long")
    return files.where(F.col("length") <= split).select("path", F.lit(0).cast("long").alias("first"), F.col("length").alias("last")).unionByName(cut)


def read(spark: SparkSession, path: str, bodies: bool = True, types: tuple[str, ...] = (), inflate: bool = True, light: bool = False, split: int = SPLIT) -> DataFrame:
    """All records of the WARC and ARC files under path.

    Without bodies these are left out before they leave the task; light: blocks
    are gone over unread but for HTTP heads, so that there are no bodies and no
    hash_matched. inflate: undo content encodings.
    """
    try:
        fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    except (ValueError, OSError, pa.ArrowException):
        return _read_whole(spark, path, bodies, types, inflate, light)
    found = written(split_ranges(listed(spark, path), split), "warc-ranges")
    parts = found.agg(F.ceil(F.sum(F.greatest(F.col("last") - F.col("first"), F.lit(1 << 16))) / split)).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = retried(lambda name=name: opened(name), first, last, inflate, light)
                yield from _batches(rows, name, bodies, types)

    return found.repartition(int(min(parts, found.count())) or 1, "path", "first").mapInArrow(run, SCHEMA)


def _read_whole(spark: SparkSession, path: str, bodies: bool, types: tuple[str, ...], inflate: bool, light: bool) -> DataFrame:
    """read() by Spark's binary reader, a file a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,arc}*").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = retried(lambda content=content: io.BytesIO(content.as_buffer()), 0, None, inflate, light)
                yield from _batches(rows, name, bodies, types)

    return files.mapInArrow(run, SCHEMA)


def response_heads(spark: SparkSession, path: str) -> DataFrame:
    """(warc_file, record_offset, target_uri, warc_date, http_status, content_length, error) of responses: where each is, without reading it."""
    return read(spark, path, light=True, types=("response",)).select("warc_file", "record_offset", "target_uri", "warc_date", "http_status", "content_length", "error")


def fetched(wanted: DataFrame, inflate: bool = True) -> DataFrame:
    """The records at given places: wanted (path, record_offset); each is read from its own offset, whatever stands before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _batches(retried(lambda path=path: opened(path), at, at + 1, inflate, False), path, True, ())

    return wanted.select("path", "record_offset").distinct().mapInArrow(run, SCHEMA)


def captures(rows: DataFrame) -> DataFrame:
    """Responses and revisits with status, plain lower-cased type, digest checked against the body, and whether a revisit's record is there."""
    own = rows.where(F.col("record_type").isin("response", "revisit") & F.col("error").isNull())
    mime = F.lower(F.trim(F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1))))
    held = own.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.lit(True).alias("_held")).distinct()
    out = own.join(held, "refers_to_id", "left")
    return out.select(
        "warc_file", "record_offset", "record_type", "record_id", "target_uri", "warc_date", F.col("http_status").alias("status"), F.nullif(mime, F.lit("")).alias("mime"), "payload_digest",
        "hash_matched", F.length("body").cast("long").alias("length"), "refers_to_id", ((F.col("record_type") == "revisit") & F.col("_held").isNull()).alias("orphaned"),
    )


def extracted(rows: DataFrame, most_bytes: int) -> DataFrame:
    """Records of at most so many bytes."""
    return rows.where(F.col("content_length") <= most_bytes)


def record_bytes(row: dict) -> bytes:
    """One record as a gzip member. row: record_type, record_id, target_uri, warc_date, http_status, http_headers, body, refers_to_*."""
    kind, body = row["record_type"], bytes(row.get("body") or b"")
    block = body
    if kind in ("response", "revisit"):
        lines = [f"HTTP/1.1 {row.get('http_status') or 200} OK"] + [f"{h['name']}: {h['value']}" for h in (row.get("http_headers") or []) if h["name"].lower() != "transfer-encoding"]
        block = ("\r\n".join(lines) + "\r\n\r\n").encode() + (b"" if kind == "revisit" else body)
    digest = row.get("payload_digest") or "sha1:" + hashlib.sha1(body).hexdigest()
    head = [("WARC-Type", kind), ("WARC-Record-ID", row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", row.get("warc_date")), ("WARC-Target-URI", row.get("target_uri")), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", row.get("refers_to_id")), ("WARC-Refers-To-Target-URI", row.get("refers_to_uri")), ("WARC-Refers-To-Date", row.get("refers_to_date"))]
    head += [("Content-Type", "application/http; msgtype=response" if kind in ("response", "revisit") else row.get("content_type") or "application/octet-stream"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", mtime=0)


class WarcSink(DataSource):
    """df.write.format("warc_out").option("max_bytes", n).mode("append").save(folder), a folder on any file system that pyarrow knows and all tasks can write to."""

    @classmethod
    def name(cls) -> str:
        return "warc_out"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


@dataclass
class _Files(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    """A task writes hidden files and starts a new one when one is large enough; they get their names when the whole job is committed."""

    def __init__(self, options: dict) -> None:
        self.path, self.most = options["path"], int(options.get("max_bytes", 900_000_000))

    def _store(self) -> tuple[fs.FileSystem, str]:
        path = self.path if "://" in self.path else "file://" + self.path.removeprefix("file:")
        return fs.FileSystem.from_uri(path)

    def write(self, rows) -> WriterCommitMessage:
        store, top = self._store()
        store.create_dir(top, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for row in rows:
            data = record_bytes({k: (v if k != "http_headers" else [h.asDict() for h in v or []]) for k, v in row.asDict().items()})
            if out is None or size + len(data) > self.most:
                if out is not None:
                    out.close()
                names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                # Compressed already: no second compression by the name's ending.
                out, size = store.open_output_stream(f"{top}/_{names[-1]}", compression=None), 0
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return _Files(names)

    def commit(self, messages) -> None:
        store, top = self._store()
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{top}/_{name}", f"{top}/{name}")

    def abort(self, messages) -> None:
        store, top = self._store()
        for m in messages:
            for name in m.names if m else ():
                store.delete_file(f"{top}/_{name}")


def base32_digest(hex_digest: str) -> str:
    """A sha1 in hexadecimal as base32, the other usual form of payload digests."""
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()
