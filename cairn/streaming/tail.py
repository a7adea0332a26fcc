"""A stream of the lines that are appended to growing files.

The offset of the stream is a byte position for each file, always behind a line's
end, so a line that is still being written is held back until it is whole, and a
stream that starts again goes on where it stopped. A file that became shorter is
read from its start. Large appends are read in several tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, position long, line string"
_ARROW = pa.schema([("path", pa.string()), ("position", pa.int64()), ("line", pa.string())])
#: Bytes that one task reads, about; bytes that are read at a time; lines that leave a task at a time.
SPLIT, STEP, LINES = 32 << 20, 1 << 20, 50_000


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def last_line_end(stream: pa.NativeFile, start: int, end: int) -> int:
    """The offset behind the last line end between start and end; start if there is none. Reads backwards, no more than the line that isn't whole."""
    hi = end
    while hi > start:
        lo = max(start, hi - STEP)
        stream.seek(lo)
        found = stream.read(hi - lo).rfind(b"\n")
        if found >= 0:
            return lo + found + 1
        hi = lo
    return start


def lines(stream: pa.NativeFile, first: int, last: int, end: int, whole: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin in [first, last); a line may go on up to end. whole: an offset where a line begins for sure."""
    at = first
    if first > whole:  # the line over the border belongs to the range before: it began before first unless a line ends just there
        stream.seek(first - 1)
        rest, at = b"", first - 1
        while at < end:
            step = stream.read(min(STEP, end - at))
            cut = step.find(b"\n")
            if cut >= 0:
                at += cut + 1
                break
            at += len(step)
    stream.seek(at)
    rest, begin = b"", at
    while begin < last and (step := stream.read(min(STEP, end - at))):
        at += len(step)
        parts = (rest + step).split(b"\n")
        rest = parts.pop()
        for line in parts:
            if begin >= last:
                return
            yield begin, line
            begin += len(line) + 1


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    last: int
    end: int
    whole: int


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.glob, self.split = options["path"], options.get("glob", "*"), int(options.get("split", SPLIT))
        self.most = int(options.get("max_bytes", 1 << 62))
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        """The ends of the last whole lines. Files whose size hasn't changed aren't opened; with max_bytes a batch reads so many bytes of a file at most."""
        store, top = store_of(self.path)
        found = [f for f in store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)) if f.is_file and fnmatch(f.base_name, self.glob)]
        for f in found:
            before = self.ends.get(f.path, 0)
            start = before if f.size >= before else 0
            if f.size == start:
                continue
            with store.open_input_file(f.path) as stream:
                end = last_line_end(stream, start, min(f.size, start + self.most))
                if end == start and f.size > start + self.most:  # a line longer than max_bytes
                    end = last_line_end(stream, start, f.size)
                self.ends[f.path] = end
        return {"files": json.dumps(self.ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        self.ends = {**new, **{k: v for k, v in self.ends.items() if v > new.get(k, -1)}}
        out = []
        for path, stop in sorted(new.items()):
            begin = old.get(path, 0) if old.get(path, 0) <= stop else 0
            out += [_Range(path, a, min(a + self.split, stop), stop, begin) for a in range(begin, stop, self.split)]
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        held: list[tuple[int, bytes]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part.path] * len(held), pa.string()), pa.array([p for p, _ in held], pa.int64()), pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for _, x in held], pa.string())], schema=_ARROW)

        with store.open_input_file(part.path) as stream:
            size = 0
            for item in lines(stream, part.first, part.last, part.end, part.whole):
                held.append(item)
                size += len(item[1])
                if len(held) >= LINES or size > STEP * 8:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """spark.readStream.format("tail").option("path", folder).option("glob", "*.log").load(): (path, position, line)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def tailed(spark: SparkSession, folder: str, glob: str = "*", split: int = SPLIT) -> DataFrame:
    """The lines of the files under folder as a stream, those that are there and those that come."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("path", folder).option("glob", glob).option("split", split).load()
