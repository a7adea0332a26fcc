"""Search documents written to files, in batches or from a stream: JSON lines or XML, one file or one for each source.

A task adds documents to a batch, which is delivered when it has enough rows or
bytes; files stay hidden until the whole job is committed, and go if it fails. A
stream's batch has an id: if it comes again, its files are not written twice.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

#: Documents and bytes of a batch, unless told otherwise. Fixed values.
MOST_ROWS, MOST_BYTES = 100, 20_000_000
DONE = "_batches"


@dataclass
class Batcher:
    """Holds documents until there are enough of them, then delivers them together."""

    deliver: Callable[[list[bytes]], None]
    most_rows: int = MOST_ROWS
    most_bytes: int = MOST_BYTES
    held: list[bytes] = field(default_factory=list)
    size: int = 0

    def add(self, document: bytes) -> None:
        if self.held and self.size + len(document) > self.most_bytes:
            self.flush()
        self.held.append(document)
        self.size += len(document)
        if len(self.held) >= self.most_rows:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.deliver(self.held)
            self.held, self.size = [], 0


def _plain(value: object) -> object:
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value if isinstance(value, (str, int, float, bool, dict)) or value is None else str(value)


def as_json(document: dict) -> bytes:
    return (json.dumps(document, ensure_ascii=False) + "\n").encode()


#: Characters that XML can't hold.
_NOT_XML = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def as_xml(document: dict) -> bytes:
    """A document as an index takes it: a field for each value, none for nulls."""
    fields = [(k, x) for k, v in document.items() for x in (v if isinstance(v, list) else [v]) if x is not None]
    shown = lambda x: str(x).lower() if isinstance(x, bool) else json.dumps(x, ensure_ascii=False) if isinstance(x, dict) else str(x)
    return ("<doc>" + "".join(f"<field name={quoteattr(k)}>{escape(_NOT_XML.sub('', shown(x)))}</field>" for k, x in fields) + "</doc>\n").encode()


#: By format: how a document is written, and what stands before and after a file's documents.
FORMATS = {"jsonl": (as_json, b"", b""), "xml": (as_xml, b"<add>\n", b"</add>\n")}


class _File:
    """One hidden output file, begun with its first batch."""

    def __init__(self, store: fs.FileSystem, path: str, head: bytes, packed: bool) -> None:
        self.raw = store.open_output_stream(path, compression=None)
        self.out = gzip.GzipFile(fileobj=self.raw, mode="wb", mtime=0) if packed else self.raw
        self.out.write(head)

    def write(self, documents: list[bytes]) -> None:
        self.out.write(b"".join(documents))

    def close(self, tail: bytes) -> None:
        self.out.write(tail)
        self.out.close()
        if self.out is not self.raw:
            self.raw.close()


@dataclass
class _Written(WriterCommitMessage):
    #: (hidden name, name without a batch's id) of each file.
    files: list[tuple[str, str]]


class _Output:
    def __init__(self, options: dict) -> None:
        self.path, self.by, self.packed = options["path"], options.get("by"), options.get("gzip", "false") == "true"
        self.kind = options.get("kind", "jsonl")
        self.encode, self.head, self.tail = FORMATS[self.kind]
        self.most_rows, self.most_bytes = int(options.get("max_rows", MOST_ROWS)), int(options.get("max_bytes", MOST_BYTES))

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path.removeprefix("file:"))

    def _documents(self, rows: Iterator[Row]) -> Iterator[tuple[str, bytes]]:
        """(name of its file, document); rows come by file."""
        for row in rows:
            document = {k: _plain(v) for k, v in row.asDict().items()}
            name = document.pop(self.by) if self.by else None
            yield re.sub(r"[^\w.-]+", "-", str(name)) if name is not None else "documents", self.encode(document)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        store, top = self._store()
        store.create_dir(top, recursive=True)
        made: list[tuple[str, str]] = []
        now, out, batch = None, None, None
        task, ending = uuid.uuid4().hex, f".{self.kind}{'.gz' if self.packed else ''}"
        try:
            for name, document in self._documents(rows):
                if name != now:
                    if out is not None:
                        batch.flush()
                        out.close(self.tail)
                    made.append((f"_{task}-{len(made)}", f"{name}-{task}{ending}"))
                    now, out = name, _File(store, f"{top}/{made[-1][0]}", self.head, self.packed)
                    batch = Batcher(out.write, self.most_rows, self.most_bytes)
                batch.add(document)
            if out is not None:
                batch.flush()
                out.close(self.tail)
        except BaseException:
            self._delete(made)
            raise
        return _Written(made)

    def _delete(self, files: list[tuple[str, str]]) -> None:
        store, top = self._store()
        for hidden, _ in files:
            if store.get_file_info(f"{top}/{hidden}").type != fs.FileType.NotFound:
                store.delete_file(f"{top}/{hidden}")

    def _all(self, messages: list) -> list[tuple[str, str]]:
        return [f for m in messages if m for f in m.files]


class _BatchWriter(_Output, DataSourceWriter):
    def commit(self, messages) -> None:
        store, top = self._store()
        for hidden, name in self._all(messages):
            store.move(f"{top}/{hidden}", f"{top}/{name}")

    def abort(self, messages) -> None:
        self._delete(self._all(messages))


class _StreamWriter(_Output, DataSourceStreamWriter):
    """A batch's list of files is written before they get their names, so a batch that comes again after a break is finished, and one that was finished is dropped."""

    def commit(self, messages, batchId: int) -> None:
        store, top = self._store()
        mark, own = f"{top}/{DONE}/{batchId}", self._all(messages)
        if store.get_file_info(mark).type == fs.FileType.NotFound:
            store.create_dir(f"{top}/{DONE}", recursive=True)
            with store.open_output_stream(mark + ".new") as out:
                out.write(json.dumps(own).encode())
            store.move(mark + ".new", mark)
            chosen = own
        else:
            with store.open_input_stream(mark) as found:
                chosen = [tuple(x) for x in json.loads(found.read())]
            self._delete([f for f in own if f not in chosen])
        for hidden, name in chosen:
            if store.get_file_info(f"{top}/{hidden}").type != fs.FileType.NotFound:
                store.move(f"{top}/{hidden}", f"{top}/{name}")

    def abort(self, messages, batchId: int) -> None:
        self._delete(self._all(messages))


class DocumentSink(DataSource):
    """df.write.format("documents_out").option("kind", "jsonl" or "xml").option("by", column).mode("append").save(folder), or a stream's writeStream.

    Options: gzip, max_rows and max_bytes of a batch. Rows must come by file:
    write_documents() sees to that.
    """

    @classmethod
    def name(cls) -> str:
        return "documents_out"

    def schema(self) -> str:
        return "id string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BatchWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(dict(self.options))


def write_documents(docs: DataFrame, folder: str, by: str | None = None, parts: int = 16, **options: object) -> None:
    """Writes documents below folder; by: a column whose values name the files, at most parts of them for each value, so a large source is no single task."""
    docs.sparkSession.dataSource.register(DocumentSink)
    if by:
        rest = [c for c in docs.columns if c != by]
        docs = docs.withColumn("_part", F.pmod(F.xxhash64(*rest), F.lit(parts))).repartition(by, "_part").sortWithinPartitions(by, "_part").drop("_part")
    writer = docs.write.format("documents_out").mode("append")
    for k, v in (options | ({"by": by} if by else {})).items():
        writer = writer.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    writer.save(folder)
