"""Data sources of source trees and coverage databases, with partitions planned by folder.

``register(spark)`` makes two formats known: ``source_tree`` (Python files below a folder,
those included that Spark's own readers pass over) and ``coverage_lines`` (executed lines of
coverage databases). The driver lists folders only until there are enough of them to deal
out; tasks walk their folders and read what they find, a bounded batch at a time.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders to deal out, at least, where a tree has so many.
FOLDERS = 64
#: Bytes and rows of a batch.
BATCH_BYTES, BATCH_ROWS = 1 << 23, 1 << 16
# Fixed value: tables of a coverage database; numbits is a bitmap of line numbers, the least significant bit first.
LINES = "select f.path, c.context, b.numbits from line_bits b join file f on f.id = b.file_id left join context c on c.id = b.context_id"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


@dataclass
class Folder(InputPartition):
    """A folder with all that is below it, or with its own files alone."""

    path: str
    deep: bool

    def __init__(self, path: str, deep: bool):
        super().__init__((path, deep))
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    """Deals out the folders below ``path``; ``suffix`` ends the names that are read."""

    suffix = ""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.folders = int(options.get("folders", FOLDERS))

    def partitions(self) -> list[Folder]:
        store, top = opened(self.root)
        if store.get_file_info(top).type == fs.FileType.File:
            return [Folder(top, False)]
        done: list[Folder] = []
        level = [top]
        while level and len(level) + len(done) < self.folders:  # one level deeper
            done += [Folder(f, False) for f in level]
            level = [i.path for f in level for i in store.get_file_info(fs.FileSelector(f)) if i.type == fs.FileType.Directory]
        return done + [Folder(f, True) for f in level]

    def files(self, folder: Folder) -> Iterator[fs.FileInfo]:
        store, _ = opened(self.root)
        if store.get_file_info(folder.path).type == fs.FileType.File:
            yield store.get_file_info(folder.path)
            return
        todo = [folder.path]
        while todo:  # folder by folder, so no list holds the whole tree
            for i in store.get_file_info(fs.FileSelector(todo.pop())):
                if i.type == fs.FileType.Directory and folder.deep:
                    todo.append(i.path)
                elif i.type == fs.FileType.File and i.path.endswith(self.suffix):
                    yield i

    def content(self, path: str) -> bytes:
        store, _ = opened(self.root)
        with store.open_input_stream(path) as f:
            return f.read()


class SourceTreeReader(FolderReader):
    suffix = ".py"

    def __init__(self, options: dict):
        super().__init__(options)
        self.hidden_only = options.get("names", "all") == "passed_over"

    def read(self, folder: Folder) -> Iterator[pa.RecordBatch]:
        _, top = opened(self.root)
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.binary(), pa.timestamp("us", tz="UTC"))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "content", "last_modified"])

        for i in self.files(folder):
            name = i.path[len(top) :].strip("/")
            if self.hidden_only and not any(p[:1] in "._" for p in name.split("/")):
                continue
            rows.append((name, self.content(i.path), i.mtime))
            size += len(rows[-1][1])
            if size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class SourceTree(DataSource):
    """Python files below ``path``: names relative to it, contents, times. ``names`` = ``passed_over``: only those below or with a name that begins with a dot or an underscore."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, content binary, last_modified timestamp"

    def reader(self, schema) -> SourceTreeReader:
        return SourceTreeReader(dict(self.options))


class CoverageReader(FolderReader):
    def read(self, folder: Folder) -> Iterator[pa.RecordBatch]:
        for i in self.files(folder):
            content = self.content(i.path)
            if not content.startswith(b"SQLite format 3\x00"):
                continue
            db = sqlite3.connect(":memory:")
            try:
                db.deserialize(content)
                yield from self._lines(db)
            except sqlite3.DatabaseError:  # another kind of database, or a broken one
                continue
            finally:
                db.close()

    def _lines(self, db: sqlite3.Connection) -> Iterator[pa.RecordBatch]:
        files: list[str] = []
        contexts: list[str | None] = []
        lines: list[int] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(contexts, pa.string()), pa.array(files, pa.string()), pa.array(lines, pa.int32())], names=["context", "file", "line"])

        for path, context, bits in db.execute(LINES):
            found = [8 * i + k for i, byte in enumerate(bits) for k in range(8) if byte >> k & 1]
            files += [path] * len(found)
            contexts += [context or None] * len(found)
            lines += found
            if len(lines) >= BATCH_ROWS:
                yield batch()
                files, contexts, lines = [], [], []
        if lines:
            yield batch()


class CoverageLines(DataSource):
    """(context, file, line) of the coverage databases below ``path``, whatever their names; other files give no rows."""

    @classmethod
    def name(cls) -> str:
        return "coverage_lines"

    def schema(self) -> str:
        return "context string, file string, line int"

    def reader(self, schema) -> CoverageReader:
        return CoverageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)
    spark.dataSource.register(CoverageLines)
