"""Files below a folder as a partitioned data source: every file has a row, and so has whatever can't be listed or read (SRC-01).

The driver lists no more folders than it takes to have some for every partition; executors walk what lies below them. Contents are read
in a second step, after the rows were dealt anew, so that one folder with very many files isn't one task's work. Local folders must be
visible to all executors; other stores are reached through ``pyarrow.fs``.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "lumentrace_walk"
WALKED = "path string, modificationTime timestamp, length bigint, error string"
#: Folders that the driver looks for before executors take over, and files read by a task on average.
FOLDERS, FILES_A_TASK = 64, 2_000
#: Bytes of a file at most, and of a batch of contents about.
LARGEST, BATCH_BYTES = 256 << 20, 16 << 20


class _Local:
    """A local folder tree; links to files are files, links to folders aren't followed."""

    def __init__(self, target: str):
        self.top = os.path.abspath(target.removeprefix("file://").removeprefix("file:"))

    def shown(self, path: str) -> str:
        return "file:" + path

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int | None, float | None, str | None]]:
        """(path, whether it is a folder, length, time, error) of what a folder holds; the folder itself, with an error, if it can't be listed."""
        try:
            with os.scandir(folder) as found:
                for e in found:
                    yield self.entry(e.path)
        except OSError as e:
            yield folder, False, None, None, _reason(e)

    def entry(self, path: str) -> tuple[str, bool, int | None, float | None, str | None]:
        try:
            if stat.S_ISDIR(os.lstat(path).st_mode):
                return path, True, None, None, None
            told = os.stat(path)
            kind = None if stat.S_ISREG(told.st_mode) else "is a directory" if stat.S_ISDIR(told.st_mode) else "not a regular file"
            return path, False, told.st_size if kind is None else 0, told.st_mtime, kind
        except OSError as e:
            return path, False, 0, None, _reason(e)

    def read(self, shown: str, start: int = 0, stop: int | None = None) -> bytes:
        with open(shown.removeprefix("file:"), "rb") as f:
            f.seek(start)
            return f.read(-1 if stop is None else stop - start)


class _Store:
    """Any other store that ``pyarrow.fs`` knows by its URI."""

    def __init__(self, target: str):
        from pyarrow import fs

        self.fs, self.top = fs.FileSystem.from_uri(target)
        self.scheme = target.split("://")[0]

    def shown(self, path: str) -> str:
        return f"{self.scheme}://{path}"

    def _told(self, info) -> tuple[str, bool, int | None, float | None, str | None]:
        from pyarrow import fs

        if info.type == fs.FileType.Directory:
            return info.path, True, None, None, None
        return info.path, False, info.size or 0, info.mtime and info.mtime.timestamp(), None if info.type == fs.FileType.File else "no such file"

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int | None, float | None, str | None]]:
        from pyarrow import fs

        try:
            yield from map(self._told, self.fs.get_file_info(fs.FileSelector(folder)))
        except OSError as e:
            yield folder, False, None, None, _reason(e)

    def entry(self, path: str) -> tuple[str, bool, int | None, float | None, str | None]:
        return self._told(self.fs.get_file_info(path))

    def read(self, shown: str, start: int = 0, stop: int | None = None) -> bytes:
        with self.fs.open_input_file(shown.split("://", 1)[1]) as f:
            f.seek(start)
            return f.read(None if stop is None else stop - start)


def _reason(e: OSError) -> str:
    return e.strerror or str(e)


def _tree(target: str) -> _Local | _Store:
    return _Store(target) if "://" in target and not target.startswith("file:") else _Local(target)


def file_range(target: str, path: str, start: int, stop: int) -> bytes:
    """Bytes of a file of ``walk(target)``, in a task."""
    return _tree(target).read(path, start, stop)


class Folders(InputPartition):
    """Folders to walk to the bottom, or with ``deep`` unset one folder's own files."""

    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class WalkSource(DataSource):
    """``spark.read.format("lumentrace_walk").load(target)``; a target that isn't there raises FileNotFoundError."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return WALKED

    def reader(self, schema) -> DataSourceReader:
        return WalkReader(self.options["path"], int(self.options.get("folders", FOLDERS)))


class WalkReader(DataSourceReader):
    def __init__(self, target: str, folders: int):
        self.target, self.folders = target, folders

    def partitions(self) -> list[InputPartition]:
        tree = _tree(self.target)
        _, is_folder, _, _, error = tree.entry(tree.top)
        if error is not None:
            raise FileNotFoundError(f"{self.target}: {error}")
        if not is_folder:
            return [Folders(tree.top, False)]
        open_, own = [tree.top], []
        while open_ and len(open_) + len(own) < self.folders:
            folder = open_.pop(0)
            own.append(folder)
            open_ += sorted(path for path, deeper, *_ in tree.entries(folder) if deeper)
        return [Folders(f, False) for f in own] + [Folders(f, True) for f in open_]

    def read(self, partition: Folders) -> Iterator[tuple]:
        tree = _tree(self.target)
        todo = [partition.folder]
        if partition.folder == tree.top and not tree.entry(tree.top)[1]:
            todo, found = [], [tree.entry(tree.top)]
        else:
            found = None
        while todo or found:
            for path, is_folder, length, when, error in found or tree.entries(todo.pop()):
                if not is_folder:
                    yield tree.shown(path), None if when is None else datetime.fromtimestamp(when, timezone.utc), length, error
                elif partition.deep:
                    todo.append(path)
            found = None


def walk(spark: SparkSession, target: str, folders: int = FOLDERS) -> DataFrame:
    """(path, modificationTime, length, error): a row per file of any name and size, and per folder that can't be listed, whose length is null.

    error is null for files that seem readable. What isn't a regular file, a link without an end among them, has length 0 and an error. A missing target raises.
    """
    spark.dataSource.register(WalkSource)
    return spark.read.format(NAME).option("folders", folders).load(target)


def contents(walked: DataFrame, target: str, largest: int = LARGEST, tasks: int | None = None) -> DataFrame:
    """``walk``'s rows with the files' bytes; content is null and error says why where a file can't be read, or is larger than ``largest``.

    The rows are dealt anew to ``tasks`` tasks, by default one for FILES_A_TASK files, before anything is read.
    """
    n = tasks or max(1, -(-walked.count() // FILES_A_TASK))
    rows = walked.repartition(n, "path") if n > 1 else walked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _tree(target)
        for b in batches:
            begun, size, got, errors = 0, 0, [], []
            lengths, known = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, path in enumerate(b.column(0).to_pylist()):
                data, error = None, known[i]
                if error is None and lengths[i] > largest:
                    error = f"larger than {largest} bytes"
                elif error is None:
                    try:
                        data = tree.read(path)
                    except OSError as e:
                        error = _reason(e)
                got.append(data)
                errors.append(error)
                size += len(data or b"")
                if size >= BATCH_BYTES or i == b.num_rows - 1:
                    part = b.slice(begun, len(got))
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(got, pa.binary()), pa.array(errors, pa.string())], names=["path", "modificationTime", "length", "content", "error"])
                    begun, size, got, errors = i + 1, 0, [], []

    return rows.select("path", "modificationTime", "length", "error").mapInArrow(run, "path string, modificationTime timestamp, length bigint, content binary, error string")


def is_file(walked: DataFrame) -> DataFrame:
    """Rows of files, readable or not."""
    return walked.where(F.col("length").isNotNull())
