"""Trees of text files as Spark formats: ``siftstone_notes`` reads one, whole or as files arrive; ``siftstone_tree`` writes one.

Both go through Arrow's file systems (local and mounted folders, and stores that it knows by their URI). A listing, paths
and sizes, is made where the plan is made, as any listing of files is; contents are read and written by the tasks.

Reading: files are dealt into partitions of about ``BYTES`` or ``FILES``. Conditions on the path (equal, one of, begins or
ends with) are taken by the reader, so what they rule out isn't opened. Writing: a task writes its files into a folder of
its own below the tree; when all tasks are done their files are moved into place, and if any fails, or two rows have one
path, that folder goes and the tree is as it was. A path that isn't relative and safe fails its task.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "name string, path string, text string"
BYTES, FILES = 32_000_000, 1_000
#: Below a tree while it is written.
STAGED = ".siftstone-staged"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there."""
    return fs.FileSystem.from_uri(root) if ":" in root.split("/")[0] else (fs.LocalFileSystem(), posixpath.abspath(root))


@dataclass(frozen=True)
class Listed:
    """A file: its path below the root, its bytes, and when it was changed last (ns)."""

    path: str
    size: int
    at: int


def listed(root: str, pattern: str = "*") -> list[Listed]:
    """Files whose names match, by path; folders and files that begin with a dot are left out."""
    store, base = opened(root)
    if store.get_file_info(base).type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if store.get_file_info(base).type == fs.FileType.File:
        info = store.get_file_info(base)
        return [Listed("", info.size, info.mtime_ns or 0)]
    found = []
    for info in store.get_file_info(fs.FileSelector(base, recursive=True)):
        path = posixpath.relpath(info.path, base)
        if info.type == fs.FileType.File and fnmatchcase(info.base_name, pattern) and not any(p.startswith(".") for p in path.split("/")):
            found.append(Listed(path, info.size, info.mtime_ns or 0))
    return sorted(found, key=lambda x: x.path)


@dataclass
class Files(InputPartition):
    root: str
    paths: list[str] = field(default_factory=list)


def dealt(root: str, files: Iterable[Listed], most_bytes: int = BYTES, most_files: int = FILES) -> list[Files]:
    """Partitions of files, in order; a larger file is alone."""
    out, size = [], 0
    for f in files:
        if not out or len(out[-1].paths) >= most_files or size + f.size > most_bytes:
            out.append(Files(root))
            size = 0
        out[-1].paths.append(f.path)
        size += f.size
    return out


def rows_of(part: Files) -> Iterator[pa.RecordBatch]:
    """A batch for each file; what isn't UTF-8 in it is replaced."""
    store, base = opened(part.root)
    for path in part.paths:
        place = posixpath.join(base, path) if path else base
        with store.open_input_stream(place) as f:
            text = f.read().decode("utf-8", "replace")
        name = posixpath.basename(place)
        yield pa.RecordBatch.from_pydict({"name": [name.rpartition(".")[0] or name], "path": [path or name], "text": [text]})


class NotesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.pattern = options["path"], options.get("pattern", "*")
        self.bytes, self.files = int(options.get("bytes", BYTES)), int(options.get("files", FILES))
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute == ("path",):
                self.wanted.append(f)
            else:
                yield f

    def _holds(self, path: str) -> bool:
        test = {EqualTo: lambda f: path == f.value, In: lambda f: path in f.value, StringStartsWith: lambda f: path.startswith(f.value), StringEndsWith: lambda f: path.endswith(f.value)}
        return all(test[type(f)](f) for f in self.wanted)

    def partitions(self) -> Sequence[InputPartition]:
        return dealt(self.root, (f for f in listed(self.root, self.pattern) if self._holds(f.path or posixpath.basename(self.root))), self.bytes, self.files) or [Files(self.root)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return rows_of(partition)


class NotesStream(DataSourceStreamReader):
    """Files in the order in which they were changed; one must be whole when it appears, as one that is moved in is."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.pattern = options["path"], options.get("pattern", "*")

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((f.at, f.path) for f in listed(self.root, self.pattern)), default=(-1, ""))
        return {"at": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = (start["at"], start["path"]), (end["at"], end["path"])
        return dealt(self.root, sorted((f for f in listed(self.root, self.pattern) if low < (f.at, f.path) <= high), key=lambda f: (f.at, f.path)))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return rows_of(partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class NotesSource(DataSource):
    """Options: path; pattern, of names; bytes and files, of a partition."""

    @classmethod
    def name(cls) -> str:
        return "siftstone_notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> NotesReader:
        return NotesReader(dict(self.options))

    def streamReader(self, schema: StructType) -> NotesStream:
        return NotesStream(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    folder: str
    paths: list[str]


def safe(path: str | None) -> str:
    """A relative path that doesn't climb, with slashes; any other raises ValueError."""
    plain = (path or "").replace("\\", "/")
    if not plain or plain.startswith("/") or plain[1:2] == ":" or ".." in plain.split("/") or plain.split("/")[0] == STAGED:
        raise ValueError(f"unsafe path {path}")
    return posixpath.normpath(plain)


class TreeWriter(DataSourceWriter):
    """Made where the plan is made, which opens the folder that tasks write below; a task that finds it closed leaves nothing."""

    def __init__(self, root: str) -> None:
        self.root, self.token = root, uuid.uuid4().hex
        store, base = opened(root)
        self.existed = store.get_file_info(base).type == fs.FileType.Directory
        store.create_dir(self._staged(), recursive=True)
        store.open_output_stream(self._staged("open")).close()

    def _staged(self, *below: str) -> str:
        return posixpath.join(opened(self.root)[1], STAGED, self.token, *below)

    def _open(self) -> bool:
        return opened(self.root)[0].get_file_info(self._staged("open")).type == fs.FileType.File

    def _is_dir(self, path: str) -> bool:
        return opened(self.root)[0].get_file_info(path).type == fs.FileType.Directory

    def write(self, iterator: Iterator[Row]) -> Written:
        store, _ = opened(self.root)
        folder, paths = self._staged(str(TaskContext.get().taskAttemptId())), []
        try:
            for row in iterator:
                path = safe(row["path"])
                if not self._open():
                    raise RuntimeError("the write was given up")
                place = posixpath.join(folder, path)
                store.create_dir(posixpath.dirname(place), recursive=True)
                with store.open_output_stream(place) as f:
                    f.write((row["text"] or "").encode())
                paths.append(path)
            if not self._open():
                raise RuntimeError("the write was given up")
        except BaseException:
            if self._is_dir(folder):
                store.delete_dir(folder)
            self._clear()
            raise
        return Written(folder, paths)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = opened(self.root)
        moves = [(m.folder, path) for m in messages if m for path in m.paths]
        if len({path for _, path in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("two rows have one path")
        for folder in sorted({posixpath.dirname(path) for _, path in moves if "/" in path}):
            store.create_dir(posixpath.join(base, folder), recursive=True)
        for folder, path in moves:
            store.move(posixpath.join(folder, path), posixpath.join(base, path))
        self.existed = True
        self._close()

    def abort(self, messages: list[Written | None]) -> None:
        self._close()

    def _close(self) -> None:
        """Nothing is written below the folder any more, and it goes."""
        store, _ = opened(self.root)
        if self._is_dir(self._staged()):
            store.delete_dir(self._staged())
        self._clear()

    def _clear(self) -> None:
        """Remove folders that were made for the write and are empty."""
        store, base = opened(self.root)
        for folder in (self._staged(), posixpath.join(base, STAGED), *(() if self.existed else (base,))):
            if self._is_dir(folder) and not self._open() and not store.get_file_info(fs.FileSelector(folder)):
                store.delete_dir(folder)


class TreeSource(DataSource):
    """Rows (path, text) as files below the option path; files that are there and not written stay."""

    @classmethod
    def name(cls) -> str:
        return "siftstone_tree"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.conf.set(PUSHDOWN, "true")
    for source in (NotesSource, TreeSource):
        spark.dataSource.register(source)


def read_notes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(name, path, text) of the text files below a folder, or of one file."""
    register(spark)
    return spark.read.format(NotesSource.name()).option("pattern", pattern).load(root)


def write_tree(files: DataFrame, root: str) -> None:
    """Write (path, text) rows as files below a folder, by the tasks; all of them or none."""
    register(files.sparkSession)
    files.select("path", "text").write.format(TreeSource.name()).mode("append").save(root)
