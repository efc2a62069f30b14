"""Document files as a Spark data source: ``spark.read.format("quirefold")``, batch and stream, and a sink of one file per row.

Partitions are runs of files of bounded size. Types and sizes that are asked for in options are looked at while the folder is listed, so
other files are never opened. With the option ``pushdown``, and ``spark.sql.python.filterPushdown.enabled`` set, filters on type, name
and size of a query do the same; Spark keeps one set of such filters for a loaded frame, so load the folder once for every
branch that filters it differently. The stream goes on from the last file that it took, by time of change and name. Files
are opened through pyarrow's file systems, so the folder may lie in any store that these know.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)

FORMAT = "quirefold"
SCHEMA = "filename string, title string, file_type string, size long, content_hash string, content binary"
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
#: Hadoop's names of stores that pyarrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    scheme, mark, rest = path.rpartition("://")
    if not mark:
        return pafs.LocalFileSystem(), path.removeprefix("file:")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}".replace(" ", "%20"))


@dataclass(frozen=True)
class Listed:
    """A file as it is listed: enough to decide about it without opening it."""

    path: str
    size: int
    changed: int

    @property
    def filename(self) -> str:
        return self.path.rpartition("/")[2]

    @property
    def file_type(self) -> str:
        _, dot, extension = self.filename.rpartition(".")
        return extension.lower() if dot and extension else "unknown"

    @property
    def title(self) -> str:
        return self.filename.rpartition(".")[0] if "." in self.filename else self.filename


def listed(folder: str) -> list[Listed]:
    """Every visible file below the folder, ordered by time of change and path."""
    store, path = file_system(folder)
    found = store.get_file_info(pafs.FileSelector(path, recursive=True))
    files = [Listed(f.path, f.size, f.mtime_ns or 0) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(".")]
    return sorted(files, key=lambda f: (f.changed, f.path))


class Run(InputPartition):
    """Files that one task reads."""

    def __init__(self, files: list[Listed]):
        self.files = files


def runs(files: list[Listed], partition_bytes: int) -> list[Run]:
    out, held, size = [], [], 0
    for file in files:
        if held and size + file.size > partition_bytes:
            out.append(Run(held))
            held, size = [], 0
        held.append(file)
        size += file.size
    return [*out, Run(held)] if held else out


def read_run(folder: str, run: Run) -> Iterator[pa.RecordBatch]:
    store, _ = file_system(folder)
    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for file in run.files:
        with store.open_input_stream(file.path, compression=None) as stream:
            content = stream.read()
        rows.append((file.filename, file.title, file.file_type, len(content), hashlib.sha256(content).hexdigest(), content))
        size += len(content)
        if size >= BATCH_BYTES:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def test_of(condition: Filter):
    """The condition as a test of a listed file, or None if the listing cannot answer it."""
    name = getattr(condition, "attribute", ("",))
    if name in (("file_type",), ("filename",), ("title",), ("size",)):
        own = lambda f: getattr(f, name[0])
        if isinstance(condition, EqualTo):
            return lambda f: own(f) == condition.value
        if isinstance(condition, In):
            return lambda f: own(f) in condition.value
        if name == ("size",) and isinstance(condition, LessThan):
            return lambda f: f.size < condition.value
        if name == ("size",) and isinstance(condition, LessThanOrEqual):
            return lambda f: f.size <= condition.value
    return None


@dataclass(frozen=True)
class Wanted:
    """Types (all if none) and the most bytes of the files that options ask for."""

    types: tuple[str, ...] = ()
    max_bytes: int | None = None

    def __call__(self, file: Listed) -> bool:
        return (not self.types or file.file_type in self.types) and (self.max_bytes is None or file.size <= self.max_bytes)


class FolderReader(DataSourceReader):
    def __init__(self, folder: str, partition_bytes: int, wanted: Wanted = Wanted()):
        self.folder, self.partition_bytes, self.tests = folder, partition_bytes, [wanted]

    def partitions(self) -> list[Run]:
        return runs([f for f in listed(self.folder) if all(test(f) for test in self.tests)], self.partition_bytes)

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        return read_run(self.folder, partition or Run([]))  # without any file Spark reads one partition that is None


class PushingReader(FolderReader):
    """Answers the filters of the query that the listing can answer."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            test = test_of(condition)
            if test is None:
                yield condition
            else:
                self.tests.append(test)


class FolderStreamReader(DataSourceStreamReader):
    """An offset is the time of change and path of the last file taken; files have to be put in place whole, by a rename or an upload."""

    def __init__(self, folder: str, partition_bytes: int, files_per_batch: int, wanted: Wanted = Wanted()):
        self.folder, self.partition_bytes, self.files_per_batch, self.wanted = folder, partition_bytes, files_per_batch, wanted
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        start = self.at or self.initialOffset()
        new = self._between(start, None)
        if self.files_per_batch:
            new = new[:self.files_per_batch]
        if new:
            self.at = {"changed": new[-1].changed, "path": new[-1].path}
        return self.at or start

    def _between(self, start: dict, end: dict | None) -> list[Listed]:
        after = (start["changed"], start["path"])
        return [f for f in listed(self.folder) if self.wanted(f) and (f.changed, f.path) > after and (end is None or (f.changed, f.path) <= (end["changed"], end["path"]))]

    def partitions(self, start: dict, end: dict) -> list[Run]:
        self.at = max(self.at or end, end, key=lambda x: (x["changed"], x["path"]))  # after a restart the query says how far it was
        return runs(self._between(start, end), self.partition_bytes)

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        return read_run(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class FolderWriter(DataSourceArrowWriter):
    """One file per row, under its name; a task that is run again writes the same bytes again. Other columns are not written."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = file_system(self.folder)
        store.create_dir(path, recursive=True)
        names = []
        for batch in iterator:
            for name, content in zip(batch.column("filename").to_pylist(), batch.column("content").to_pylist()):
                if not name or "/" in name or name.startswith("."):
                    raise ValueError(f"no name of a visible file: {name!r}")
                with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                    out.write(content or b"")
                names.append(name)
        return Written(names)


class DocumentFiles(DataSource):
    """Options: ``path``, ``types`` (with commas between), ``maxBytes``, ``pushdown``, ``partitionBytes``, and for streams ``filesPerBatch`` (0: all that are there)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _partition_bytes(self) -> int:
        return int(self.options.get("partitionBytes", PARTITION_BYTES))

    def _wanted(self) -> Wanted:
        most = self.options.get("maxBytes")
        return Wanted(tuple(t.strip().lower() for t in self.options.get("types", "").split(",") if t.strip()), None if most is None else int(most))

    def reader(self, schema) -> FolderReader:
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else FolderReader
        return kind(self.options["path"], self._partition_bytes(), self._wanted())

    def streamReader(self, schema) -> FolderStreamReader:
        return FolderStreamReader(self.options["path"], self._partition_bytes(), int(self.options.get("filesPerBatch", 0)), self._wanted())

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(DocumentFiles)


def read_folder(spark: SparkSession, path: str, **options) -> DataFrame:
    """The documents of a folder as scanned rows; ``types`` and ``maxBytes`` keep other files from being opened."""
    register(spark)
    return spark.read.format(FORMAT).options(**options).load(path)


def stream_folder(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.readStream.format(FORMAT).options(**options).load(path)


def write_folder(docs: DataFrame, path: str) -> None:
    """Write ``content`` of every row as a file ``filename``."""
    register(docs.sparkSession)
    docs.select("filename", "content").write.format(FORMAT).mode("append").save(path)
