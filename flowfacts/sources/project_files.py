"""A data source for the files of a project tree: batches read on executors, and a stream in which an edited file comes again.

Spark's own file source remembers the paths it has read, so a file written anew under its path begins no batch, and it passes
over names that begin with an underscore. Here a batch is the files whose time of change lies between two offsets.
"""

from __future__ import annotations

import fnmatch
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, changed long, length long, content binary"
#: A partition holds files of up to so many bytes, or one larger file.
BYTES = 32 << 20
#: Files that changed in the last seconds wait for the next batch: more may be written at the same time.
SETTLE = 1.0


@dataclass
class Part(InputPartition):
    files: list[tuple[str, int, int]]


def _open(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in root:
        root = f"file://{root.removeprefix('file:')}"
    return pyarrow.fs.FileSystem.from_uri(root)


def listed(root: str, pattern: str) -> list[tuple[str, int, int]]:
    """(path, time of change in nanoseconds, length) of the matching files below root, by name."""
    system, path = _open(root)
    found = system.get_file_info(pyarrow.fs.FileSelector(path, recursive=True, allow_not_found=True))
    rows = [(f.path, f.mtime_ns or 0, f.size or 0) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, pattern)]
    return sorted(rows)


def parts(files: list[tuple[str, int, int]]) -> list[Part]:
    out: list[Part] = []
    size = 0
    for f in files:
        if not out or size + f[2] > BYTES:
            out.append(Part([]))
            size = 0
        out[-1].files.append(f)
        size += f[2]
    return out


def contents(root: str, part: Part) -> Iterator[pa.RecordBatch]:
    """The files of a partition, one at a time; one that is gone by now is left out."""
    system, _ = _open(root)
    for path, changed, length in part.files:
        try:
            with system.open_input_stream(path) as stream:
                content = stream.read()
        except FileNotFoundError:
            continue
        yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "changed": pa.array([changed], pa.int64()), "length": pa.array([len(content)], pa.int64()), "content": pa.array([content], pa.binary())})


class Reader(DataSourceReader):
    def __init__(self, root: str, pattern: str):
        self.root, self.pattern = root, pattern

    def partitions(self) -> list[Part]:
        return parts(listed(self.root, self.pattern)) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return contents(self.root, partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are times of change: a batch holds what changed after its start, up to its end."""

    def __init__(self, root: str, pattern: str):
        self.root, self.pattern = root, pattern

    def initialOffset(self) -> dict:
        return {"changed": 0}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - int(SETTLE * 1e9)
        return {"changed": max((changed for _, changed, _ in listed(self.root, self.pattern) if changed <= settled), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return parts([f for f in listed(self.root, self.pattern) if start["changed"] < f[1] <= end["changed"]])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return contents(self.root, partition)


class ProjectFiles(DataSource):
    """Format ``flowfacts-project`` with the options root and pattern (a glob for names, ``*`` if none is given)."""

    @classmethod
    def name(cls) -> str:
        return "flowfacts-project"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["root"], self.options.get("pattern", "*"))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["root"], self.options.get("pattern", "*"))


def project_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """SCHEMA of all files below root whose names match, read by executors in partitions by size."""
    spark.dataSource.register(ProjectFiles)
    return spark.read.format("flowfacts-project").option("root", root).option("pattern", pattern).load()


def project_stream(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """The same as a stream: new and edited files come when they have settled."""
    spark.dataSource.register(ProjectFiles)
    return spark.readStream.format("flowfacts-project").option("root", root).option("pattern", pattern).load()
