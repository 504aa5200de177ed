"""Catalogue files as the format "toml" of spark.read and df.write, after register(spark).

Reading: files below the path in tasks of bounded bytes and files, listed one after the other into packed runs of paths;
filters on source_file skip files before they are opened. Writing: rows (name, car) as files that appear when the whole job commits.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from forecourt.sources.toml_source import SCHEMA, dumps, file_system, files_below, parsed

#: Bytes and files of one task at most; a file of more bytes is a task of its own. Found paths that are put in order together.
TASK_BYTES, TASK_FILES, ORDERED = 32 << 20, 4096, 65_536


@dataclass
class Files(InputPartition):
    """Paths in order, deflated: a few bytes each, since the driver holds them all."""

    packed: bytes

    @classmethod
    def of(cls, paths: list[str]) -> Files:
        return cls(zlib.compress("\0".join(paths).encode()))

    @property
    def paths(self) -> list[str]:
        return [p for p in zlib.decompress(self.packed).decode().split("\0") if p]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def runs(files: Iterable[tuple[str, int]], task_bytes: int, task_files: int) -> Iterator[list[str]]:
    """Paths as they come, in runs within both bounds."""
    run, size = [], 0
    for path, own in files:
        if run and (size + own > task_bytes or len(run) >= task_files):
            yield run
            run, size = [], 0
        run.append(path)
        size += own
    if run:
        yield run


def packed(files: list[tuple[str, int]], task_bytes: int, task_files: int) -> list[list[str]]:
    """Paths in their order, in runs within both bounds."""
    return list(runs(sorted(files), task_bytes, task_files))


def in_order(files: Iterator[tuple[str, int]]) -> Iterator[tuple[str, int]]:
    """Files in their order within stretches of bounded length."""
    while some := sorted(islice(files, ORDERED)):
        yield from some


def holds(path: str, f: Filter) -> bool:
    match f:
        case EqualTo():
            return path == f.value
        case In():
            return path in f.value
        case StringStartsWith():
            return path.startswith(f.value)
        case StringEndsWith():
            return path.endswith(f.value)
        case _:
            return f.value in path


class TomlReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.filters = options["path"], []
        self.task_bytes, self.task_files = int(options.get("taskbytes", TASK_BYTES)), int(options.get("taskfiles", TASK_FILES))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and f.attribute == ("source_file",):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        files, root = file_system(self.folder)
        if files.get_file_info(root).type == pafs.FileType.NotFound:
            return [Files.of([])]
        kept = ((p, n) for p, n in files_below(files, root) if all(holds(p, f) for f in self.filters))
        return [Files.of(paths) for paths in runs(in_order(kept), self.task_bytes, self.task_files)] or [Files.of([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(self.folder)
        return parsed(files, ((p, p) for p in partition.paths))


class TomlWriter(DataSourceWriter):
    """Tasks write below a hidden folder of the job; commit moves what counted tasks wrote, abort deletes it."""

    def __init__(self, folder: str) -> None:
        self.folder, self.job = folder, f".job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        files, root = file_system(self.folder)
        own = f"{self.job}/{uuid.uuid4().hex}"
        files.create_dir(f"{root}/{own}")
        names = []
        for row in iterator:
            names.append(f"{own}/{row['name']}.toml")
            with files.open_output_stream(f"{root}/{names[-1]}") as out:
                out.write(dumps(row["car"].asDict(recursive=True)).encode())
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = file_system(self.folder)
        for message in messages:
            for name in message.names if message else []:
                files.move(f"{root}/{name}", f"{root}/{posixpath.basename(name)}")
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        files, root = file_system(self.folder)
        if files.get_file_info(f"{root}/{self.job}").type != pafs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.job}")


class TomlSource(DataSource):
    """Options: path; taskBytes and taskFiles bound a task. source_file is the path within the file system, without its scheme.

    Rows are those of read_catalogue with permissive=True: corrupt holds the error of a file that can't be parsed. A missing
    folder is empty. Only appending is supported: a file replaces another of its name.
    """

    @classmethod
    def name(cls) -> str:
        return "toml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TomlReader:
        return TomlReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TomlWriter:
        if overwrite:
            raise ValueError("toml files are appended: mode('append')")
        return TomlWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(TomlSource)
