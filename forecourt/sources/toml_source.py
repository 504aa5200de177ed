"""Catalogue files as a Spark data source: one row per TOML file, read where the file's task runs."""

from __future__ import annotations

import json
import os
import tomllib
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.functions.semantics import truthy

TEMPLATE = "CarLabels.toml"
#: Small partitions of files that one task reads at most, and folders that written files are dealt to.
TASK_PARTS, FOLDERS = 256, 256
#: Rows and bytes of files of one batch; found paths of one batch; levels of folders whose content is dealt out before tasks go all the way down.
BATCH, BATCH_BYTES, PATHS, LEVELS = 256, 32 << 20, 10_000, 2
ENTRY = "struct<section: string, ord: int, key: string, value: string>"
SCHEMA = f"source_file string, car_model string, title string, key_details string, key_details_comments string, entries array<{ENTRY}>, corrupt string"
NAMES = ["source_file", "car_model", "title", "key_details", "key_details_comments", "entries", "corrupt"]
# Schemes of Spark's file systems whose names differ in pyarrow.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def as_text(value) -> str | None:
    return value if value is None or isinstance(value, str) else str(value)


def parse(path: str, raw: bytes) -> dict:
    """A row; corrupt holds the error of a file that can't be parsed."""
    row = dict.fromkeys(("car_model", "title", "key_details", "key_details_comments", "corrupt")) | {"source_file": path, "entries": []}
    try:
        data = tomllib.loads(raw.decode())
    except (ValueError, UnicodeDecodeError) as e:
        return row | {"corrupt": str(e)[:200]}
    details = data.get("KeyDetails") if isinstance(data.get("KeyDetails"), dict) else {}
    entries = [{"section": s, "ord": i, "key": k, "value": as_text(v)} for s, own in data.items() if isinstance(own, dict) and s != "KeyDetails" for i, (k, v) in enumerate(own.items())]
    return row | {k: as_text(data.get(k)) for k in ("car_model", "title")} | {k: as_text(details.get(k)) for k in ("key_details", "key_details_comments")} | {"entries": entries}


def rows_batch(rows: list[dict]) -> pa.RecordBatch:
    entry = pa.struct([("section", pa.string()), ("ord", pa.int32()), ("key", pa.string()), ("value", pa.string())])
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.list_(entry) if n == "entries" else pa.string()) for n in NAMES], names=NAMES)


def few_tasks(files: DataFrame) -> DataFrame:
    """Small files in fewer tasks than Spark plans, which puts few of them to one."""
    parts, cores = files.rdd.getNumPartitions(), files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(1, min(parts, max(4 * cores, -(-parts // TASK_PARTS)))))


def parts_of(spark: SparkSession) -> int:
    """Parts that paths or names are dealt to by their hash."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path of a folder as Spark names it."""
    scheme, found, rest = folder.partition(":")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}" if found else f"file://{folder}")


def hidden(name: str) -> bool:
    """Names that Spark's file sources leave out, as those of jobs that write."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def wanted(name: str) -> bool:
    return name.endswith(".toml") and name != TEMPLATE


def entries(files: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """(path, whether it is a folder, bytes) of the folders and wanted files in a folder; those of a local one are never held together."""
    if isinstance(files, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for x in found:
                if not hidden(x.name) and (x.is_dir() or (wanted(x.name) and x.is_file())):
                    yield x.path, x.is_dir(), 0 if x.is_dir() else x.stat().st_size
    else:
        for x in files.get_file_info(pafs.FileSelector(folder)):
            if not hidden(x.base_name) and (x.type == pafs.FileType.Directory or (x.is_file and wanted(x.base_name))):
                yield x.path, not x.is_file, x.size or 0


def files_below(files: pafs.FileSystem, folder: str) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the wanted files at any depth."""
    for path, is_folder, size in entries(files, folder):
        if is_folder:
            yield from files_below(files, path)
        else:
            yield path, size


def parsed(files: pafs.FileSystem, paths: Iterable[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """Rows of the files (path, shown path), in batches of bounded rows and bytes."""
    rows, size = [], 0
    for path, shown in paths:
        with files.open_input_stream(path) as f:
            raw = f.read()
        rows.append(parse(shown, raw))
        size += len(raw)
        if len(rows) >= BATCH or size >= BATCH_BYTES:
            yield rows_batch(rows)
            rows, size = [], 0
    if rows:
        yield rows_batch(rows)


def listed(spark: SparkSession, files: pafs.FileSystem, root: str) -> DataFrame:
    """(path) of the wanted files below root that aren't empty. Tasks list the folders and deal out what they find, so that neither the driver nor a task holds all paths."""

    def step(deep: bool):
        def found(path: str, is_folder: bool) -> Iterator[tuple[str, bool]]:
            if not is_folder:
                yield path, False
            elif deep:
                yield from ((p, False) for p, size in files_below(files, path) if size)
            else:
                yield from ((p, d) for p, d, size in entries(files, path) if d or size)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (x for batch in batches for path, is_folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in found(path, is_folder))
            while some := list(islice(rows, PATHS)):
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.string()), pa.array([d for _, d in some], pa.bool_())], names=["path", "is_folder"])

        return run

    rows = spark.range(1).select(F.lit(root).alias("path"), F.lit(True).alias("is_folder"))
    for level in range(LEVELS + 1):
        rows = rows.mapInArrow(step(level == LEVELS), "path string, is_folder boolean").repartition(parts_of(spark), "path")
    return rows.select("path")


def reached(path) -> tuple[pafs.FileSystem, str] | None:
    """pyarrow's file system and path of a folder (a qualified Path of Hadoop), if it finds the folder as Spark does."""
    try:
        files, root = (pafs.LocalFileSystem(), path.toUri().getPath()) if path.toUri().getScheme() == "file" else file_system(path.toString())
        return (files, root) if files.get_file_info(root).type == pafs.FileType.Directory else None
    except (pa.ArrowException, OSError):
        return None


def read_catalogue(spark: SparkSession, folder: str, permissive: bool = False, ordered: bool = False) -> DataFrame:
    """All *.toml below folder but the template, without files that are corrupt or name no model; a missing folder is empty. In the order of paths if ordered.

    Tasks list and read the files. In stores that pyarrow doesn't reach, Spark does, with all paths on the driver.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return spark.createDataFrame([], SCHEMA)
    path = store.makeQualified(path)
    if found := reached(path):
        files, root = found
        base = path.toString()

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return parsed(files, ((p, base + p[len(root) :]) for batch in batches for p in batch.column(0).to_pylist()))

        rows = listed(spark, files, root).mapInArrow(read, SCHEMA)
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield rows_batch([parse(p, c) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])

        known = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.toml").load(folder)
        rows = few_tasks(known).where(~F.col("path").endswith(f"/{TEMPLATE}")).select("path", "content").mapInArrow(run, SCHEMA)
    rows = rows if permissive else rows.where(F.col("corrupt").isNull() & truthy("car_model"))
    return rows.orderBy("source_file") if ordered else rows


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, wherever Spark's file systems reach."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def dumps(car: dict) -> str:
    """A car's text keys and sections of text keys; those that are None are left out."""
    line = lambda k, v: f"{k} = {json.dumps(v, ensure_ascii=False)}\n".replace("\x7f", "\\u007f")
    top = "".join(line(k, v) for k, v in car.items() if v is not None and not isinstance(v, dict))
    return top + "".join(f"[{s}]\n" + "".join(line(k, v) for k, v in own.items() if v is not None) for s, own in car.items() if isinstance(own, dict))


def write_catalogue(cars: DataFrame, folder: str) -> int:
    """Writes a file for each row (name, car) below folder, from the tasks; car is a struct for dumps. How many files.

    Names don't repeat. Files appear whole, by renaming, so that attempts of a task can't leave parts. The folder is
    one that all executors share and pyarrow's file systems reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(folder)
        made = set()
        for batch in batches:
            for name, car in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = f"{root}/{sum(name.encode()) % FOLDERS:03d}"
                if own not in made:
                    files.create_dir(own)
                    made.add(own)
                with files.open_output_stream(part := f"{own}/{name}.{uuid.uuid4().hex}") as out:
                    out.write(dumps(car).encode())
                files.move(part, f"{own}/{name}.toml")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    dealt = cars.select("name", "car").repartition(parts_of(cars.sparkSession), "name")  # few bytes of a table can be many files
    return dealt.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
