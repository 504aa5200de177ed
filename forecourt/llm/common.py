"""Shared helpers of the corpus operators: the shared folder, Arrow batches, hashing of words."""

from __future__ import annotations

import itertools
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts can be long, so few rows travel to a Python worker at a time.
BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may do without: it gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='forecourt-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/forecourt-{uuid.uuid4().hex}/{name}"


#: Folders of the written tables by the id of their DataFrame, for `discard`.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: later reads survive a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[found] = path
    return found


def discard(*written: DataFrame) -> None:
    """Deletes tables of `materialize` that nothing will read again, whatever file system they are on."""
    for df in written:
        path = _WRITTEN.pop(df, None)
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getParent()
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def map_batches(df: DataFrame, f: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """mapInArrow with small batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(f, schema)


def own_columns(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names have."""
    return [F.col(f"`{c}`") for c in df.columns]


def new_name(df: DataFrame, name: str) -> str:
    """name, or the first of name_1, name_2, ... that is no column of df yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in itertools.chain([name], (f"{name}_{i}" for i in itertools.count(1))) if x.lower() not in taken)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def is_held_out(id_col: str, n: int, rest: int) -> Column:
    """Whether crc32(id as text) mod n is rest; a null id is never held out."""
    return F.coalesce(crc_mod(id_col, n) == rest, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share_bound(bound: int, n: int) -> int:
    """The largest 40-bit hash of a share of n rows that holds at least `bound` of them but for chance."""
    return min(1 << 40, (3 * bound + 100) * (1 << 40) // max(1, n))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """Written (doc_id, text, label) of at most about `bound` labelled rows, in the order of a hash of the id.

    The sampled ids, of which there are `bound` at most, are broadcast, so that texts needn't be shuffled.
    """
    rows = labels.where(keep & F.col(label).isNotNull())
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) <= share_bound(bound, rows.count()))
    ids = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return materialize(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "sample")
