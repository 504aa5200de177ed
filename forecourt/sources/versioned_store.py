"""A keyed store of versions: rows in buckets of their keys' hash, published by one small file that appears as a whole.

    folder/data/<id>/bucket=<n>/...     rows of a version
    folder/versions/<number>            what a version is: its data and number of buckets

A version counts once its number's file exists. The file is written under another name and renamed, which never replaces one
that is there, so that of two writers that began from the same version one gets the number and the other an error; a job
that fails leaves data that no version names and the version before as it was. Files are never changed, so readers of an
older version go on. The file system has to rename atomically, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


class ConflictError(RuntimeError):
    """Another writer has published the next version."""


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def version(spark: SparkSession, folder: str) -> int:
    """The latest version; 0 before the first."""
    path, files = _path(spark, f"{folder}/versions")
    return max((int(x.getPath().getName()) for x in files.listStatus(path) if x.getPath().getName().isdigit()), default=0) if files.exists(path) else 0


def describe(spark: SparkSession, folder: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{folder}/versions/{number:010d}", wholetext=True).first()[0])


def bucket(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(buckets)).cast("int")


def commit(rows: DataFrame, folder: str, base: int, key: str = "key", buckets: int = BUCKETS) -> int:
    """Writes rows (without a column `bucket`) as the version after base. A ConflictError, and no change, if there is one already.

    A frequent key's bucket is written by several tasks.
    """
    spark = rows.sparkSession
    data = f"{folder}/data/{uuid.uuid4().hex}"
    rows.withColumn("bucket", bucket(key, buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(data)
    number, text = base + 1, json.dumps({"data": data.rpartition("/")[2], "buckets": buckets, "key": key, "schema": rows.schema.json()})
    path, files = _path(spark, f"{folder}/versions/{number:010d}")
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions/.{uuid.uuid4().hex}")
    out = files.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
        context.rename(part, path, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))  # never replaces
    except Py4JJavaError as e:
        for gone, whole in ((part, False), (spark._jvm.org.apache.hadoop.fs.Path(data), True)):
            files.delete(gone, whole)
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        raise ConflictError(f"{folder} has a version {number} already") from e
    return number


def read(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """All rows of a version (the latest without a number)."""
    return _stored(spark, folder, number)[0].drop("bucket")


def _stored(spark: SparkSession, folder: str, number: int | None) -> tuple[DataFrame, dict]:
    from pyspark.sql.types import IntegerType, StructType

    number = number or version(spark, folder)
    if not number:
        raise ValueError(f"there is no version in {folder}")
    found = describe(spark, folder, number)
    schema = StructType.fromJson(json.loads(found["schema"])).add("bucket", IntegerType())
    return spark.read.schema(schema).parquet(f"{folder}/data/{found['data']}"), found


def lookup(keys: DataFrame, folder: str, number: int | None = None) -> DataFrame:
    """Each wanted key (column of the store's key) with its rows, null where there are none. Only buckets of wanted keys are read."""
    stored, found = _stored(keys.sparkSession, folder, number)
    key = found["key"]
    wanted = keys.select(bucket(key, found["buckets"]).alias("bucket")).distinct().collect()  # as many rows as buckets at most
    rows = stored.where(F.col("bucket").isin([r["bucket"] for r in wanted])).drop("bucket")
    return keys.join(rows, key, "left")


def change(spark: SparkSession, folder: str, to: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
    """Publishes to(rows of the latest version), again from the then latest one where another writer was faster."""
    for left in range(tries - 1, -1, -1):
        base = version(spark, folder)
        found = describe(spark, folder, base)
        try:
            return commit(to(read(spark, folder, base)), folder, base, found["key"], found["buckets"])
        except ConflictError:
            if not left:
                raise
    raise AssertionError
