"""JSON records, one file or line per key, and their snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.functions.embedding import embedded
from forecourt.functions.semantics import truthy
from forecourt.functions.vocabulary import PROFILE_FIELDS, RESERVATION_FIELDS

LEGACY = "struct<" + ", ".join(f"{f}: string" for f in ["test_driver", "test_driver_name", "brand", "selected_car_model", "reservation_date", "reservation_time", "reservation_location", "reservation_phone_number", "salesman", "status", "notes"]) + ">"
SCHEMA = f"phone_number string, car_model string, created_at string, updated_at string, reservation struct<{', '.join(f'{f}: string' for f in RESERVATION_FIELDS)}>, test_drive_info {LEGACY}, corrupt string"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Only a local session may do without: it gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='forecourt-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_json(spark: SparkSession, folder: str, schema: str, key: str | None = None) -> DataFrame:
    """Records of a folder by key: the file's name without its ending for a file each, else a field of lines. Corrupt ones are null but for a file's key."""
    reader = spark.read.schema(f"{schema}, corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt")
    rows = reader.option("multiLine", key is None).json(folder)
    return rows.withColumn("key", F.col(key) if key else F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))


def keys_of(records: DataFrame) -> DataFrame:
    """The keys that there are, corrupt records' included."""
    return records.where(F.col("key").isNotNull()).select("key").distinct()


def lookup(records: DataFrame, keys: DataFrame) -> DataFrame:
    """Each wanted key with its record's columns, null where it is absent or corrupt."""
    return keys.join(records.where(F.col("corrupt").isNull()).drop("corrupt"), "key", "left")


PROFILE_SCHEMA = ", ".join(f"{f} string" for f in PROFILE_FIELDS) + ", additional_information map<string,string>, connection_information map<string,string>"


def read_profiles(spark: SparkSession, folder: str, key: str | None = None) -> DataFrame:
    """Profiles of the flat shape and of the older one with nested blocks, as flat rows."""
    rows = read_json(spark, folder, PROFILE_SCHEMA, key)
    nested = lambda f: F.coalesce(F.when(truthy(f), F.col(f)), F.col("additional_information")[f], F.col("connection_information")[f])
    return rows.select("key", *(nested(f).alias(f) for f in PROFILE_FIELDS), "corrupt")


def read_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions as key and state (a variant of whatever the file holds; null where it is corrupt)."""
    rows = spark.read.text(folder, wholetext=True)
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("key"), F.try_parse_json("value").alias("state"))


def load_index(spark: SparkSession, folder: str) -> DataFrame:
    """A written index; one without rows is an error."""
    found = spark.read.parquet(folder)
    if found.isEmpty():
        raise ValueError(f"the index in {folder} is empty")
    return found


class IndexHandles:
    """Opened indexes of a session by folder: a folder is listed and checked once, until it is reloaded or reset.

    Queries over a handle see the files that were there when it was opened. A rebuilt index is seen after get(reload=True),
    which also drops what Spark has cached of the folder. A folder that can't be opened is an error and leaves no handle.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.opened = spark, {}

    def get(self, folder: str, reload: bool = False) -> DataFrame:
        if reload:
            self.reset(folder)
        if folder not in self.opened:
            try:
                self.opened[folder] = load_index(self.spark, folder)
            except AnalysisException as e:
                raise ValueError(f"there is no index in {folder}") from e
        return self.opened[folder]

    def reset(self, folder: str | None = None) -> None:
        """Forgets one folder, or all."""
        for own in [folder] if folder else list(self.opened):
            self.opened.pop(own, None)
            self.spark.catalog.refreshByPath(own)


def build_index(docs: DataFrame, folder: str, text: str, size: int = 64, partition: str | None = None) -> None:
    """Embeds the texts and replaces the index; no documents are an error."""
    if docs.isEmpty():
        raise ValueError("there are no documents to index")
    write_snapshot(docs.withColumn("embedding", embedded(F.col(text), size)), folder, partition)


def write_report(rows: DataFrame, folder: str, stamp: str) -> str:
    """Rows as JSON below the folder, under a name with the given time stamp; the path."""
    path = f"{folder.rstrip('/')}/report_{stamp}"
    rows.write.json(path)
    return path


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Test drives of either shape as flat rows; key is the file's name without its ending. Corrupt files are left out."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(folder)
    rows = rows.withColumn("key", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")).where(F.col("corrupt").isNull())
    either = lambda f: F.coalesce(F.when(truthy(f"reservation.{f}"), F.col(f"reservation.{f}")), F.col(f"test_drive_info.{f}"), F.lit("")).alias(f)
    return rows.select("key", *(either(f) for f in RESERVATION_FIELDS), F.coalesce("car_model", "test_drive_info.selected_car_model", F.lit("")).alias("car_model"), F.coalesce("test_drive_info.brand", F.lit("")).alias("brand"), F.coalesce("test_drive_info.status", F.lit("")).alias("status"), "created_at")


def write_snapshot(df: DataFrame, folder: str, partition: str | None = None) -> None:
    """Replaces the snapshot, so that a repeated run doesn't append."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(folder)
