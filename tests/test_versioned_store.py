"""Versions of a keyed store: failing writers, two writers, and point reads that leave other buckets alone."""

import pytest
from pyspark.sql import functions as F

from forecourt.operators import records
from forecourt.sources import versioned_store as store


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").cast("string").alias("name"), F.lit("{}").alias("session"))
    assert store.commit(rows, f"file://{tmp_path}", 0, buckets=16) == 1
    return f"file://{tmp_path}"


def test_a_failing_task_leaves_the_old_version(spark, folder):
    bad = store.read(spark, folder).withColumn("name", F.when(F.col("key") == "k7", F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        store.commit(bad, folder, 1, buckets=16)
    assert store.version(spark, folder) == 1 and store.read(spark, folder).count() == 1000


def test_of_two_writers_one_wins(spark, folder):
    old = store.read(spark, folder)
    assert store.commit(old.where("name < '5'"), folder, 1, buckets=16) == 2
    with pytest.raises(store.ConflictError):
        store.commit(old.limit(1), folder, 1, buckets=16)
    assert store.read(spark, folder).where("name >= '5'").isEmpty() and store.read(spark, folder, 1).count() == 1000
    assert sum(1 for _ in (spark._jvm.java.io.File(f"{folder[7:]}/data").list())) == 2  # the loser's data is gone


def test_a_change_starts_again_after_another(spark, folder):
    changes = spark.createDataFrame([("k1", "new"), ("k2", ""), ("x", "y")], "key string, name string")
    seen = []

    def to(rows):
        if not seen:
            store.commit(rows.where("key <> 'k3'"), folder, 1, buckets=16)
        seen.append(1)
        return records.upsert(rows, changes, "key")

    assert store.change(spark, folder, to) == 3 and len(seen) == 2
    found = {r["key"]: r["name"] for r in store.read(spark, folder).collect()}
    assert len(found) == 1000 and (found["k1"], found["k2"], found["x"]) == ("new", "2", "y") and "k3" not in found


def test_a_lookup_reads_the_buckets_of_its_keys(spark, folder):
    keys = spark.createDataFrame([("k5",), ("none",), ("k77",)], "key string")
    found = store.lookup(keys, folder)
    assert {r["key"]: (r["name"], r["session"]) for r in found.collect()} == {"k5": ("5", "{}"), "k77": ("77", "{}"), "none": (None, None)}
    own = {r[0] for r in keys.select(store.bucket("key", 16)).distinct().collect()}
    files = {r[0] for r in found.select(F.input_file_name().alias("f")).distinct().collect() if r[0]}
    assert len(own) <= 3 and all(any(f"bucket={b}/" in f for b in own) for f in files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_an_empty_store(spark, tmp_path):
    assert store.version(spark, f"file://{tmp_path}/none") == 0
    with pytest.raises(ValueError):
        store.read(spark, f"file://{tmp_path}/none")
