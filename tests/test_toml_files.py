"""Listing of catalogue files: as Spark lists them, and without their paths on the driver."""

import os

import pyarrow.fs as pafs
from pyspark.sql import functions as F

from forecourt.sources import toml_source

NAMES = ["a.toml", "b c%20é#.toml", "A.TOML", "x.txt", "CarLabels.toml", ".hidden.toml", "_made.toml", "_k=v.toml", "_metadata.toml", "z._COPYING_", "bad.toml", "sub.toml/in.toml", "_temporary/0.toml", ".job-1/1.toml", "d/e/f/g/h/deep.toml", "d/e/f/other.toml", "brand=x/1.toml", "empty.toml"]


def some_files(root):
    for i, name in enumerate(NAMES):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes({"bad.toml": b"\xff", "empty.toml": b""}.get(name, f'car_model = "M{i}"\n[PriciseLabels]\nbrand = "B{i}"\n'.encode()))
    os.symlink(root / "none", root / "lost.toml")
    os.symlink(root / "a.toml", root / "link.toml")
    (root / "nothing").mkdir()


def by_spark(spark, folder):
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.toml").load(folder)
    return sorted(r["path"] for r in found.where("path not like '%/CarLabels.toml'").select("path").collect())


def test_files_are_those_that_spark_lists(spark, tmp_path):
    for name in ("plain", "a b%20é"):
        folder = tmp_path / name
        folder.mkdir()
        some_files(folder)
        for path in (str(folder), f"file://{folder}/", f"{folder}/d"):
            rows = toml_source.read_catalogue(spark, path, permissive=True)
            assert sorted(r["source_file"] for r in rows.collect()) == by_spark(spark, path)
            assert not rows.inputFiles()  # no scan that the driver has planned file by file
        kept = toml_source.read_catalogue(spark, str(folder))
        assert {r["source_file"].rpartition("/")[2] for r in kept.collect()} >= {"a.toml", "in.toml", "deep.toml"} and kept.where("source_file like '%/bad.toml'").count() == 0


def test_another_store_is_left_to_spark(spark, tmp_path, monkeypatch):
    some_files(tmp_path)
    own = toml_source.read_catalogue(spark, str(tmp_path), permissive=True).collect()
    monkeypatch.setattr(toml_source, "reached", lambda path: None)
    assert sorted(map(str, toml_source.read_catalogue(spark, str(tmp_path), permissive=True).collect())) == sorted(map(str, own)) and len(own) > 5


def test_entries_of_any_store_are_those_of_a_local_one(tmp_path):
    some_files(tmp_path)
    local, other = pafs.LocalFileSystem(), pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem())
    assert sorted((p[len(str(tmp_path)) + 1 :], n) for p, n in toml_source.files_below(local, str(tmp_path))) == sorted(toml_source.files_below(other, ""))


def test_batches_are_bounded(tmp_path, monkeypatch):
    paths = []
    for i in range(10):
        paths.append((f"{tmp_path}/{i}.toml",) * 2)
        (tmp_path / f"{i}.toml").write_text(f'car_model = "{"m" * (100 if i > 7 else 1)}"')
    monkeypatch.setattr(toml_source, "BATCH", 4)
    monkeypatch.setattr(toml_source, "BATCH_BYTES", 100)
    assert [b.num_rows for b in toml_source.parsed(pafs.LocalFileSystem(), paths)] == [4, 4, 1, 1]
    assert not list(toml_source.parsed(pafs.LocalFileSystem(), []))


def test_folders_are_listed_by_many_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"f{i}" / "g").mkdir(parents=True)
        (tmp_path / f"f{i}" / "g" / f"{i}.toml").write_text(f'car_model = "{i}"')
    rows = toml_source.listed(spark, pafs.LocalFileSystem(), str(tmp_path)).withColumn("task", F.spark_partition_id())
    assert rows.count() == rows.select("path").distinct().count() == 60 and rows.select("task").distinct().count() > 4
