"""The index of inverted lists: recall against brute force, pruned lists, and odd vectors."""

import random

import pytest
from pyspark.sql import functions as F

from forecourt.operators import retrieval
from forecourt.sources import vector_index


def recall(found, exact):
    score = lambda r: round(r["score"], 9)
    least = {}
    for r in exact:
        least[r["query_id"]] = min(least.get(r["query_id"], 2.0), score(r))
    good = sum(score(r) >= least[r["query_id"]] for r in found)  # equal scores are as good
    return good / len(exact)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_every_20th(spark, tmp_path, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 20 = 0")
    vector_index.build_index(vectors, f"file://{tmp_path}")
    assert spark.read.parquet(f"{tmp_path}/lists").count() == vectors.count()
    found = vector_index.search_index(queries, f"file://{tmp_path}", 5).collect()
    exact = retrieval.top_k_batch(vectors, queries, 5).collect()
    assert recall(found, exact) >= 0.9
    score = {(r["query_id"], r["vec_id"]): round(r["score"], 9) for r in exact}
    assert all(round(r["score"], 9) == score.get((r["query_id"], r["vec_id"]), round(r["score"], 9)) for r in found)


def test_only_probed_lists_are_read(spark, tmp_path):
    """Vectors in forty directions: a search along one reads its list alone."""
    rng = random.Random(3)
    centre = lambda i: [10.0 if j == i else 0.0 for j in range(40)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in centre(i % 40)]) for i in range(2000)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    vector_index.build_index(vectors, f"file://{tmp_path}", lists=60)
    assert spark.read.parquet(f"{tmp_path}/centroids").agg(F.max("probes")).first()[0] <= 4  # a direction may have several lists
    found = vector_index.search_index(vectors.where("vec_id = 7"), f"file://{tmp_path}", 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "list#" in plan.split("PartitionFilters:")[1].split("]")[0]
    exact = {r["vec_id"] for r in retrieval.top_k_batch(vectors, vectors.where("vec_id = 7"), 5).collect()}
    assert {r["vec_id"] for r in found.collect()} == exact
    stored = spark.read.parquet(f"{tmp_path}/lists").where(F.col("list").isin([1, 2]))
    assert 0 < len({r[0] for r in stored.select(F.input_file_name()).distinct().collect()}) < len(list((tmp_path / "lists").glob("list=*/*.parquet")))


def test_odd_vectors_and_a_hot_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "GROUP", 100)  # one list needs many groups
    rows = [(i, [1.0, 0.0, float(i % 3 == 0)]) for i in range(1500)] + [(2000, None), (2001, [0.0, 0.0, 0.0]), (2002, [1.0]), (2003, [1.0, None, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    vector_index.build_index(vectors, f"file://{tmp_path}", lists=2)
    assert spark.read.parquet(f"{tmp_path}/lists").count() == len(rows)
    queries = vectors.where("vec_id in (0, 1, 2000, 2001)")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in vector_index.search_index(queries, f"file://{tmp_path}", 3, 2).collect())
    assert got == [(0, 1, 0), (0, 2, 3), (0, 3, 6), (1, 1, 1), (1, 2, 2), (1, 3, 4)]
    with pytest.raises(ValueError):
        vector_index.build_index(vectors.limit(0), f"file://{tmp_path}/none")
    assert vector_index.search_index(queries.where("vec_id >= 2000"), f"file://{tmp_path}", 3).count() == 0
