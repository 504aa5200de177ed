"""A stored vector index of inverted lists: coarse centroids, vectors by their nearest one, and searches that read only probed lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.functions.semantics import col
from forecourt.operators.retrieval import GROUP, NO_SCORE, RANK_DIGITS, best_of_group, rows_of
from forecourt.sources.record_store import write_snapshot

#: Vectors that centroids are learned from, rounds of learning, and lists of an index at most.
SAMPLE, ROUNDS, MOST_LISTS = 20_000, 12, 4096
#: Vectors of the sample and their neighbours by which the number of probed lists is set, and the share of them to be found.
TRIED, NEAR, RECALL = 500, 5, 0.95
#: The list of vectors that are null or zero.
NO_LIST = -1


def units(vectors: pa.Array, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and which have no direction."""
    x, bad = rows_of(vectors, wide)
    size = np.linalg.norm(x, axis=1)
    bad |= size == 0
    return x / np.where(bad, 1.0, size)[:, None], bad


def learn_centroids(df: DataFrame, lists: int, vector: str = "embedding", key: str = "vec_id") -> tuple[np.ndarray, int]:
    """Directions of `lists` groups of the SAMPLE vectors with the least hashes of their keys, which is what the driver sees of the table; how many lists to probe.

    So many lists are probed that RECALL of the nearest neighbours of TRIED vectors within the sample are in them. In the
    whole table neighbours are nearer, and sooner in the same lists.
    """
    found = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE).select(vector).toArrow().column(0).combine_chunks()
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    wide = max((len(v) for v in found.slice(0, 1)), default=1)
    x, bad = units(found, wide)
    x = x[~bad]
    if not len(x):
        return np.zeros((1, wide)), 1
    rng = np.random.default_rng(7)
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        centres = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1.0)[:, None], centres)
    own, tried = np.argmax(x @ centres.T, axis=1), x[:TRIED]
    score = tried @ x.T
    score[np.arange(len(tried)), np.arange(len(tried))] = -np.inf
    near = np.argpartition(-score, min(NEAR, len(x)) - 1, axis=1)[:, : min(NEAR, len(x))]
    place = np.argsort(np.argsort(-(tried @ centres.T), axis=1, kind="stable"), axis=1)
    return centres, int(np.quantile(np.take_along_axis(place, own[near], 1), RECALL, method="higher")) + 1


def nearest_lists(vector: Column, centres: np.ndarray, many: int) -> Column:
    """array<int>: the `many` lists whose centroids are nearest, the nearest first; NO_LIST alone for what has no direction."""

    def nearest(vectors: pa.Array) -> pa.Array:
        x, bad = units(vectors, centres.shape[1])
        score = x @ centres.T
        n = min(many, len(centres))
        best = np.argpartition(-score, n - 1, axis=1)[:, :n]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), axis=1, kind="stable"), 1)
        return pa.array([[NO_LIST] if b else r for r, b in zip(best.tolist(), bad.tolist(), strict=True)], pa.list_(pa.int32()))

    nearest.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    return F.arrow_udf(nearest, "array<int>")(vector)


def build_index(df: DataFrame, folder: str, lists: int | None = None, vector: str = "embedding", key: str = "vec_id") -> None:
    """Writes every row to the list of its nearest centroid, below folder/lists, and the centroids to folder/centroids.

    There are about as many lists as the root of the number of rows. A list that holds a large share of all rows is written by several
    tasks. No rows are an error.
    """
    n = df.count()
    if not n:
        raise ValueError("there are no vectors to index")
    centres, probes = learn_centroids(df, lists or max(1, min(MOST_LISTS, math.isqrt(n))), vector, key)
    placed = df.withColumn("list", nearest_lists(col(vector), centres, 1)[0])
    write_snapshot(placed.hint("rebalance", "list"), f"{folder}/lists", "list")
    rows = [(i, x.tolist(), probes) for i, x in enumerate(centres)]
    write_snapshot(df.sparkSession.createDataFrame(rows, "list int, centroid array<double>, probes int").coalesce(1), f"{folder}/centroids")


def search_index(queries: DataFrame, folder: str, k: int = 5, probes: int | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, key, score, rank) of the k most similar rows in the `probes` lists (the index's own number without one) nearest to each row of queries (which have key and vector).

    Only the lists that some query probes are read. Inside a list, groups of queries meet groups of vectors, each of bounded size; scores are
    exact. Queries without a direction find nothing.
    """
    spark = queries.sparkSession
    found = spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()  # MOST_LISTS rows at most
    centres, probes = np.array([r["centroid"] for r in found]), probes or found[0]["probes"]
    asked = queries.select(col(key), col(vector), F.explode(nearest_lists(col(vector), centres, probes)).alias("list")).where(F.col("list") != NO_LIST)
    groups = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / GROUP).cast("int").alias(name))
    wanted = groups(asked, "blocks").collect()  # a row for each list
    if not wanted:
        return queries.select(col(key).cast("bigint").alias("query_id"), col(key), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    stored = spark.read.parquet(f"{folder}/lists").where(F.col("list").isin([r["list"] for r in wanted]))
    blocks = spark.createDataFrame(wanted, "list int, blocks int")
    sizes = F.broadcast(blocks.join(groups(stored, "chunks"), "list"))
    deal = lambda n: F.pmod(F.xxhash64(key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1).cast("array<bigint>"))
    left = asked.join(sizes, "list").select(col(key), col(vector), "list", deal("blocks").alias("block"), every("chunks").alias("chunk"))
    right = stored.select(col(key), col(vector), "list").join(sizes, "list").select(col(key), col(vector), "list", every("blocks").alias("block"), deal("chunks").alias("chunk"))

    def best(own: pa.Table, others: pa.Table) -> pa.Table:
        names = ["query_id", key, "score"]
        if not len(own) or not len(others):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        others = others.sort_by(key)
        i, j, score = best_of_group(own, others, k)
        i, j, score = (x[score != NO_SCORE] for x in (i, j, score))
        return pa.table([pa.array(own.column(0).to_numpy()[i].astype(np.int64)), pa.array(others.column(0).to_numpy()[j].astype(np.int64)), pa.array(score)], names=names)

    by = ("list", "block", "chunk")
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, f"query_id bigint, {key} bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", RANK_DIGITS)), key)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
