"""Hybrid retrieval: exact metadata filters, vector similarity, top-k, and presentation of results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.functions.semantics import all_of, col, truthy
from forecourt.functions.vocabulary import FILTER_FIELDS

SNIPPET, SHORT_SNIPPET = 300, 200
#: Queries and vectors of one group of top_k_batch, about; vectors of a group at least, where there are cores enough; both of one product.
GROUP, LEAST_GROUP, TILE = 32_768, 1024, 1024
#: Digits by which scores are ranked: sums of the same products in another order are equal to so many. Presentation rounds to four.
RANK_DIGITS = 12
#: Score of what has no direction; real ones are -1 at least.
NO_SCORE = -2.0


def metadata_filter(df: DataFrame, filters: dict[str, str | None], columns: dict[str, str] | None = None) -> DataFrame:
    """Rows equal to every usable filter. Unknown keys and blank values don't filter; columns renames keys."""
    names = columns or {k: k for k in FILTER_FIELDS}
    usable = [col(names[k]) == F.lit(v) for k, v in filters.items() if k in FILTER_FIELDS and k in names and v]
    return df.where(all_of(usable)) if usable else df


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity of an array column with a fixed query vector; null for a zero vector."""
    q = np.asarray(query, np.float64)
    norm = float(np.sqrt((q * q).sum()))
    doubles = F.transform(vector, lambda x: x.cast("double"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    dot = total(F.zip_with(doubles, F.array(*(F.lit(float(x)) for x in q)), lambda a, b: a * b))
    size = F.sqrt(total(F.transform(doubles, lambda x: x * x))) * F.lit(norm)
    return F.when(size > 0, dot / size)


def cosine_batches(vector: Column, query: list[float]) -> Column:
    """As cosine, by one product for each Arrow batch. Vectors of another length than the query's have no score."""
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    def score(vectors: pa.Array) -> pa.Array:
        x, bad = rows_of(vectors, len(q))
        size = np.linalg.norm(x, axis=1)
        bad |= size == 0
        return pa.array((x @ q) / np.where(bad, 1.0, size), pa.float64(), mask=bad)

    score.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "double")(vector)


def rows_of(vectors: pa.Array, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the lists of that length, and which lists are null, hold nulls, or have another length (those are zero)."""
    values, starts = vectors.values, np.asarray(vectors.offsets)
    bad = np.asarray(vectors.is_null()) | (np.diff(starts) != wide)
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = np.zeros((len(vectors), wide))
    good = np.flatnonzero(~bad)
    x[good] = flat[starts[:-1][good][:, None] + np.arange(wide)]
    holes = np.isnan(x).any(axis=1)
    x[holes] = 0.0
    return x, bad | holes


def top_k(df: DataFrame, query: list[float], k: int = 5, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k most similar rows with score; equal scores by key. Becomes a TakeOrderedAndProject."""
    scored = df.withColumn("score", F.round(cosine_batches(col(vector), query), RANK_DIGITS))
    return scored.orderBy(F.desc_nulls_last("score"), key).limit(k)


def unit(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and which rows are null or zero (those are zero)."""
    rows = [np.asarray(v, np.float64) if v is not None else None for v in vectors.to_numpy()]
    wide = max((len(v) for v in rows if v is not None), default=1)
    x = np.stack([np.zeros(wide) if v is None else v for v in rows])
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1), size[:, 0] == 0


def best_of_group(queries: pa.Table, vectors: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of queries, row of vectors, score) of the k best of each query; vectors are in the order of their keys."""
    (q, q_bad), (x, x_bad) = unit(queries.column(1)), unit(vectors.column(1))
    out = []
    for at in range(0, len(q), TILE):
        own = q[at : at + TILE]
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        least = np.full(len(own), -np.inf)  # the k-th best score until now
        for begin in range(0, len(x), TILE):
            score = own @ x[begin : begin + TILE].T
            score[:, x_bad[begin : begin + TILE]] = NO_SCORE
            score[q_bad[at : at + TILE]] = NO_SCORE
            score = np.round(score, RANK_DIGITS)
            if begin:  # later keys are larger, so that they must exceed it
                i, j = np.nonzero(score > least[:, None])
            elif score.shape[1] <= k:
                i, j = np.nonzero(score > -np.inf)
            else:
                i, j = np.nonzero(score >= -np.partition(-score, k - 1, axis=1)[:, k - 1][:, None])
            if len(i):
                i, j, s = (np.concatenate(pair) for pair in zip(kept, (i, j + begin, score[i, j]), strict=True))
                order = np.lexsort((j, -s, i))
                i, j, s = i[order], j[order], s[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                kept = tuple(c[rank < k] for c in (i, j, s))
                least[i[rank == k - 1]] = s[rank == k - 1]
        out.append((kept[0] + at, kept[1], kept[2]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def top_k_batch(df: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, key, score, rank) of the k most similar rows of each row of queries, which has the same columns.

    Queries and vectors are dealt to groups of bounded size; each group of queries meets each group of vectors in one
    task, which keeps its best k of each query, so that queries x k rows a group of vectors are shuffled. Vectors that
    are null or zero have a null score and come last. Keys don't repeat.
    """
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    blocks, chunks = -(-queries.count() // GROUP) or 1, max(-(-n // GROUP), min(cores, n // LEAST_GROUP), 1)
    deal = lambda groups: F.pmod(F.xxhash64(key), F.lit(groups))
    every = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>"))
    left = queries.select(col(key), col(vector), deal(blocks).alias("block"), every(chunks).alias("chunk"))
    right = df.select(col(key), col(vector), every(blocks).alias("block"), deal(chunks).alias("chunk"))

    def best(own: pa.Table, others: pa.Table) -> pa.Table:
        names = ["query_id", key, "score"]
        if not len(own) or not len(others):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        others = others.sort_by(key)
        i, j, score = best_of_group(own, others, k)
        ids = [t.column(0).to_numpy()[x].astype(np.int64) for t, x in ((own, i), (others, j))]
        return pa.table([pa.array(ids[0]), pa.array(ids[1]), pa.array(score, mask=score == NO_SCORE)], names=names)

    pairs = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
    near = pairs.applyInArrow(best, f"query_id bigint, {key} bigint, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), key)
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def format_results(df: DataFrame, name: str, text: str, score: str = "score", metadata: str | None = None) -> DataFrame:
    """car_model (Unknown where missing), score (4 digits, null stays), text_snippet (300 characters).

    With the name of a map column also metadata: that map without the source path.
    """
    more = [] if metadata is None else [F.map_filter(metadata, lambda k, v: k != "source_file").alias("metadata")]
    return df.select(*more, F.coalesce(F.when(truthy(name), col(name)), F.lit("Unknown")).alias("car_model"), F.round(score, 4).alias("score"), F.left(F.coalesce(col(text), F.lit("")), F.lit(SNIPPET)).alias("text_snippet"))


def matched_cars_text(cars: Column) -> Column:
    """Ranked lines of an array<struct<car_model, score, text_snippet>>."""
    line = lambda c, i: F.format_string("%d. %s (relevance: %s)\n   %s", i + 1, F.coalesce(c["car_model"], F.lit("Unknown")), F.coalesce(c["score"].cast("string"), F.lit("N/A")), F.left(F.coalesce(c["text_snippet"], F.lit("")), F.lit(SHORT_SNIPPET)))
    return F.when(F.coalesce(F.size(cars), F.lit(0)) <= 0, "No vehicles matched yet.").otherwise(F.array_join(F.transform(cars, line), "\n"))


def query_text(category: Column, powertrain: Column, style: Column, brand: Column, price: Column, seats: Column) -> Column:
    """Retrieval query from the needs that are present."""
    own = lambda c: F.when(truthy(c), c)
    text = F.concat_ws(" ", own(category), own(powertrain), own(style), F.when(truthy(brand), F.concat(brand, F.lit(" brand"))), F.when(truthy(price), F.concat(F.lit("price range "), price)), own(seats))
    return F.when(text == "", "recommend a good vehicle").otherwise(text)


def query_text_legacy(category: Column, powertrain: Column, style: Column, brand: Column, comfort: Column, family: Column) -> Column:
    """The older form, which adds implicit needs."""
    own = lambda c: F.when(truthy(c), c)
    text = F.concat_ws(" ", own(category), own(powertrain), own(style), F.when(truthy(brand), F.concat(brand, F.lit(" brand"))), F.when(truthy(comfort), F.concat(comfort, F.lit(" comfort"))), F.when(truthy(family), F.concat(family, F.lit(" family friendliness"))))
    return F.when(text == "", "recommend a good vehicle").otherwise(text)
