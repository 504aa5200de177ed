"""Texts cut into overlapping chunks of whole sentences for an index, and scores of chunks rolled up to their texts.

A token is a word between white space; after a full-width sentence mark words end too. Sentences end at . ! ? and their
full-width forms, perhaps followed by closing quotes or brackets. A chunk is a run of sentences of `limit` tokens at most;
the next chunk repeats the longest run of last sentences of `overlap` tokens at most that leaves room for its first new
one. Sentences of more tokens than the limit are cut at the limit first. A text without words, or null, has no chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.semantics import col

SPACE, FULL_WIDTH, SENTENCE_END = r"[\x20\x09-\x0D]+", "([。！？])", r"""[.!?。！？]["')\]]*$"""
LIMIT, OVERLAP = 256, 32


def words(text: Column | str) -> Column:
    spaced = F.regexp_replace(F.coalesce(col(text), F.lit("")), FULL_WIDTH, "$1 ")
    return F.filter(F.split(spaced, SPACE), lambda w: w != "")


def cut(ends: np.ndarray, n: int, limit: int, overlap: int) -> list[dict[str, int]]:
    """(start, length) of the chunks of n words, whose sentences end before the words at `ends`."""
    bounds = [0]
    for end in [*ends.tolist(), n]:
        bounds.extend(range(bounds[-1] + limit, end, limit))
        if end > bounds[-1]:
            bounds.append(end)
    at, first, last, found = np.asarray(bounds), 0, 0, []
    while last < len(at) - 1:
        last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        found.append({"start": int(at[first]), "length": int(at[last] - at[first])})
        if last < len(at) - 1:
            first = max(first + 1, *np.searchsorted(at, [at[last] - overlap, at[last + 1] - limit]).tolist())
    return found


def chunks(df: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """A row for each chunk: df's columns but the text, then chunk (from 0), start (its first word), n_tokens, chunk_text.

    Only the places of sentences' ends go to Python. df has no columns of these names.
    """
    if not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit")

    def spans(ends: pa.Array, n: pa.Array) -> pa.Array:
        values, starts = ends.values.to_numpy(), ends.offsets.to_numpy()
        rows = [cut(values[a:b], size, limit, overlap) for a, b, size in zip(starts, starts[1:], n.to_pylist())]
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))

    spans.__annotations__ = {"ends": pa.Array, "n": pa.Array, "return": pa.Array}
    keep = [c for c in df.columns if c != text]
    split = df.select(*keep, words(text).alias("_words"))
    ends = F.array_compact(F.transform("_words", lambda w, i: F.when(w.rlike(SENTENCE_END), i + 1)))
    placed = split.select(*keep, "_words", F.arrow_udf(spans, "array<struct<start: int, length: int>>")(ends, F.size("_words")).alias("_spans"))
    own = lambda s: F.struct(s["start"].alias("start"), s["length"].alias("n_tokens"), F.array_join(F.slice("_words", s["start"] + 1, s["length"]), " ").alias("chunk_text"))
    rows = placed.select(*keep, F.posexplode(F.transform("_spans", own)).alias("chunk", "_chunk"))
    return rows.select(*keep, "chunk", "_chunk.*")


def best_of_chunks(scored: DataFrame, key: str, k: int, score: str = "score") -> DataFrame:
    """(key, chunk, score) of the k rows with the best chunk: its score counts, and the first chunk of equal ones is named.

    Equal scores by key; missing scores don't count. Chunks are combined before the shuffle.
    """
    own = F.when(col(score).isNotNull(), F.struct(col(score).alias("score"), (-F.col("chunk")).alias("last")))
    best = scored.groupBy(key).agg(F.max(own).alias("best")).where("best is not null")
    return best.select(key, (-F.col("best.last")).alias("chunk"), F.col("best.score").alias("score")).orderBy(F.desc("score"), key).limit(k)
