"""Quality classifier: naive Bayes log-count ratios times n-gram indicators, then a linear hinge-loss model.

Indicators are hashed character 3-grams, 5-grams of character shapes (letters by case, digits, spaces, other
characters as they are), and runs of a repeated word by their length (one indicator for each length up to
FINE_RUN, and one for each doubling beyond). Each indicator is scaled by the log ratio
of its smoothed counts in the two classes; the hinge-loss model on top is fitted by dual coordinate descent
with box-constrained dual variables. The score is a logistic curve through the margin that passes the stated
threshold where the margin is zero.

The model learns from at most MAX_ROWS labelled rows, in the order of a hash of the id. Scores read whole texts.

Defined cases: null counts as empty and is scored by the intercept; with rows of a single class, or none, all
scores are that class's share (0.5 for none); rows that repeat are each scored; several labels of an id count
as the largest; ids with equal hashes are taken by id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.llm.common import crc_mod, is_held_out, labelled_sample, map_batches, table
from forecourt.llm.ngrams import blocks, code_points, hashed

BITS = 17
MAX_ROWS = 4000
EPOCHS, COST, SMOOTH = 12, 1.0, 1.0
#: Longest run of one word that has an indicator of its own; longer ones share one for each doubling.
FINE_RUN = 8


def shape_table() -> np.ndarray:
    """Shape of each code point below 0x600; letters beyond count as lower case."""
    rows = np.arange(0x600, dtype=np.uint32)
    for i in range(0x600):
        c = chr(i)
        if c.isalpha():
            rows[i] = ord("A") if c.isupper() else ord("a")
        elif c.isdigit():
            rows[i] = ord("0")
    return rows


SHAPES = shape_table()


def indicators(text: str) -> np.ndarray:
    """Sorted buckets of all n-grams that occur in the text."""
    points = code_points(text)
    shapes = np.where(points < len(SHAPES), SHAPES[np.minimum(points, len(SHAPES) - 1)], np.uint32(ord("a")))
    seen = np.zeros(1 << BITS, bool)
    half = 1 << (BITS - 1)
    for block in blocks(points, 3):
        seen[hashed(block, 3, BITS - 1)] = True
    for block in blocks(shapes, 5):
        seen[hashed(block, 5, BITS - 1) + half] = True
    words = text.split()
    same = np.fromiter(map(operator.eq, words, words[1:]), bool, max(0, len(words) - 1))
    if same.any():
        ends = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
        run = int((ends[1::2] - ends[::2]).max()) + 1
        steps = [*range(2, FINE_RUN + 1), *(FINE_RUN << i for i in range(1, run.bit_length()))]
        seen[[half + place * 7919 % half for place, k in enumerate(steps, 2) if k <= run]] = True
    return np.flatnonzero(seen).astype(np.uint32)


def fit_nbsvm(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, cost: float = COST) -> tuple[np.ndarray, float, float]:
    """Weights by bucket (log-count ratios folded in), intercept and the slope of the logistic curve."""
    label = np.array([y for _, y in rows])
    if len(set(label.tolist())) < 2:
        share = min(max(float(label.mean()) if len(label) else 0.5, 0.001), 0.999)
        return np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))), 0.0
    sums = np.full((2, 1 << BITS), SMOOTH)
    for at, y in rows:
        sums[y][at] += 1
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    values = [ratio[at] / np.sqrt(max(1, len(at))) for at, _ in rows]
    norms = np.array([(v * v).sum() + 1.0 for v in values])
    sign = np.where(label == 1, 1.0, -1.0)
    most = cost * len(label) / (2 * np.where(label == 1, (label == 1).sum(), (label == 0).sum()))  # classes weigh the same
    dual, w, b = np.zeros(len(rows)), np.zeros(1 << BITS), 0.0
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i][0], values[i]
            slope = sign[i] * (v @ w[at] + b) - 1
            new = min(max(dual[i] - slope / norms[i], 0.0), most[i])
            step = (new - dual[i]) * sign[i]
            if step:
                w[at] += step * v
                b += step
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return (w * ratio).astype(np.float32), float(b), 3.0


def margin(at: np.ndarray, weights: np.ndarray, b: float) -> float:
    return float(weights[at].sum(dtype=np.float64) / np.sqrt(max(1, len(at))) + b)


def fit(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> tuple[np.ndarray, float, float]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([indicators(x or "").tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["label", "at"])

    sample = labelled_sample(docs, labels, label, keep, MAX_ROWS).select("label", "text")
    rows = sorted((bytes(r["at"]), int(r["label"])) for r in map_batches(sample, run, "label int, at binary").collect())  # MAX_ROWS at most
    return fit_nbsvm([(np.frombuffer(at, "<u4"), y) for at, y in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float, float], threshold: float) -> DataFrame:
    """doc_id, score, margin for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    odds = (1 - threshold) / threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, b, slope = shared.value
        for batch in batches:
            m = np.array([margin(indicators(x or ""), weights, b) for x in batch.column(1).to_pylist()], np.float64)
            p = 1 / (1 + odds * np.exp(-np.clip(slope * m, -50, 50))) if slope else 1 / (1 + np.exp(-m))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(m, pa.float64())], names=["doc_id", "score", "margin"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, margin double")


def op8_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), "quality", F.coalesce(crc_mod("doc_id", 5) != 0, F.lit(False)))
    found = score(docs, model, 0.3)
    return found.select("doc_id", is_held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "margin")
