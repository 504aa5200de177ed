"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a linear classifier over hashed character 1- to 3-grams
predicts it; decoding sums, over the bits of each codeword, the logistic loss of the classifier's margin,
weighted by how reliable that classifier was on training rows, and takes the codeword of least loss. A small
lead over the second marks the prediction as ambiguous. The score is the softmax of the negative losses.

Up to seven languages get the exhaustive code, more get random codewords of which each differs from every
other and its complement in as many bits as a fixed number of draws finds.

The classifiers learn from at most PER_LANG rows of each language and MAX_ROWS in all, in the order of a hash
of the id: first a row of each language, the most frequent languages first, then another of each, and so on.
Predictions read whole texts.

Defined cases: null text or one without a letter gets `und`, score 0 and is ambiguous; with no training row
everything is `und`; rows with a null lang aren't learned from; an id with several languages counts as the first of
them by name; rows that repeat are each predicted; of languages that fit equally well the first by name is taken, and
the prediction is ambiguous; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forecourt.llm.common import crc_mod, is_held_out, map_batches, materialize, table
from forecourt.llm.ngrams import blocks, code_points, hashed

BITS = 15
ORDERS = (1, 2, 3)
PER_LANG, MAX_ROWS = 600, 6000
#: Parts that a language's rows are dealt to before its first PER_LANG are taken.
SALTS = 64
EPOCHS = 4
#: Lead in weighted loss, per unit of weight, under which a prediction is ambiguous.
LEAD = 0.1


def make_code(n: int, seed: int = 7) -> np.ndarray:
    """(n, bits) of -1 and 1."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 7:
        words = np.arange(2 ** (n - 1) - 1)
        rows = [np.ones(len(words))] + [np.where((words >> (n - 2 - i)) & 1, 1.0, -1.0) for i in range(n - 1)]
        return np.array(rows, np.float32)
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(n)))
    best, best_gap = None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width)).astype(np.float32)
        gap = width - np.abs(code @ code.T - width * np.eye(n)).max()
        if gap > best_gap:
            best, best_gap = code, gap
    return best


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text's n-grams."""
    points = code_points(text.lower())
    total = np.zeros(1 << BITS, np.int64)
    for n in ORDERS:
        for block in blocks(points, n):
            total += np.bincount(hashed(block, n, BITS), minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at.astype(np.uint32), total[at]


def margins(text: str, weights: np.ndarray) -> np.ndarray:
    """Mean weight over all n-grams of the text, for each bit."""
    points, total, n_grams = code_points(text.lower()), np.zeros(weights.shape[1]), 0
    for n in ORDERS:
        for block in blocks(points, n):
            at = hashed(block, n, BITS)
            if len(at) > 1 << BITS:  # each bucket once
                total += np.bincount(at, minlength=1 << BITS) @ weights
            else:
                total += weights[at].sum(axis=0, dtype=np.float64)
            n_grams += len(at)
    return total / max(1, n_grams)


def fit_bits(rows: list[tuple[np.ndarray, np.ndarray, int]], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets, bits) of logistic bit classifiers by AdaGrad, and each bit's reliability."""
    weights = np.zeros((1 << BITS, code.shape[1]), np.float32)
    squares = np.full_like(weights, 1e-8)
    order = np.random.default_rng(1)
    for epoch in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, n, lang = rows[i]
            x = (n / n.sum()).astype(np.float32)
            y = code[lang]
            slope = -y / (1 + np.exp(np.clip(y * (x @ weights[at]), -30, 30)))
            g = x[:, None] * slope
            squares[at] += g * g
            weights[at] -= (1.0 / (1 + epoch)) * g / np.sqrt(squares[at])
    right = np.zeros(code.shape[1])
    for at, n, lang in rows:
        right += ((n / n.sum()) @ weights[at]) * code[lang] > 0
    return weights, np.maximum(right / max(1, len(rows)) - 0.5, 0.01) * 2


def decode(m: np.ndarray, code: np.ndarray, reliability: np.ndarray) -> tuple[int, float, bool]:
    """Nearest codeword, its share, and whether the second is almost as near."""
    loss = (reliability * np.logaddexp(0, -code * m)).sum(axis=1)
    share = np.exp(loss.min() - loss)
    share /= share.sum()
    by = np.argsort(loss, kind="stable")
    close = len(by) > 1 and loss[by[1]] - loss[by[0]] < LEAD * reliability.sum()
    return int(by[0]), float(share[by[0]]), bool(close)


def fit(docs: DataFrame, keep: Column) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, their code, weights and reliabilities, from a bounded sample of the rows that `keep` admits."""
    rows = docs.where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("rank"))
    # Of each language first within SALTS parts of the hash, so that no task meets more than a part of what all tasks keep.
    part = Window.partitionBy("lang", "salt").orderBy("rank", "doc_id")
    first = rows.withColumn("salt", F.col("rank") % SALTS).withColumn("k", F.row_number().over(part)).where(F.col("k") <= PER_LANG)
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "doc_id"))).where(F.col("k") <= PER_LANG)
    ids = first.join(rows.groupBy("lang").agg(F.count("*").alias("n")), "lang").orderBy("k", F.desc("n"), "lang").limit(MAX_ROWS)
    ids = ids.groupBy("doc_id").agg(F.min("lang").alias("learned"))
    sample = materialize(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").select("text", "learned"), "lang_sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary())], names=["lang", "at", "n"])

    rows = [r for r in map_batches(sample, run, "lang string, at binary, n binary").collect() if r["n"]]  # rows of MAX_ROWS ids
    if not rows:
        return [], make_code(0), np.zeros((1 << BITS, 1), np.float32), np.ones(1)
    langs = sorted({r["lang"] for r in rows})
    code = make_code(len(langs))
    data = sorted(((r["lang"], bytes(r["at"]), bytes(r["n"])) for r in rows))
    weights, reliability = fit_bits([(np.frombuffer(a, "<u4"), np.frombuffer(n, "<u4").astype(np.float64), langs.index(x)) for x, a, n in data], code)
    return langs, code, weights, reliability


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, code, weights, reliability = shared.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                if not text or not langs or not any(map(str.isalpha, text)):
                    out.append(("und", 0.0, True))
                else:
                    k, share, close = decode(margins(text, weights), code, reliability)
                    out.append((langs[k], share, close))
            pred, score, close = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def op5_lang_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False)))
    return predict(docs, model).select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")
