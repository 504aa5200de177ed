"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding lower-cases, takes letters apart from their accents, maps look-alike letters of other scripts to Latin,
reads digits as the letters they stand for, and signs too where a letter is on both sides. The automaton holds terms
(whole words and beginnings of words of four to eight letters) and exception phrases; a term inside an exception
phrase doesn't count, and of several terms that begin at the same word the heaviest counts. The sum of weights is
divided by the square root of the number of words.

The lexicon is learned from at most MAX_ROWS labelled rows, in the order of a hash of the id: words and word
beginnings whose document counts differ between the classes by more than chance (log-likelihood ratio), weighted by
their smoothed log odds. Two-word phrases around a term that occur in clean rows only become exceptions. All terms and
phrases of the sample that pass are taken. The threshold is the one of best F1 on these rows; the score is
x / (x + threshold).

Defined cases: null counts as empty and has score 0, and so has a text without words; without labels the seed terms
alone are used; rows that repeat are each scored; several labels of an id count as the largest; ids with equal hashes
are taken by id; whole texts are scored whatever their length; an empty table gives no rows; other columns stay as they
are, and where toxicity_score or toxicity_hits is taken the result has the next free name (toxicity_score_1, ...).
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.llm.common import BATCH_ROWS, crc_mod, is_held_out, labelled_sample, map_batches, new_name, own_columns, table

MAX_ROWS = 8000
PREFIXES = range(4, 9)
#: Log-likelihood ratio over which a term's counts differ by more than chance, given how many terms are tried.
LEAST_G2 = 27.0
SEED = {"idiot": 3.0, "moron": 3.0, "stupid": 2.5, "scum": 3.0, "pathetic": 2.5, "worthless": 2.5, "loser": 2.5, "disgusting": 2.5}
EXCEPTIONS = ("idiot proof", "worthless stock", "clown fish", "trash can", "trash bin", "sore loser")
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ß": "ss", "ø": "o", "ł": "l",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
TABLE = str.maketrans(LOOKALIKES | DIGITS)
WORD = re.compile(r"[^\W_]+")
SIGN_INSIDE = re.compile(r"(?<=[^\W\d_])[@$!|](?=[^\W\d_])")


def fold_words(text: str) -> list[str]:
    """Words of the folded text."""
    text = text.lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = text.translate(TABLE)
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = SIGN_INSIDE.sub(lambda m: SIGNS[m[0]], text)
    return WORD.findall(text)


class Lexicon:
    """Weights of keys (" word " or " beginning") and exception phrases (" two words "), as an automaton."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        import ahocorasick

        self.tree = ahocorasick.Automaton()
        for key, w in weights.items():
            self.tree.add_word(key, (len(key), w))
        for phrase in exceptions:
            self.tree.add_word(phrase, (len(phrase), None))
        self.empty = len(self.tree) == 0
        if not self.empty:
            self.tree.make_automaton()

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """(place of the word in the folded text, weight) of every term that counts."""
        if self.empty or not words:
            return []
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in self.tree.iter(f" {' '.join(words)} "):
            at = end - n + 1
            if w is None:
                spared.append((at, end - 1))  # the space after a phrase may begin another word
            elif w > found.get(at, 0):
                found[at] = w
        out, k, reach = [], 0, -1
        spared.sort()
        for at, w in sorted(found.items()):
            while k < len(spared) and spared[k][0] <= at:
                reach, k = max(reach, spared[k][1]), k + 1
            if at >= reach:
                out.append((at, w))
        return out

    def density(self, text: str) -> tuple[float, int]:
        """Weight of all hits over the square root of the words; number of hits."""
        words = fold_words(text)
        hits = self.hits(words)
        return sum(w for _, w in hits) / math.sqrt(max(1, len(words))), len(hits)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold each word or beginning; the sample is bounded."""
    counts = (Counter(), Counter())
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(fold_words(text or ""))
            terms = {f" {w} " for w in words}
            terms.update(f" {w[:n]}" for w in words for n in PREFIXES if len(w) >= n)
            counts[label].update(terms)
    for label in (0, 1):
        items = list(counts[label].items())
        for at in range(0, len(items), 20_000):
            part = items[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.string()), pa.array([label] * len(part), pa.int32()), pa.array([n for _, n in part], pa.int64())], names=["term", "label", "n"])


def _log_likelihood(a, c, toxic: int, clean: int):
    """Twice the log-likelihood ratio of a term in a of the toxic and c of the clean rows."""
    share = (a + c) / F.lit(float(toxic + clean))
    part = lambda k, n, p: F.when(k > 0, k * F.log(k / (p * n))).otherwise(0.0)
    return 2 * (part(a, toxic, share) + part(c, clean, share) + part(toxic - a, toxic, 1 - share) + part(clean - c, clean, 1 - share))


def _phrases(sample: DataFrame, weights: dict[str, float]) -> list[str]:
    """Two-word phrases around a term that at least three clean rows and no toxic row hold."""
    terms = sample.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms.value, [])
        for batch in batches:
            out = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = fold_words(text or "")
                joined, near = f" {' '.join(words)} ", set()
                for at, _ in lexicon.hits(words):
                    end = joined.index(" ", at + 1)
                    if end + 1 < len(joined):
                        near.add(joined[at : joined.index(" ", end + 1) + 1])
                    if at > 0:
                        near.add(joined[joined.rindex(" ", 0, at) : end + 1])
                out += [(x, label) for x in near]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32())], names=["phrase", "label"])

    found = map_batches(sample, run, "phrase string, label int").groupBy("phrase").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
    return [r["phrase"] for r in found.where("toxic = 0 and n >= 3").orderBy(F.desc("n"), "phrase").collect()]


def drop_vague(terms: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Weights without the beginnings whose toxic rows a longer, more telling term has nearly all of."""
    kept, by = {}, sorted(terms)
    for i, term in enumerate(by):
        a, w = terms[term]
        longer = itertools.takewhile(lambda x: x.startswith(term), by[i + 1 :])  # noqa: B023
        if not any(terms[x][0] >= 0.8 * a and terms[x][1] > w + 0.1 for x in longer):
            kept[term] = w
    return kept


def fit(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> tuple[dict[str, float], list[str], float]:
    """Weights, exception phrases and the threshold."""
    sample = labelled_sample(docs, labels, label, keep, MAX_ROWS).select("label", "text")
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    weights = {f" {k} ": w for k, w in SEED.items()}
    exceptions = [f" {x} " for x in EXCEPTIONS]
    if toxic and clean:
        counts = map_batches(sample, _term_counts, "term string, label int, n bigint").groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).cast("double").alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).cast("double").alias("c"))
        odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
        found = counts.where(F.col("a") >= 3).select("term", "a", odds.alias("w"), _log_likelihood(F.col("a"), F.col("c"), toxic, clean).alias("g2"))
        terms = found.where((F.col("g2") >= LEAST_G2) & (F.col("w") > 2)).orderBy(F.desc("g2"), "term").collect()
        weights |= drop_vague({r["term"]: (float(r["a"]), float(r["w"])) for r in terms})
        exceptions += _phrases(sample, weights)
    model = (weights, exceptions, 1.0)
    rows = [(r["x"], r["label"]) for r in _densities(sample, model).collect()]  # MAX_ROWS at most
    return weights, exceptions, best_threshold(rows)


def best_threshold(rows: list[tuple[float, int]]) -> float:
    """The threshold of best F1; in the gap it falls in, two fifths of the way from the lower value."""
    total = sum(y for _, y in rows)
    best, at, hit, took = 0.0, 0.5, 0, 0
    by = sorted(rows, reverse=True)
    for i, (x, y) in enumerate(by):
        hit, took = hit + y, took + 1
        low = by[i + 1][0] if i + 1 < len(by) else 0.0
        if x > 0 and low < x and 2 * hit / (took + total) > best:
            best, at = 2 * hit / (took + total), low + 0.4 * (x - low)
    return max(at, 1e-3)


def _densities(sample: DataFrame, model: tuple) -> DataFrame:
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value[0], shared.value[1])
        for batch in batches:
            found = [lexicon.density(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], names=["label", "x", "hits"])

    return map_batches(sample, run, "label int, x double, hits bigint")


def scored_column(spark: SparkSession, model: tuple[dict[str, float], list[str], float]) -> Column:
    """struct<score, hits> of the column text, by a vectorized function over small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    shared = spark.sparkContext.broadcast(model)

    def scored(parts):
        weights, exceptions, threshold = shared.value
        lexicon = Lexicon(weights, exceptions)
        for texts in parts:
            found = [lexicon.density(x or "") for x in texts]
            x = np.array([a for a, _ in found], np.float64)
            yield pd.DataFrame({"score": x / (x + threshold), "hits": [n for _, n in found]})

    scored.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(scored, "struct<score: double, hits: bigint>")("text")


def score(docs: DataFrame, model: tuple[dict[str, float], list[str], float]) -> DataFrame:
    """All columns of docs, and toxicity_score and toxicity_hits."""
    own = new_name(docs, "toxicity")
    found = docs.withColumn(own, scored_column(docs.sparkSession, model))
    return found.select(*own_columns(docs), *(F.col(f"{own}.{x}").alias(new_name(docs, f"toxicity_{x}")) for x in ("score", "hits")))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[str], float]:
    return fit(docs, labels, "toxic", F.coalesce(crc_mod("doc_id", 5) != 0, F.lit(False)))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under the threshold, with their own columns."""
    own = new_name(docs, "toxicity")
    found = docs.withColumn(own, scored_column(docs.sparkSession, learn(docs, labels)))
    return found.where(F.col(f"{own}.score") < threshold).select(*own_columns(docs))


def op7_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs.select("doc_id", "text"), learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", is_held_out("doc_id", 5, 0).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"), F.col("toxicity_hits").alias("hits"))
