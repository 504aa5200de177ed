"""Periodic runs of words by the linear method for tandem repeats of Gusfield and Stoye.

A run is a stretch of consecutive words with smallest period q and max(least, 2 q) words or more that no neighbouring
word extends with that period. One pass over the texts, in which every text is worked on by itself:

1. a run's words are all covered by windows of least / 2 words that occur twice in the text. Stretches of words that such
   windows cover are looked at, each by itself; most texts have none;
2. naming of all substrings of 1, 2, 4 ... words gives the suffix tree in the form of a suffix array, and the longest common
   extension of any two places, forwards and backwards, in as many steps as the names have levels;
3. Lempel-Ziv blocks: the first occurrence of every square crosses the beginning of a block, so that extensions around
   these, for periods up to the sizes of the two blocks, find leftmost squares as maximal stretches;
4. walks along suffix links go from each leftmost square to its rotations and complete the vocabulary of squares;
5. a square's occurrences are the leaves below its place in the tree, an interval of the suffix array; those at
   consecutive places merge into runs.

Only squares whose root is no repetition itself take part, so that there are O(n log n) occurrences. Memory is four bytes times
log2(n) for a word of a stretch of n words that repeat; the other words of a text take a few dozen bytes.

Defined cases: null and empty texts have no words and no runs; rows that repeat, share an id or have none are worked on one by
one; an empty table gives no rows; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.llm.common import map_batches, table
from forecourt.llm.near_dup import GOLDEN, Powers, mix
from forecourt.llm.words import Words, grams

LEAST = 12


class Extensions:
    """Names of the substrings of 1, 2, 4 ... symbols, until all are different; the suffix array; longest common extensions."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.levels, size = [], 1
        while True:
            self.levels.append(np.append(rank, -1).astype(np.int32))
            if rank.max(initial=-1) == n - 1:
                break
            after = np.zeros(n, np.int64)  # 0: the text ends before
            after[: max(0, n - size)] = rank[size:] + 1
            rank, size = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64), 2 * size
        self.rank, self.suffixes = rank, np.argsort(rank)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a on equal those from b on; a and b differ."""
        a, b, found = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for i in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[i][a] == self.levels[i][b]).astype(np.int64) << i
            a, b, found = a + step, b + step, found + step
        return found

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols that end at a equal those that end at b, going backwards."""
        a, b, found = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for i in range(len(self.levels) - 1, -1, -1):
            x, y = a - (1 << i) + 1, b - (1 << i) + 1
            step = ((x >= 0) & (y >= 0) & (self.levels[i][np.maximum(x, 0)] == self.levels[i][np.maximum(y, 0)])).astype(np.int64) << i
            a, b, found = a - step, b - step, found + step
        return found


def blocks(tree: Extensions) -> np.ndarray:
    """Beginnings of the Lempel-Ziv blocks: the longest prefix of the rest that also begins before it, or a new symbol."""
    n = len(tree.suffixes)
    before, after, open_ = [n] * n, [n] * n, []
    for x in tree.suffixes.tolist():  # the nearest suffixes in order that begin before x
        while open_ and open_[-1] > x:
            after[open_.pop()] = x
        if open_:
            before[x] = open_[-1]
        open_.append(x)
    at = np.arange(n)
    sizes = np.maximum(tree.forward(at, np.array(before)), tree.forward(at, np.array(after))).tolist()
    found, i = [], 0
    while i < n:
        found.append(i)
        i += max(1, sizes[i])
    return np.array([*found, n])


def leftmost_stretches(tree: Extensions, least: int) -> np.ndarray:
    """Rows (start, end, period) of maximal stretches that cross the beginning of a block, with the least period of each."""
    cuts = blocks(tree)
    h, size, earlier = cuts[1:-1], np.diff(cuts)[1:], np.diff(cuts)[:-1]

    def periods(most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = np.repeat(h, most)
        return places, np.arange(len(places)) - np.repeat(np.cumsum(most) - most, most) + 1

    a, k = periods(size)
    right = (a - tree.backward(a - 1, a + k - 1), a + k + tree.forward(a, a + k), k)
    a, k = periods(np.minimum(size + earlier, h))
    left = (a - k - tree.backward(a - 1, a - 1 - k), a + tree.forward(a, a - k), k)
    start, end, k = (np.concatenate(x) for x in zip(right, left, strict=True))
    kept = end - start >= np.maximum(2 * k, least)
    start, end, k = start[kept], end[kept], k[kept]
    order = np.lexsort((k, end, start))
    start, end, k = start[order], end[order], k[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return np.stack((start[first], end[first], k[first]), 1)


def vocabulary(tree: Extensions, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and period of one square of each kind: the leftmost ones of the stretches and, by suffix links, their rotations."""
    start, end, k = stretches.T
    many = np.minimum(k, end - start - 2 * k + 1)
    period = np.repeat(k, many)
    place = np.repeat(start, many) + np.arange(len(period)) - np.repeat(np.cumsum(many) - many, many)
    level = np.minimum(np.log2(2 * period).astype(np.int64), len(tree.levels) - 1)  # names of the last level are all different
    names = np.zeros((2, len(period)), np.int64)
    for i in np.unique(level):
        own = level == i
        names[:, own] = tree.levels[i][place[own]], tree.levels[i][place[own] + 2 * period[own] - (1 << i)]
    _, first = np.unique(np.stack((period, *names)), axis=1, return_index=True)
    return place[first], period[first]


def runs(symbols: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence, by start and period."""
    none = np.zeros((0, 3), np.int64)
    if len(symbols) < least:
        return none
    tree = Extensions(symbols)
    stretches = leftmost_stretches(tree, least)
    if not len(stretches):
        return none
    place, period = vocabulary(tree, stretches)
    common = [0, *tree.forward(tree.suffixes[:-1], tree.suffixes[1:]).tolist(), 0]  # of each suffix and the one before in order
    low, high = [], []
    for r, size in zip(tree.rank[place].tolist(), (2 * period).tolist(), strict=True):
        a, b = r, r + 1
        while common[a] >= size:
            a -= 1
        while common[b] >= size:
            b += 1
        low.append(a)
        high.append(b)
    low, many = np.array(low), np.array(high) - np.array(low)
    leaf = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    k, at = np.repeat(period, many), tree.suffixes[leaf]
    order = np.lexsort((at, k))
    k, at = k[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    found = np.stack((at[first], at[last] - at[first] + 2 * k[first], k[first]), 1)
    found = found[found[:, 1] >= least]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def repeating(words: Words, hashes: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Stretches (first word, end) of a row that its windows of `size` words which occur in it again cover."""
    n = len(hashes) - size + 1
    if n <= 0:
        return []
    at = np.flatnonzero(words.of[:n] == words.of[size - 1 :])
    keys = mix(grams(hashes, size)[at] ^ (words.of[at].astype(np.uint64) + np.uint64(1)) * GOLDEN)
    order = np.argsort(keys)
    equal = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    at = at[again]
    if not len(at):
        return []
    new = np.flatnonzero((at[1:] > at[:-1] + size) | (words.of[at[1:]] != words.of[at[:-1]])) + 1
    return list(zip(at[np.append(0, new)].tolist(), (at[np.append(new, len(at)) - 1] + size).tolist(), strict=True))


def find_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id_col, n_words, runs (array<struct<start, length, period>> of word numbers, by start and period), and text without the repeated words of runs, joined by one space."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            words = Words(batch.column(1))
            hashes = words.hashes(powers)
            change, found, rows = np.zeros(len(hashes) + 1, np.int64), [], []
            for a, b in repeating(words, hashes, least // 2):
                row, own = words.of[a], runs(hashes[a:b], least)
                if len(own):
                    np.add.at(change, a + own[:, 0] + own[:, 2], 1)
                    np.add.at(change, a + own[:, 0] + own[:, 1], -1)
                    found.append(own + [a - words.first[row], 0, 0])
                    rows += [row] * len(own)
            values = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, i])) for i in range(3)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(np.array(rows, np.int64), np.arange(words.n_rows + 1)).astype(np.int32)), structs)
            kept = np.cumsum(change[:-1]) == 0
            columns = [batch.column(0), pa.array(np.diff(words.first)), lists, pa.array(words.joined(kept), pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "runs", "text"])

    return map_batches(docs.select(id_col, text_col), run, f"{id_col} {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string")


def with_repetitions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text; texts of a tenth of the ids (by crc32 h of the id's text) end in a repetition of their own words.

    With n words, g = h // 10 and a = g % n, word i >= a becomes word a + (i - a) % p, where p = 1 + (n - a) // (3 + g % 8).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.array([1 if x is None else zlib.crc32(str(x).encode()) for x in batch.column(0).to_pylist()], np.int64)
            chosen = hashes % 10 == 0
            texts = batch.column(1)
            words = Words(texts.filter(pa.array(chosen)))
            data, out = words.data.tobytes(), []
            for g, low, high in zip((hashes[chosen] // 10).tolist(), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                own = [data[s:e] for s, e in zip(words.starts[low:high].tolist(), words.ends[low:high].tolist(), strict=True)]
                if n := len(own):
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    own = own[:a] + [own[a + i % p] for i in range(n - a)]
                out.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.replace_with_mask(texts, pa.array(chosen), pa.array(out, pa.binary()).cast(texts.type))], names=[id_col, text_col])

    return map_batches(docs.select(id_col, text_col), run, f"{id_col} {kind}, {text_col} string")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_repetitions(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("_best", longest)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("(1000 * _best.length) div (- _best.period)").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"), "n_words",
    )
