"""Exact substring deduplication by level-wise doubling of repeated windows.

A window is `length` consecutive words of one document. A word goes if a window that covers it also starts in a
document with a smaller id. Windows repeated at one length alone are looked at at the next:

1. half: every window of 13 words holds seven windows of seven; the one with the least hash stands for it. Only these
   (a quarter of all places) are shuffled, and only those that two documents share survive;
2. whole: the windows of 13 words whose half survived, compared by 80 bits of their hash over all documents. They
   say which words go;
3. doubled: a window of twice the length is two repeated windows that follow each other, named by their names, and only
   where the first was repeated at half the length: 26, 52, 104 ... words, until no candidate survives. They say how far
   repetitions go; of these lengths one window in seven is looked at, at places that equal passages agree on.

Equal texts are settled first by a digest: all but those of the least id go as a whole (from `length` words on) and take part
in no level after the first. Every level groups by partial aggregates and joins the places back, which the adaptive
skew join can split, so that no task needs all places of a frequent window; only one document's places meet in a row.
Shuffle files of a finished step are deleted with it (spark.sql.shuffleDependency.fileCleanup.enabled, which is set in the session).

Defined cases: null and empty texts have no words; rows that repeat have the same result each, and rows of one id, whatever
their texts, are no smaller document to one another; rows without an id come after all others; an empty table gives
no rows; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.llm.common import discard, map_batches, materialize, table
from forecourt.llm.near_dup import ODD, Powers, mix
from forecourt.llm.words import Words, grams

LENGTH = 13


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each `width` consecutive values, the place of the least (the first of several)."""
    best, at, done = values, np.arange(len(values)), 1
    while done < width:
        step = min(done, width - done)
        left, right = best[: len(best) - step], best[step:]
        less = right < left
        best, at, done = np.where(less, right, left), np.where(less, at[step:], at[: len(at) - step]), done + step
    return at


def window_halves(words: Words, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window within a row, the word where its half begins, and the hashes of the halves by their first word."""
    half = (length + 1) // 2
    n = len(hashes) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    halves = grams(hashes, half)
    at = least_places(halves, length - half + 1)
    starts = np.flatnonzero(words.of[:n] == words.of[length - 1 :])
    return starts, at[starts], halves


def anchors(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """h, id, pos (word number) of the halves that stand for a window."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            words = Words(batch.column(1))
            _, at, halves = window_halves(words, words.hashes(powers), length)
            at = np.unique(at)
            rows = words.of[at]
            columns = [pa.array(halves[at].view(np.int64)), batch.column(0).take(pa.array(rows)), pa.array((at - words.first[rows]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "id", "pos"])

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"h bigint, id {kind}, pos int")


def in_several(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that rows of different ids share, with the least id."""
    found = rows.groupBy(*keys).agg(F.min("id").alias("least"), F.max("id").alias("most"), F.max(F.col("id").isNull()).alias("none"))
    return found.where("least != most or (none and least is not null)").select(*keys, "least")


def comes_after(least: str = "least") -> Column:
    return F.col(least).isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col(least)))


def whole_windows(texts: DataFrame, length: int) -> DataFrame:
    """a, b (80 bits of hash), id, th, pos of the windows whose half begins at one of the row's places `at`. texts: id, th, text, at."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            words = Words(batch.column(2))
            hashes = words.hashes(powers)
            starts, at, _ = window_halves(words, hashes, length)
            lists = batch.column(3)
            wanted = np.zeros(len(hashes) + 1, bool)
            places = words.first[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))] + lists.flatten().to_numpy(zero_copy_only=False)
            wanted[places[places < len(wanted)]] = True  # other rows of the same id may be longer
            starts = starts[wanted[at]]
            n = max(0, len(hashes) - length + 1)
            other = np.zeros(n, np.uint64)
            for i in range(length):
                other = other * np.uint64(ODD) + hashes[i : n + i]
            rows = words.of[starts]
            take = pa.array(rows)
            columns = [pa.array(grams(hashes, length)[starts].view(np.int64)), pa.array((mix(other[starts]) >> np.uint64(48)).astype(np.uint16).view(np.int16)), batch.column(0).take(take), batch.column(1).take(take), pa.array((starts - words.first[rows]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "id", "th", "pos"])

    return map_batches(texts.select("id", "th", "text", "at"), run, f"a bigint, b smallint, id {kind}, th int, pos int")


def chains(repeated: DataFrame, length: int) -> DataFrame:
    """n, a, b, id, th, pos of windows of n = 2 length, 4 length ... words that are made of repeated ones, named by the names of their halves.

    They begin where of `length` repeated windows that begin one after another the one with the least name begins, so that a
    passage that two documents share has its windows at the same places in both.
    """
    kind = repeated.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, a, b = (x.to_numpy(zero_copy_only=False) for x in batch.column(2).flatten().flatten())
            rows = np.repeat(np.arange(len(batch)), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            place = (rows.astype(np.int64) << 32) + pos
            place, order = np.unique(place, return_index=True)  # rows that repeat have each place as often
            pos, rows = pos[order], rows[order]
            a, b = a[order].astype(np.int64).view(np.uint64), b[order].astype(np.int16).view(np.uint16).astype(np.uint64)
            m = max(0, len(place) - length + 1)
            chosen = np.zeros(len(place), bool)
            if m:
                chosen[least_places(a, length)[place[length - 1 :] == place[:m] + length - 1]] = True
            at, n = np.arange(len(place)), length  # where windows of n words begin, all of whose parts are repeated
            while len(at):
                own = place[at]
                to = np.minimum(np.searchsorted(own, own + n), len(at) - 1)
                first = np.flatnonzero(own[to] == own + n)
                to = to[first]
                a, b = mix(mix(a[first]) + a[to] * np.uint64(ODD)), mix(mix(b[first] + a[first]) * np.uint64(ODD) + b[to] + a[to]) >> np.uint64(48)
                at, n = at[first], 2 * n
                kept = chosen[at]
                places = at[kept]
                take = pa.array(rows[places])
                columns = [pa.array(np.full(len(places), n, np.int32)), pa.array(a[kept].view(np.int64)), pa.array(b[kept].astype(np.uint16).view(np.int16)), batch.column(0).take(take), batch.column(1).take(take), pa.array(pos[places].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["n", "a", "b", "id", "th", "pos"])

    return map_batches(repeated.select("id", "th", "w"), run, f"n int, a bigint, b smallint, id {kind}, th int, pos int")


def extended(level: DataFrame, length: int) -> DataFrame:
    """Written (id, th, longest): the greatest of 2 length, 4 length ... at which a window of a row is also in a smaller document."""
    longer = materialize(chains(level, length), "chains")
    n, found, alive = 2 * length, [], None
    while True:
        windows = longer.where(F.col("n") == n).drop("n")
        if alive is not None:  # only what was repeated at half the length
            windows = windows.join(alive, windows["id"].eqNullSafe(alive["id"]) & (windows["th"] == alive["th"]) & (windows["pos"] == alive["pos"]), "left_semi")
        shared = materialize(in_several(windows, "a", "b"), "shared")
        kept = materialize(windows.join(shared.hint("shuffle_hash"), ["a", "b"]).select("id", "th", "pos", comes_after().alias("late")), "alive")
        discard(shared, *([alive] if alive is not None else []))
        alive = kept
        if alive.isEmpty():
            break
        found.append(materialize(alive.where("late").select("id", "th", F.lit(n).alias("longest")).distinct(), "reached"))
        n *= 2
    discard(longer, alive)
    if not found:
        return level.select("id", "th", F.lit(0).alias("longest")).limit(0)
    longest = materialize(functools.reduce(DataFrame.unionByName, found).groupBy("id", "th").agg(F.max("longest").alias("longest")), "longest")
    discard(*found)
    return longest


def repeated_windows(windows: DataFrame) -> DataFrame:
    """Written id, th, w (array of pos, a, b of windows that several documents have), late (places of those that a smaller one has)."""
    shared = materialize(in_several(windows, "a", "b"), "shared")
    kept = windows.join(shared.hint("shuffle_hash"), ["a", "b"])  # a row for each window, a part of which is in a task
    lists = kept.groupBy("id", "th").agg(F.collect_list(F.struct("pos", "a", "b")).alias("w"), F.collect_list(F.when(comes_after(), F.col("pos"))).alias("late"))
    found = materialize(lists, "repeated")
    discard(shared)
    return found


def text_key(text_col: str) -> Column:
    """Tells rows of one id apart."""
    return F.shiftright(F.xxhash64(F.col(text_col)), 32).cast("int")


def equal_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th of the rows whose text a smaller document also has."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("th"), F.md5(F.col(text_col)).alias("digest")).where("digest is not null")
    first = materialize(in_several(rows, "digest"), "first")
    return rows.hint("merge").join(first, "digest").where(comes_after()).select("id", "th").distinct()


def remove_repeated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id_col, n_words, n_removed, removed (array<struct<start, end>> of word numbers), text (what is kept, words joined by one space), longest.

    longest is the greatest length L among `length`, twice, four times ... at which a window of the row was found to start also in
    a document with a smaller id (0 without one): exact for `length`, and never missed where both share L + length - 1
    words in a row. For a text that a smaller document has as a whole it is its number of words.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.shuffleDependency.fileCleanup.enabled", "true")
    copies = materialize(equal_texts(docs, id_col, text_col), "copies")
    places = anchors(docs, id_col, text_col, length)
    shared = materialize(in_several(places.select("h", "id"), "h").select("h"), "halves")
    found = materialize(places.join(shared.hint("shuffle_hash"), "h").groupBy("id").agg(F.collect_set("pos").alias("at")), "places")
    discard(shared)
    texts = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("th"), F.col(text_col).alias("text"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"])
    whole = texts.hint("merge").join(found, same(texts, found)).drop(found["id"])
    whole = whole.join(copies.hint("merge"), same(texts, copies) & (texts["th"] == copies["th"]), "left_anti")
    windows = materialize(whole_windows(whole, length), "windows")
    discard(found)
    level = repeated_windows(windows)
    discard(windows)
    late = materialize(level.where(F.size("late") > 0).select("id", "th", "late"), "late")
    longest = extended(level, length)
    discard(level)
    on = lambda a, b: same(a, b) & (a["th"] == b["th"])
    marks = late.join(longest, on(late, longest), "left").select(late["id"], late["th"], "late", F.coalesce("longest", F.lit(length)).alias("longest"), F.lit(False).alias("copy"))
    marks = marks.unionByName(copies.select("id", "th", F.expr("cast(null as array<int>)").alias("late"), F.lit(0).alias("longest"), F.lit(True).alias("copy")))
    marks = materialize(marks, "marks")
    discard(late, longest, copies)
    marked = texts.hint("merge").join(marks, on(texts, marks), "left").select(texts["id"], "text", "late", "longest", F.coalesce("copy", F.lit(False)).alias("copy"))
    return cut(marked, length).withColumnRenamed("id", id_col)


def cut(marked: DataFrame, length: int) -> DataFrame:
    """What is left of each text without the words of its windows `late`, or as a whole where it is a copy."""
    kind = marked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(1))
            counts = np.diff(words.first)
            lists = batch.column(2).fill_null([]) if batch.column(2).null_count else batch.column(2)
            starts = words.first[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))] + lists.flatten().to_numpy(zero_copy_only=False)
            change = np.zeros(len(words.starts) + 1, np.int32)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            copy = np.asarray(batch.column(4).to_numpy(zero_copy_only=False), bool) & (counts >= length)
            gone |= copy[words.of]
            before = np.concatenate(([False], gone[:-1])) & np.concatenate(([False], words.of[1:] == words.of[:-1]))[: len(gone)]
            after = np.concatenate((gone[1:], [False])) & np.concatenate((words.of[1:] == words.of[:-1], [False]))[-len(gone) :] if len(gone) else gone
            a, b = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
            row = words.of[a]
            spans = pa.StructArray.from_arrays([pa.array((x - words.first[row]).astype(np.int32)) for x in (a, b)], names=["start", "end"])
            removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(words.n_rows + 1)).astype(np.int32)), spans)
            n_gone = np.concatenate(([0], np.cumsum(gone)))[words.first]
            longest = np.where(copy, counts, batch.column(3).fill_null(0).to_numpy(zero_copy_only=False))
            columns = [batch.column(0), pa.array(counts), pa.array(np.diff(n_gone)), removed, pa.array(words.joined(~gone), pa.binary()).cast(pa.string()), pa.array(longest.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_removed", "removed", "text", "longest"])

    return map_batches(marked, run, f"id {kind}, n_words bigint, n_removed bigint, removed array<struct<start: int, end: int>>, text string, longest bigint")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"), F.size("removed").alias("n_spans"))


ORACLE = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
d AS (SELECT doc_id, ws, len(ws) AS n FROM docs),
places AS (SELECT doc_id, ws, unnest(range(1, n - {LENGTH - 2})) AS i FROM d WHERE n >= {LENGTH}),
keys AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + {LENGTH - 1}], ' ')) AS k FROM places),
late AS (SELECT doc_id, i FROM keys QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {LENGTH})) AS i FROM late),
spans AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE b IS DISTINCT FROM i - 1) AS n_spans FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM gone) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, n + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, n AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
