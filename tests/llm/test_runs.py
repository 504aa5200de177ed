"""Runs against brute force, and the planted repetitions of the query."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forecourt.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.sampled_from([2, 4, 12]))
def test_runs_of_few_symbols(symbols, least):
    assert [tuple(x) for x in runs.runs(np.array(symbols, np.int64), least).tolist()] == brute(symbols, least)


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_repeated_parts(seed):
    rng = random.Random(seed)
    parts = [[rng.randrange(3 + seed) for _ in range(rng.randrange(1, 15))] for _ in range(5)]
    symbols = [x for _ in range(40) for x in rng.choice(parts) * rng.choice([1, 1, 2, 3, 5])] + [9]
    assert [tuple(x) for x in runs.runs(np.array(symbols), 12).tolist()] == brute(symbols, 12)
    thue = [bin(i).count("1") % 2 for i in range(4096)]  # overlap-free: squares, but no more
    assert len(runs.runs(np.array(thue), 12)) == len(brute(thue[:1], 12)) + len(brute(thue, 12))


def edited(key, words):
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(key, text):
    words = edited(key, WORD.findall(text or ""))
    found = brute(words, 12)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return (str(key), len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)), len(words))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        part = lambda: [rng.choice(["a", "b", "é", "dd", "中"]) for _ in range(rng.randrange(1, 9))]
        words = [w for _ in range(rng.randrange(6)) for w in part() * rng.choice([1, 2, 4])] + [str(rng.randrange(99)) for _ in range(rng.randrange(60))]
        rng.random() < 0.3 and rng.shuffle(words)
        rows.append((i, "".join(w + rng.choice([" ", "\n", "\t ", "\x0b"]) for w in words), "x"))
    rows += [(500, None, "x"), (None, "la " * 20, "x"), (501, "", "x"), (502, " ", "x"), (503, "la " * 11, "x"), (504, "la " * 12, "x"), (3, rows[4][1], "x"), rows[5], rows[5]]
    spark.createDataFrame(rows, "doc_id bigint, text string, runs string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in runs.op13_periodic_runs(spark, str(tmp_path)).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))).collect()]
    assert sorted(got, key=str) == sorted((expected(k, t) for k, t, _ in rows), key=str)


def test_empty_table(spark):
    assert runs.find_runs(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_long_texts(spark):
    """One word a hundred thousand times, and half a million words of which a third are a repetition."""
    line = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, "la " * 100_000), (2, " ".join(f"u{i}" for i in range(300_000)) + f" {line}" * 30)]
    found = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in runs.find_runs(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert found == {1: [(0, 100_000, 1)], 2: [(300_000, 150_000, 5000)]}
