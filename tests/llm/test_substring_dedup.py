"""Substring deduplication against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from forecourt.llm import substring_dedup

SCHEMA = "doc_id bigint, text string, longest string, at int"


def brute(rows, length):
    """(n_words, n_removed, kept), and the bounds of longest, of each row, in order."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    after = lambda a, b: b is not None and (a is None or a > b)
    out = []
    for (key, text), own in zip(rows, words, strict=True):
        def late(n, key=key, own=own):
            there = {tuple(w[i : i + n]) for (k, _), w in zip(rows, words, strict=True) if after(key, k) for i in range(len(w) - n + 1)}
            return [i for i in range(len(own) - n + 1) if tuple(own[i : i + n]) in there]

        gone = {i + j for i in late(length) for j in range(length)}
        most, n = 0, length
        while late(n):
            most, n = n, 2 * n
        least = max((x for i in range(9) if (x := length << i) and (late(x + length - 1) or i == 0 and gone)), default=0)
        if text is not None and len(own) >= length and any(t == text and after(key, k) for k, t in rows):
            least = most = len(own)
        out.append((len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone), least, most))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bb", "ccc", "é", " x", "dd.", "中文"]) if rng.random() < 0.3 else str(rng.randrange(400))
    passages = [[word() for _ in range(rng.choice([4, 12, 13, 14, 26, 30, 60, 110]))] for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [[word() for _ in range(rng.randrange(20))]]
        for _ in range(rng.randrange(4)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = word()
            parts += [p, [word() for _ in range(rng.randrange(9))]]
        text = "".join(w + rng.choice([" ", " ", "\n", "\t ", "\r\n", "\x0b"]) for p in parts for w in p)
        rows.append((i, text))
    rows += [(100 + i, rows[i][1]) for i in range(9)]  # copies
    rows += [(5, rows[6][1]), (7, rows[7][1]), (None, rows[8][1]), (None, rows[2][1] + " more"), (200, None), (201, ""), (202, " \n"), (203, "one"), (204, "one"), (-3, rows[20][1])]
    rows += [(300, "x " * 40), (301, "x " * 30), (302, "w" * 3000 + " " + "x " * 13)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,length", [(0, 13), (1, 13), (2, 4)])
def test_removal_equals_brute_force(spark, seed, length):
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, t, "other", 1) for k, t in rows], SCHEMA).repartition(5)
    found = substring_dedup.remove_repeated(docs, length).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"], r["longest"]) for r in found)
    want = sorted((str(k), *x) for (k, _), x in zip(rows, brute(rows, length), strict=True))
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert all(least <= x[4] <= most for x, (*_, least, most) in zip(got, want, strict=True))
    assert len({x[4] for x in got}) > 3
    for r in found:
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]


def test_empty_table_and_text_ids(spark):
    assert substring_dedup.remove_repeated(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    line = " ".join(map(str, range(20)))
    docs = spark.createDataFrame([("b", line), ("a", f"z {line}"), ("c", line)], "doc_id string, text string")
    assert {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeated(docs).collect()} == {"a": f"z {line}", "b": "", "c": ""}


def test_a_frequent_passage_in_a_long_text(spark):
    """A passage of all documents, and a text of a million words."""
    line = " ".join(f"p{i}" for i in range(30))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{line} d"), "id").alias("text"))
    long = spark.createDataFrame([(9000, " ".join(f"u{i}" for i in range(1_000_000)) + " " + line)], "doc_id bigint, text string")
    found = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeated(docs.unionByName(long)).select("doc_id", "n_removed", F.sha2("text", 256).alias("kept")).collect()}
    assert found[0][0] == 0 and all(found[i][0] == 30 for i in [*range(1, 3000), 9000])
    assert found[17][1] == hashlib.sha256(b"d17").hexdigest()
