"""Phrase collocations against brute force."""

import collections
import random
import re

import pytest

from forecourt.llm import collocations

SCHEMA = "doc_id int, text string, lang string, phrase string, n int"


def brute(rows, longest, least, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = collections.defaultdict(list)
    common = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    for (lang, p), a in common.items():
        if any(g == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in common.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in found.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def corpus(seed):
    rng = random.Random(seed)
    names = ["The", "of", "é", "Straße", "x-y", "中", "a b", *(f"w{i}" for i in range(12))]
    phrases = [[rng.choice(names) for _ in range(rng.randrange(2, 8))] for _ in range(6)]
    rows = []
    for i in range(150):
        words = [w for _ in range(rng.randrange(8)) for w in (rng.choice(phrases) if rng.random() < 0.5 else [rng.choice(names)])]
        rows.append((i, "".join(w + rng.choice([" ", " ", "\t ", ", ", ".", "\n", " ;! ", "\x0b"]) for w in words), rng.choice(["en", "en", "de", None, "und", ""])))
    return [*rows, (900, None, "en"), (901, "", "fr"), (902, " . ", None), rows[3], rows[3]]


@pytest.mark.parametrize("seed,least,top", [(0, 3, 2000), (1, 8, 5), (2, 300, 10)])
def test_equals_brute_force(spark, monkeypatch, seed, least, top):
    monkeypatch.setattr(collocations, "BUCKETS", 1 << 17 if seed else 1 << 16)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "other", 1) for r in rows], SCHEMA).repartition(3)
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=least, top=top).collect()) == brute(rows, 5, least, top)


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_exact_products_beyond_64_bits(spark):
    a, n = 3_000_000_007, 9_000_000_000_011
    frequent = spark.createDataFrame([("x", "p", 1, 3_000_000_019), ("x", "q", 1, 3_000_000_021), ("x", "p q", 2, a)], "lang string, phrase string, size int, f bigint")
    got = collocations.scored(frequent, spark.createDataFrame([("x", n)], "lang string, n bigint")).collect()
    assert [(r["score"], r["l"], r["r"]) for r in got] == [(1000 * a * n // (3_000_000_019 * 3_000_000_021), 3_000_000_019, 3_000_000_021)]


def test_chunks_and_batches_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKETS", 1 << 16)
    monkeypatch.setattr(collocations, "CHUNK", 500)
    rows = corpus(5)
    docs = spark.createDataFrame([(*r, "other", 1) for r in rows], SCHEMA).coalesce(1)
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=4, top=2000).collect()) == brute(rows, 5, 4, 2000)
