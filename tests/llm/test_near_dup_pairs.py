"""How many pairs the exact join of large buckets compares, and that it finds every link."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np

from forecourt.llm import near_dup


def _node(i: int) -> bytearray:
    return bytearray(i.to_bytes(16, "big"))


def _seq(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) for w in words], "<u4")


def test_a_large_class_and_the_rest_of_its_bucket(spark, monkeypatch):
    """80 near copies of one class, 40 texts that share most of their words but reach 0.8 with none, and six that do."""
    rng = random.Random(4)
    some = [f"w{i}" for i in range(600)]
    base = [f"b{i}" for i in range(150)]

    def edited(n: int) -> list[str]:
        out = list(base)
        for at in rng.sample(range(len(out)), n):
            out[at] = rng.choice(some)
        return out

    texts = [edited(3) for _ in range(80)] + [edited(40) for _ in range(40)] + [edited(11) for _ in range(6)]
    seqs = [_seq(x) for x in texts]
    table = spark.createDataFrame([(_node(i), bytearray(x.tobytes())) for i, x in enumerate(seqs)], "node binary, seq binary")
    places = spark.createDataFrame([(7, _node(i)) for i in range(len(texts))], "key long, node binary")
    parts = spark.createDataFrame([(_node(i), _node(0)) for i in range(80)], "node binary, class binary")
    compared, real = [], near_dup.verified

    def counted(pairs, seqs):
        compared.extend((bytes(r["a"]), bytes(r["b"])) for r in pairs.collect())
        return real(pairs, seqs)

    monkeypatch.setattr(near_dup, "verified", counted)
    got = {tuple(sorted(int.from_bytes(r[c], "big") for c in "ab")) for r in near_dup.across_components(places, parts, table).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if j >= 80 and near_dup.aligned_similarity(seqs[i], seqs[j]) >= near_dup.SIMILARITY}
    assert got == want and len(want) > 100
    assert len(compared) == len(set(compared)) <= 1.5 * len(want)


def test_signatures_bound_what_two_texts_share(spark):
    rng = random.Random(5)
    texts = [[f"w{rng.randrange(k)}" for _ in range(n)] for k in (3, 40, 3000) for n in (1, 9, 150, 4000)]
    texts += [x[: len(x) // 2] + ["x", "x"] + x[len(x) // 2 :] for x in texts]
    seqs = [_seq(x) for x in texts]
    rows = spark.createDataFrame([(_node(i), bytearray(x.tobytes())) for i, x in enumerate(seqs)], "node binary, seq binary")
    sigs = {int.from_bytes(r["node"], "big"): np.array(r["sig"], np.int64).view(np.uint8) for r in near_dup.signatures(rows).collect()}
    own = [near_dup.with_occurrences(x) for x in seqs]
    for i, j in itertools.combinations(range(len(texts)), 2):
        differing = int(np.unpackbits(sigs[i] ^ sigs[j]).sum())
        assert len(np.intersect1d(own[i], own[j])) <= (len(own[i]) + len(own[j]) - differing) / 2


def test_pairs_are_aligned_once(spark):
    rows = spark.createDataFrame([(_node(i), bytearray(_seq(["a", "b", "c"]).tobytes())) for i in range(4)], "node binary, seq binary")
    pairs = spark.createDataFrame([(_node(i), _node(j)) for i, j in itertools.combinations(range(4), 2)], "a binary, b binary")
    seen, real = [], near_dup.materialize

    def kept(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    near_dup.materialize = kept
    try:
        assert near_dup.verified(pairs, rows).count() == 6
    finally:
        near_dup.materialize = real
    assert seen[0].count("ArrowEvalPython") == 1
