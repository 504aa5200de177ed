"""Ranges of string ids: even for ids with a long common beginning, and the next text as by brute force."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from forecourt.llm import merkle


def _docs(spark, ids):
    return spark.createDataFrame([(x, f"text {i}. of {x}") for i, x in enumerate(ids)], "doc_id string, text string")


def test_urls_and_an_odd_id_have_even_ranges(spark):
    urls = spark.range(20_000).select(F.format_string("https://example.org/page/%d", F.col("id") * 7919 % 100_003).alias("doc_id"))
    docs = urls.unionByName(spark.createDataFrame([("a",), ("zz",), (None,)], "doc_id string")).withColumn("text_hash", F.xxhash64("doc_id"))
    counts = [r["count"] for r in merkle.with_ranges(docs).groupBy("range").count().collect()]
    assert sum(counts) == 20_003 and max(counts) <= 1000


@pytest.mark.parametrize("sample", [1, 8, 1 << 14])
def test_next_by_string_ids(spark, monkeypatch, sample):
    monkeypatch.setattr(merkle, "SAMPLE", sample)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 1)
    monkeypatch.setattr(merkle, "QUANTILES", 8)
    ids = ["", "a", "ab", "ab\0", "ab\0\0", "é", "z" * 300, "日本", "😀", *(f"https://example.org/page/{i}" for i in range(40))] + ["hot"] * 30
    got = merkle.with_next(_docs(spark, ids)).collect()
    assert len(got) == len(ids)
    after = {r["text"]: r["next_text"] for r in got}
    chain, at = [], next(r["text"] for r in got)
    for _ in ids:
        chain.append(at)
        at = after[at]
    assert at == chain[0] and len(set(chain)) == len(ids)
    names = [ids[int(x.split(".")[0].split()[1])].encode() for x in chain]
    assert sum(a < b for a, b in zip(names, names[1:] + names[:1], strict=True)) == 1  # falls but for the step from the last to the first
