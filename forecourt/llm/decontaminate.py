"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of the hashes of k consecutive words, winnowing keeps the smallest in each window of w neighbours. Two texts
that share t = w + k - 1 words share such a window and therefore a kept hash, so that joining kept hashes misses
no shared span of t words. t is 13 words, and for an item of fewer words its own number of words; each t that
occurs among the items has fingerprints of its own.

1. The kept hashes of a document, for all t at once, are exploded, without its words, and semi-joined with the items'
   hashes. The corpus is read once for this, however many t there are.
2. Only documents with a common hash are joined back to their text. There each word position carries its hash for
   each k and the words around it.
3. A pair of positions is extended over equal words to both sides; t words or more are a hit. Longer spans are
   the union of the hits of their windows.

The items' hashes are written first, and their bytes with the words around them are summed; they are broadcast only up
to BROADCAST_BYTES. Beyond that the same join shuffles both sides, where a frequent hash is split by the adaptive skew
join.

Generators are outer ones: for inner ones the optimizer infers a filter over the whole array expression and
pushes it below the projections, which would put one array's computation inside another's lambda.

Defined cases: null or wordless texts have no words and no hits; items without words have no windows; rows of
documents that repeat each get the result; an item id that repeats counts once; items of equal windows are all
listed; whole texts are read whatever their length; an empty table gives no rows, and no items give no hits; other
columns are ignored.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.llm.common import materialize, own_columns, table

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, K = 13, 5
#: Bytes of the items' hashes and words that may be broadcast.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """Words of a text whose letters A-Z are lower-cased; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SPLIT), "")


def gram_hashes(hashes: str, k: int) -> Column:
    """Hash of each k consecutive elements of the column of word hashes."""
    h = F.col(hashes)
    if k == 1:
        return h
    return F.when(F.size(h) < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k)))))


def least_of(values: str, w: int) -> Column:
    """The least of each w consecutive elements of the column of hashes."""
    v = F.col(values)
    if w == 1:
        return v
    return F.when(F.size(v) < w, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(v) - w), lambda i: F.least(*(F.get(v, i + j) for j in range(w)))))


def with_windows(df: DataFrame, t: int, k: int) -> DataFrame:
    """Adds g (hashes of k words) and least (least hash of each window of t words), from h (hashes of words)."""
    df, w, width = df.withColumn("g", gram_hashes("h", k)), t - k + 1, 1
    df = df.withColumn("least", F.col("g"))
    while width * 3 <= w:  # windows of three times the width come from three of the width
        step = width
        df = df.withColumn("least", F.when(F.size("least") <= 2 * step, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("least") - 2 * step - 1), lambda i: F.least(F.get("least", i), F.get("least", i + step), F.get("least", i + 2 * step)))))  # noqa: B023
        width *= 3
    if width < w:
        more = w - width
        df = df.withColumn("least", F.when(F.size("least") <= more, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("least") - more - 1), lambda i: F.least(*(F.get("least", i + j) for j in sorted({*range(0, more, width), more}))))))
    return df


def positions(values: str) -> Column:
    """0 to the last index of an array; empty for an empty one."""
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(values) - 1))


def kgram(t: int) -> int:
    return min(K, t)


def context(words: str, i: Column, k: int, t: int) -> Column:
    """Up to t - k words before position i, nearest first; the k words; up to t - k words after them."""
    w, around = F.col(words), t - k
    before = F.slice(w, F.greatest(i - around, F.lit(0)) + 1, F.least(i, F.lit(around)))
    return F.struct(F.reverse(before).alias("before"), F.slice(w, i + 1, F.lit(k)).alias("gram"), F.slice(w, i + k + 1, F.lit(around)).alias("after"))


def item_fingerprints(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[int], int]:
    """Written (t, k, hash, item, own) of every kept hash of the items, own being its words; the t that occur (13 at most); the bytes."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("t", F.least(F.size("words"), F.lit(SPAN))).withColumn("h", F.transform("words", lambda x: F.xxhash64(x)))
    parts = []
    for t in sorted(r["t"] for r in items.select("t").distinct().collect()):
        k = kgram(t)
        w = t - k + 1
        own = with_windows(items.where(F.col("t") == t), t, k)
        kept = F.filter(positions("g"), lambda j: F.array_contains(F.slice("least", F.greatest(j - w + 1, F.lit(0)) + 1, F.lit(w)), F.get("g", j)))  # noqa: B023
        rows = own.select("t", "item", "words", "g", F.explode_outer(kept).alias("j")).where("j is not null")
        parts.append(rows.select("t", F.lit(k).alias("k"), F.get("g", F.col("j")).alias("hash"), "item", context("words", F.col("j"), k, t).alias("own")))
    if not parts:
        return items.select("t", F.lit(0).cast("bigint").alias("hash"), "item").where("false"), [], 0
    written = materialize(reduce(DataFrame.unionByName, parts), "fingerprints")
    words = F.concat(F.col("own.before"), F.col("own.gram"), F.col("own.after"))
    size = F.octet_length(F.array_join(words, " ")) + F.octet_length("item") + 64 + 16 * F.size(words)
    return written, sorted(r["t"] for r in written.select("t").distinct().collect()), written.agg(F.sum(size)).first()[0] or 0


def equal_run(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first.cast("int") - 1)


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and a hash of the text: rows with the same of both are the same document."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["text_hash"] == b["text_hash"])


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame | None:
    """(id, text_hash, spans array<struct<a, b>>, items array<string>) of the documents with hits; None without items."""
    prints, spans, size = item_fingerprints(benchmark, item_col, item_text)
    if not spans:
        return None
    hint = F.broadcast if size <= BROADCAST_BYTES else (lambda x: x)
    keyed = with_key(docs, id_col, text_col)
    hashed = keyed.select("id", "text_hash", words_of(F.col("text")).alias("words")).withColumn("h", F.transform("words", lambda x: F.xxhash64(x))).drop("words")
    for t in spans:
        hashed = with_windows(hashed, t, kgram(t)).withColumnRenamed("least", f"least_{t}").drop("g")
    kept = hashed.select("id", "text_hash", F.explode_outer(F.array_distinct(F.concat(*(F.col(f"least_{t}") for t in spans)))).alias("hash"))
    found = kept.join(hint(prints.select("hash").distinct()), "hash", "left_semi").select("id", "text_hash").distinct()
    found = materialize(found, "candidates").select(F.col("id").alias("c_id"), F.col("text_hash").alias("c_hash"))
    back = keyed.join(found, keyed["id"].eqNullSafe(found["c_id"]) & (keyed["text_hash"] == found["c_hash"]), "left_semi").dropDuplicates(["id", "text_hash"])
    back = back.withColumn("words", words_of(F.col("text"))).drop("text").withColumn("h", F.transform("words", lambda x: F.xxhash64(x)))
    grams = sorted({kgram(t) for t in spans})
    longest = max(spans)
    for k in grams:
        back = back.withColumn(f"g_{k}", gram_hashes("h", k))
    at = F.concat(*(F.transform(positions(f"g_{k}"), lambda i: F.struct(F.get(f"g_{k}", i).alias("hash"), F.lit(k).alias("k"), i.alias("i"), context("words", i, k, longest).alias("doc"))) for k in grams))  # noqa: B023
    own = back.select("id", "text_hash", F.inline_outer(at))
    pairs = own.join(hint(prints.select("hash", "k", "t", "item", "own")), ["hash", "k"]).where(F.col("doc.gram") == F.col("own.gram"))
    left, right = equal_run(F.col("doc.before"), F.col("own.before")), equal_run(F.col("doc.after"), F.col("own.after"))
    pairs = pairs.select("id", "text_hash", "item", "i", "k", "t", left.alias("left"), right.alias("right")).where(F.col("left") + F.col("right") + F.col("k") >= F.col("t"))
    hits = pairs.select("id", "text_hash", "item", (F.col("i") - F.col("left")).alias("a"), (F.col("i") + F.col("k") + F.col("right")).alias("b"))
    return hits.groupBy("id", "text_hash").agg(F.collect_set(F.struct("a", "b")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, text_hash, n_words, n_hit, spans (of words, end exclusive), items, contaminated."""
    hits = find_hits(docs, benchmark, id_col, text_col)
    keyed = with_key(docs, id_col, text_col)
    counted = keyed.select("id", "text_hash", F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    if hits is None:
        joined = counted.withColumn("spans", F.expr("cast(null as array<struct<a: int, b: int>>)")).withColumn("items", F.expr("cast(null as array<string>)"))
    else:
        hits = hits.select(F.col("id").alias("h_id"), F.col("text_hash").alias("h_hash"), "spans", "items")
        joined = counted.join(hits, counted["id"].eqNullSafe(hits["h_id"]) & (counted["text_hash"] == hits["h_hash"]), "left").drop("h_id", "h_hash")
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"] - 1))))).cast("bigint")
    joined = joined.withColumn("n_hit", F.when(F.col("spans").isNull(), F.lit(0).cast("bigint")).otherwise(covered)).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return joined.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones, with their own columns."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_hash"]), "left_anti").select(*own_columns(docs))


def op4_winnow_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bt AS (SELECT item_id, w, least(len(w), 13) AS t FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, t, array_to_string(w[i:i + t - 1], ' ') AS g FROM (SELECT item_id, w, t, unnest(range(1, len(w) - t + 2)) AS i FROM bt)),
ts AS (SELECT DISTINCT t FROM bt),
dw AS (SELECT doc_id, i, t, array_to_string(w[i:i + t - 1], ' ') AS g FROM (SELECT doc_id, w, t, unnest(range(1, len(w) - t + 2)) AS i FROM d, ts WHERE len(w) >= t)),
m AS (SELECT doc_id, i, dw.t AS t, item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + t)) AS p FROM (SELECT DISTINCT doc_id, i, t FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
