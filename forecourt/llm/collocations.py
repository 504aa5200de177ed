"""Phrase collocations by hashed buckets (PCY, DHP): passes of growing length, pruned by bucket bitmaps and frequent parts.

A phrase is up to `longest` consecutive words of a piece of text, counted by language. Pass k over the texts

* counts exactly the phrases of k words whose bucket can hold `least` of them and whose parts of k - 1 words are both frequent,
* and counts into buckets the phrases of k + 1 words whose two parts passed that sieve, for the next pass.

What one pass tells the next are two bitmaps of BUCKETS bits, one of the buckets that reach `least` and one of the frequent
phrases, so that what is broadcast has a fixed size. Bitmaps let too much through, never too little: the more phrases there
are, the more of them are counted in vain, and every count that is used is exact, by phrases, not by hashes. Within a chunk of
CHUNK bytes of texts phrases are told apart by 64 bits of hash.

Bucket counts leave a task as slabs, which are added up in two steps by slab, so that neither a task nor the driver holds more than
a few slabs or the bitmap. A count is cut off at `least`, which is all that matters.

A candidate's score is the least over its cuts of 1000 a n / (l r), rounded down, in decimals of 38 digits. A candidate
inside a longer one that is as frequent is dropped; it is enough to look at those of one word more, as counts between the two can't
differ. The best of a language are picked from the best of SALTS shares of its phrases.

Defined cases: null and empty texts have no words, a null language is `und`; rows that repeat count as often as they
occur; an empty table gives no rows; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forecourt.llm.common import discard, map_batches, materialize, table
from forecourt.llm.near_dup import Powers, mix
from forecourt.llm.words import Words, grams

BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
LONGEST, LEAST, TOP = 5, 100, 2000
BUCKETS = 1 << 23
#: Buckets in a slab.
SLAB = 1 << 16
#: Bytes of texts whose phrases are counted at once.
CHUNK = 1 << 23
#: Steps of adding up slabs, and shares of a language's phrases.
SHARES, SALTS = 16, 256
UNKNOWN = "und"

COUNTED = "lang string, phrase string, n bigint, slab int, counts binary"


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def language_hash(lang: str) -> np.uint64:
    return mix(np.array([zlib.crc32(lang.encode()) | len(lang) << 32], np.uint64))[0]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Languages and texts of several batches together."""
    parts, size = [], 0
    for batch in batches:
        parts.append(batch)
        size += batch.column(1).nbytes
        if size >= CHUNK:
            yield tuple(pa.concat_arrays([b.column(i) for b in parts]) for i in (0, 1))
            parts, size = [], 0
    if parts:
        yield tuple(pa.concat_arrays([b.column(i) for b in parts]) for i in (0, 1))


class Phrases:
    """The words of a chunk, hashed with their language, and which places begin a phrase of so many words."""

    def __init__(self, langs: pa.Array, texts: pa.Array, powers: Powers):
        self.words = Words(texts, SPACES, BREAKS, lower=True)
        coded = langs.dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy(zero_copy_only=False)[self.words.of].astype(np.int64)
        salt = np.array([language_hash(x) for x in self.names], np.uint64)
        self.hashes = mix(self.words.hashes(powers) ^ salt[self.lang]) if len(salt) else np.zeros(0, np.uint64)

    def begin(self, k: int) -> np.ndarray:
        """Whether a phrase of k words begins, for each of the places of grams(k)."""
        n = max(0, len(self.hashes) - k + 1)
        return self.words.piece[:n] == self.words.piece[k - 1 : k - 1 + n]

    def counted(self, k: int, hashes: np.ndarray, places: np.ndarray) -> tuple[list[str], list[str], np.ndarray]:
        """Language, phrase and count of the phrases of k words at these places."""
        _, first, n = np.unique(hashes[places], return_index=True, return_counts=True)
        at = places[first]
        data = self.words.data.tobytes()
        found = [b" ".join(data[a:b].split()).decode() for a, b in zip(self.words.starts[at].tolist(), self.words.ends[at + k - 1].tolist(), strict=True)]
        return [self.names[i] for i in self.lang[at].tolist()], found, n


def slabs(counts: np.ndarray, least: int) -> pa.RecordBatch:
    """The slabs that hold anything, with counts up to least."""
    found = [(i, x) for i in range(BUCKETS // SLAB) if (x := counts[i * SLAB : (i + 1) * SLAB]).any()]
    packed = [zlib.compress(np.minimum(x, least).astype("<u4" if least > 255 else "u1").tobytes(), 1) for _, x in found]
    none = pa.nulls(len(found), pa.string())
    columns = [none, none, pa.nulls(len(found), pa.int64()), pa.array([i for i, _ in found], pa.int32()), pa.array(packed, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("slab", pa.int32()), ("counts", pa.binary())]))


def count_pass(texts: DataFrame, k: int, last: bool, frequent: bytes | None, possible: bytes | None, least: int) -> DataFrame:
    """Partial counts of phrases of k words (with a null phrase: of all words), and slabs of the bucket counts of k + 1 words."""
    shared = texts.sparkSession.sparkContext.broadcast((frequent, possible))  # a bit for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        known, maybe = (None if x is None else np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in shared.value)
        total = None if last else np.zeros(BUCKETS, np.uint32)
        for langs, texts in chunks(batches):
            phrases = Phrases(langs, texts, powers)
            hashes, passed = grams(phrases.hashes, k), phrases.begin(k)
            rows: list[tuple[list, list, list]] = []
            if k == 1:
                n = np.bincount(phrases.lang, minlength=len(phrases.names))
                rows.append((phrases.names, [None] * len(n), n.tolist()))
            else:
                part = known[bucket(grams(phrases.hashes, k - 1))]
                passed = passed & part[:-1] & part[1:] & maybe[bucket(hashes)]
            names, found, n = phrases.counted(k, hashes, np.flatnonzero(passed))
            rows.append((names, found, n.tolist()))
            columns = [pa.array([x for r in rows for x in r[i]], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.int32()), pa.nulls(len(columns[0]), pa.binary())], names=["lang", "phrase", "n", "slab", "counts"])
            if total is not None and len(passed) > 1:
                more = grams(phrases.hashes, k + 1)[phrases.begin(k + 1) & passed[:-1] & passed[1:]]
                total = np.minimum(total + np.bincount(bucket(more), minlength=BUCKETS).astype(np.uint32), least)
        if total is not None:
            yield slabs(total, least)

    return map_batches(texts, run, COUNTED)


def bitmap(rows: DataFrame, least: int) -> bytes:
    """A bit for each bucket whose counts in all slabs (slab, counts) add up to least."""
    whole = slab_adder(least, False)
    bits = slab_adder(least, True)
    n = BUCKETS // SLAB
    part = rows.select("slab", "counts", F.pmod(F.xxhash64("counts"), F.lit(SHARES)).alias("share")).repartition(n, "slab", "share")
    part = map_batches(part.select("slab", "counts"), whole, "slab int, counts binary").repartition(n, "slab")
    found = map_batches(part, bits, "slab int, counts binary").collect()  # BUCKETS bits
    out = bytearray(BUCKETS // 8)
    for r in found:
        out[r["slab"] * SLAB // 8 : (r["slab"] + 1) * SLAB // 8] = r["counts"]
    return bytes(out)


def slab_adder(least: int, to_bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(packed), "<u4" if least > 255 else "u1").astype(np.uint32)
                total[slab] = np.minimum(total[slab] + x, least) if slab in total else x
        out = [np.packbits(x >= least).tobytes() if to_bits else zlib.compress(x.astype("<u4" if least > 255 else "u1").tobytes(), 1) for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(out, pa.binary())], names=["slab", "counts"])

    return run


def marked(frequent: DataFrame, k: int, least: int) -> DataFrame:
    """Slabs in which the buckets of the phrases (lang, phrase) of k words have the count least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, total = Powers(), np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            phrases = Phrases(batch.column(0), batch.column(1), powers)
            total[bucket(grams(phrases.hashes, k)[phrases.begin(k)])] = least
        yield slabs(total, least)

    return map_batches(frequent.select("lang", "phrase"), run, COUNTED).select("slab", "counts")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written (lang, phrase, size, f) of all phrases of up to longest words that occur least times, and (lang, n) of all words."""
    docs.sparkSession.conf.set("spark.sql.shuffleDependency.fileCleanup.enabled", "true")
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    known = possible = totals = None
    found: list[DataFrame] = []
    for k in range(1, longest + 1):
        counted = materialize(count_pass(texts, k, k == longest, known, possible, least), f"pass{k}")
        phrases = counted.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        found.append(materialize(phrases.select("lang", "phrase", F.lit(k).alias("size"), "f"), f"frequent{k}"))
        if k == 1:
            totals = materialize(counted.where("phrase is null and slab is null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        empty = found[-1].isEmpty()
        if k < longest and not empty:
            possible = bitmap(counted.where("slab is not null").select("slab", "counts"), least)
            known = bitmap(marked(found[-1], k, least), least)
        discard(counted)
        if empty:
            break
    whole = found[0]
    for x in found[1:]:
        whole = whole.unionByName(x)
    whole = materialize(whole, "frequent")
    discard(*found)
    return whole, totals


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of two words and more that no longer one as frequent holds."""
    long = frequent.where("size > 1")
    words = F.split("phrase", " ")
    inner = long.where("size > 2").select("lang", F.explode(F.array(*(F.array_join(F.slice(words, i, F.col("size") - 1), " ") for i in (1, 2)))).alias("phrase"), "f").distinct()
    kept = long.hint("merge").join(inner, ["lang", "phrase", "f"], "left_anti")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    part = lambda name, f: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.hint("merge").join(part("head", "l"), ["lang", "head"]).hint("merge").join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.select("lang", "phrase", "a", "n", "k", "l", "r", (whole("a") * 1000 * whole("n")).cast("decimal(38,0)").alias("up"), (whole("l") * whole("r")).cast("decimal(38,0)").alias("down"))
    cuts = cuts.withColumn("score", F.expr("up div down"))
    best = F.min(F.struct("score", "k", "l", "r"))
    return cuts.groupBy("lang", "phrase", "a", "n").agg(best.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def best_phrases(rows: DataFrame, top: int = TOP) -> DataFrame:
    """Adds rank (from 1) to the first `top` rows of each language by score, count and phrase."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    few = rows.withColumn("_share", share).withColumn("_own", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_own") <= top).drop("_share", "_own")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))  # SALTS * top rows of a language at most
    return ranked.where(F.col("rank") <= top)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    frequent, totals = frequent_phrases(docs, longest, least, lang_col, text_col)
    return best_phrases(scored(frequent, totals), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
WITH pieces AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
places AS (SELECT lang, k, w[i : i + k - 1] AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, {LONGEST + 1}) t(k) WHERE len(w) >= k)),
frequent AS (SELECT lang, k, p, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (SELECT c.lang, c.p, c.k AS size, c.f AS a, j, h.f AS l, t.f AS r, n, ((1000::HUGEINT * c.f * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM frequent WHERE k > 1) c JOIN totals USING (lang) JOIN frequent h ON h.lang = c.lang AND h.p = c.p[1 : j] JOIN frequent t ON t.lang = c.lang AND t.p = c.p[j + 1 :]),
best AS (SELECT lang, p, size, a, n, arg_min(l, (score, j)) AS l, arg_min(r, (score, j)) AS r, min(score) AS score FROM cuts GROUP BY ALL),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM frequent f, range(1, 5) o(i) WHERE f.lang = b.lang AND f.k > b.size AND 100 * f.f >= 100 * b.a AND f.p[i : i + b.size - 1] = b.p)),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM kept)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
