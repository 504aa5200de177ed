"""Document fingerprints: Merkle trees over sections, paragraphs and phrases, with DataFrame functions only.

A text is cut into sections (after an empty line), a section into paragraphs (after a line break) and a
paragraph into phrases (after white space that follows a sign or a letter of a fixed set, so that cuts depend on
nearby text only and an edit moves no cut elsewhere). Cuts drop no character. A paragraph's digest is the
SHA-256 of its text, a section's that of its paragraphs' digests, the root that of the sections' digests: roots
are equal if and only if texts are, and below equal digests nothing needs to be compared, so that differing branches
locate edits. Phrases have short hashes; the likeness of two fingerprints is the Dice coefficient of their sets of
phrase hashes.

The fingerprint string is root/sections/paragraphs/phrases, with the hexadecimal digests of each level
one after another.

Defined cases: null counts as empty; an empty text has one empty phrase; texts that repeat have equal
fingerprints; rows of one id, or without an id (these come last), follow each other by descending hash of the text;
ids may be numbers, strings or times; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import operator
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt.llm.common import table

SECTION, PARAGRAPH = r"(?<=\n\n)", r"(?<=\n)"
PHRASE = r"(?<=[^\p{L}\p{N}\s]\s|[sd]\s|\n|[。！？])"
#: Hexadecimal digits of the digests in a fingerprint; phrases have 24 bits.
ROOT_DIGITS, NODE_DIGITS, PHRASE_DIGITS = 32, 8, 6
#: About so many documents are in one range of ids, until there are about MAX_RANGES; so many quantiles are asked for.
RANGE_ROWS, MAX_RANGES, QUANTILES = 1000, 1 << 16, 256
#: About so many string ids are sampled for quantiles; others have an approximate percentile.
SAMPLE = 1 << 14


def phrase_hashes(text: Column) -> Column:
    """24-bit hashes of the phrases of a text, in order."""
    return F.transform(F.split(text, PHRASE, -1), lambda x: F.xxhash64(x).bitwiseAND((1 << 4 * PHRASE_DIGITS) - 1).cast("int"))


def paragraphs_of(text: Column) -> Column:
    """array<array<string>>: for each section the digests of its paragraphs."""
    return F.transform(F.split(text, SECTION, -1), lambda s: F.transform(F.split(s, PARAGRAPH, -1), lambda p: F.sha2(p, 256)))


def sections_of(paragraphs: Column) -> Column:
    """Digests of the sections, from those of their paragraphs."""
    return F.transform(paragraphs, lambda ps: F.sha2(F.array_join(ps, ""), 256))


def root_of(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, ""), 256)


def differing_branches(a: Column, b: Column) -> Column:
    """The (section, paragraph) places, from 0, at which two trees of paragraph digests differ; empty for equal ones.

    Sections of equal digests (that is, of equal paragraphs) aren't entered.
    """
    none = F.array().cast("array<struct<section: int, paragraph: int>>")
    places = lambda x: F.sequence(F.lit(0), x - 1)

    def of_section(i: Column) -> Column:
        x, y = F.get(a, i), F.get(b, i)
        longest = F.greatest(F.coalesce(F.size(x), F.lit(0)), F.coalesce(F.size(y), F.lit(0)))
        differ = F.filter(places(longest), lambda j: ~F.get(x, j).eqNullSafe(F.get(y, j)))
        return F.when(x.eqNullSafe(y), none).otherwise(F.transform(differ, lambda j: F.struct(i.alias("section"), j.alias("paragraph"))))

    return F.when(a == b, none).otherwise(F.flatten(F.transform(places(F.greatest(F.size(a), F.size(b))), of_section)))


def fingerprint(paragraphs: Column, sections: Column, phrases: Column) -> Column:
    cut = lambda xs: F.array_join(F.transform(xs, lambda d: F.left(d, F.lit(NODE_DIGITS))), "")
    own = F.array_join(F.transform(phrases, lambda x: F.lpad(F.lower(F.hex(x)), PHRASE_DIGITS, "0")), "")
    return F.concat_ws("/", F.left(root_of(sections), F.lit(ROOT_DIGITS)), cut(sections), cut(F.flatten(paragraphs)), own)


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of distinct phrase hashes."""
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)).cast("double")


def ordinal(kind: T.DataType, own: Column) -> Column:
    """A number that grows, if not always strictly, with the id, which isn't a string."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return own.cast("bigint")
    if isinstance(kind, T.NumericType):
        return own.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return own.cast("timestamp").cast("double")
    raise TypeError(f"ids of type {kind.simpleString()} have no order here")


def string_cuts(docs: DataFrame, n: int) -> list[str]:
    """About QUANTILES quantiles of string ids, from a sample of about SAMPLE of them, with the least and the greatest id."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return []
    sample = docs.where(F.col("doc_id").isNotNull() & (F.rand(0) < SAMPLE / n)).select("doc_id")
    found = sorted((r[0] for r in sample.collect()), key=str.encode)
    return [low, *(found[i * len(found) // QUANTILES] for i in range(1, QUANTILES) if found), high]


def string_shares(cuts: list[str], k: Column) -> tuple[Column, Column, Column]:
    """Numbers of the id and of the cuts around it: the six bytes after what both cuts, and so all ids between them, begin with."""
    encoded = [x.encode() for x in cuts]
    around = list(zip(encoded, encoded[1:], strict=False))
    shared = [len(os.path.commonprefix(x)) for x in around]
    number = lambda x, at: int.from_bytes(x[at : at + 6].ljust(6, b"\0"), "big")
    of = lambda xs, kind: F.get(F.array(*map(F.lit, xs)).cast(f"array<{kind}>"), k - 1)
    bytes_ = F.substring(F.col("doc_id").cast("binary"), of(shared, "int") + 1, F.lit(6))
    low, high = (of([number(x[i], at) for x, at in zip(around, shared, strict=True)], "bigint") for i in (0, 1))
    return F.conv(F.rpad(F.hex(bytes_), 12, "0"), 16, 10).cast("bigint"), low, high


def with_ranges(docs: DataFrame) -> DataFrame:
    """Adds range: a number that falls as rows follow each other by descending doc_id and then descending text_hash.

    Ids are dealt by quantiles and, between two quantiles, in proportion. An id that makes up several quantiles, and
    rows without an id, are dealt by the hash of the text. Any deal gives the same result.
    """
    kind = docs.schema["doc_id"].dataType
    text = isinstance(kind, T.StringType)
    docs = docs.withColumn("at", F.col("doc_id") if text else ordinal(kind, F.col("doc_id")))
    of_numbers = [] if text else [F.percentile_approx("at", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000)]
    n, missing, *cuts = docs.agg(F.count("*"), F.count_if(F.col("at").isNull()), *of_numbers).first()
    cuts = string_cuts(docs, n) if text else cuts[0] or []
    parts = min(max(1, -(-n // (RANGE_ROWS * QUANTILES))), MAX_RANGES // QUANTILES)
    often = {x for x, y in zip(cuts, cuts[1:], strict=False) if x == y}
    if often:  # of those that are one id each, how many rows there are; QUANTILES of them at most
        found = docs.where(F.col("at").isin(sorted(often))).groupBy("at").agg(F.min("doc_id").eqNullSafe(F.max("doc_id")).alias("one")).where("one").collect()
        often = {r["at"] for r in found}
    cuts = sorted(set(cuts), key=str.encode if text else None) or ["" if text else 0]
    splits = F.array(*(F.lit(x) for x in cuts))
    k = F.size(F.filter(splits, lambda s: s <= F.col("at")))
    if text:
        at, low, high = string_shares(cuts, F.col("k"))
    else:
        at, low, high = F.col("at"), F.get(splits, F.col("k") - 1), F.get(splits, F.col("k"))
    share = F.when(low < high, F.least(F.floor((at - low) / F.nullif(high - low, F.lit(0)) * parts), F.lit(parts - 1)))
    share = F.coalesce(share, F.lit(0))
    wide = 2 * max(parts, QUANTILES)
    by_hash = lambda many: F.least(F.floor((F.col("text_hash") / 2.0**64 + 0.5) * many), F.lit(many - 1))
    hot = functools.reduce(operator.or_, (F.col("at") == x for x in sorted(often)), F.lit(False))
    many = min(max(1, -(-missing // RANGE_ROWS)), MAX_RANGES)
    dealt = F.when(F.col("at").isNull(), by_hash(many) - many).when(hot, F.col("k") * wide + by_hash(wide // 2)).otherwise(F.col("k") * wide + wide // 2 + share)
    return docs.withColumn("k", k).withColumn("range", dealt.cast("bigint")).drop("k", "at")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, phrases and those of the next row by descending doc_id (next_text, next_phrases); after the last comes the first.

    Each range also gets a copy of the first row of the range after it, so that one shuffle of the texts by range is
    enough.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    dealt = with_ranges(docs).withColumn("own", F.struct("doc_id", "text_hash"))
    tops = dealt.groupBy("range").agg(F.max("own").alias("top"))
    by = Window.orderBy(F.desc("range"))  # a row for each range, of which there are some times MAX_RANGES at most
    ends = tops.select("range", "top", F.coalesce(F.lag("range").over(by), F.min("range").over(Window.partitionBy())).alias("before"))
    ends = ends.select(F.col("range").alias("of"), "top", "before")
    copies = dealt.join(F.broadcast(ends), (F.col("range") == F.col("of")) & F.col("own").eqNullSafe(F.col("top"))).dropDuplicates(["of"])
    copies = copies.select("doc_id", "text", F.col("before").alias("range"), "text_hash", F.lit(1).alias("copy"))
    both = dealt.select("doc_id", "text", "range", "text_hash", F.lit(0).alias("copy")).unionByName(copies)
    both = both.withColumn("phrases", phrase_hashes(F.col("text")))
    own = Window.partitionBy("range").orderBy("copy", F.desc_nulls_last("doc_id"), F.desc("text_hash"))
    lead = lambda c: F.lead(c).over(own).alias(f"next_{c}")
    return both.select("doc_id", "text", "phrases", "copy", lead("text"), lead("phrases")).where("copy = 0").drop("copy")


def op6_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents")).withColumn("n_chars", F.char_length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - third), F.left("next_text", third)))
    rows = rows.withColumn("edited_phrases", phrase_hashes(F.col("edited")))
    for name in ("text", "edited"):
        rows = rows.withColumn(f"{name}_paragraphs", paragraphs_of(F.col(name)))
        rows = rows.withColumn(f"{name}_sections", sections_of(F.col(f"{name}_paragraphs")))
    places = F.transform(differing_branches(F.col("text_paragraphs"), F.col("edited_paragraphs")), lambda x: F.concat_ws(".", x["section"].cast("string"), x["paragraph"].cast("string")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text_paragraphs"), F.col("text_sections"), F.col("phrases")).alias("fingerprint"),
        fingerprint(F.col("edited_paragraphs"), F.col("edited_sections"), F.col("edited_phrases")).alias("edited_fingerprint"),
        likeness(F.array_distinct("phrases"), F.array_distinct("edited_phrases")).alias("near_edited"),
        likeness(F.array_distinct("phrases"), F.array_distinct("next_phrases")).alias("near_next"),
        F.array_join(places, ",").alias("edited_branches"),
    )
