"""The default embedding of texts: hashed words, without a model. Any function of a column can take its place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forecourt.functions.semantics import let


def embedded(text: Column, size: int = 64) -> Column:
    """array<double>: how many of the text's lower-cased words fall to each of `size` buckets, by their MD5."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")
    bucket = lambda w: (F.conv(F.left(F.md5(w), F.lit(6)), 16, 10).cast("int") % size).cast("int")
    counted = lambda own: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.size(own) - F.size(F.array_remove(own, i))).cast("double"))
    return let(F.transform(words, bucket), counted)
