"""Presence, stripping and text predicates that all operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
CJK = r"[\x{4e00}-\x{9fff}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(col(c), BLANK, "")


def truthy(c: Column | str) -> Column:
    """Neither null nor empty; a lone space counts."""
    return F.coalesce(col(c) != "", F.lit(False))


def filled(c: Column | str) -> Column:
    """Something is left after stripping."""
    return F.coalesce(strip(c) != "", F.lit(False))


def or_keep(new: Column | str, old: Column | str) -> Column:
    """The stripped new value if it is filled, else the old one."""
    return F.coalesce(F.nullif(strip(new), F.lit("")), col(old))


def let(value: Column, f) -> Column:
    """f of a value that is evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def count_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.cast("int") for c in conditions])


def contains_any(text: Column, words: list[str]) -> Column:
    return any_of([text.contains(w) for w in words])


def has_chinese(c: Column | str) -> Column:
    return col(c).rlike(CJK)


def ratio(part: Column, whole: Column, empty: float = 1.0) -> Column:
    """part / whole, or `empty` where whole is 0."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)
