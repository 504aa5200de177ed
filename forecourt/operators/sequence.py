"""Operators over ordered turns: changes, skipped work, gathered facts, histories, turn buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from forecourt.functions.semantics import col
from forecourt.operators.records import new_name


def turns_of(session: str, *order) -> WindowSpec:
    return Window.partitionBy(session).orderBy(*order)


def with_change(df: DataFrame, by: WindowSpec, value: str) -> DataFrame:
    """Adds previous (the value before this turn) and changed."""
    return df.withColumn("previous", F.lag(value).over(by)).withColumn("changed", F.coalesce(F.col(value) != F.col("previous"), F.lit(False)))


def skippable(by: WindowSpec, needs: str, matches: str) -> Column:
    """Whether retrieval can be skipped: needs as before, and the turn before had matches."""
    first = F.row_number().over(by) == 1
    return ~first & col(needs).eqNullSafe(F.lag(needs).over(by)) & F.coalesce(F.lag(matches).over(by) > 0, F.lit(False))


def gathering_rate(by: WindowSpec, n_filled: str) -> Column:
    """0 to 100 by new facts, three or more being 100; lost facts make it negative."""
    return F.least(F.lit(100.0), (col(n_filled) - F.coalesce(F.lag(n_filled).over(by), F.lit(0))) / 3.0 * 100.0)


def history(df: DataFrame, session: str, turn: str, role: str, text: str) -> DataFrame:
    """One text per session: User and Assistant lines in order. The result row holds the session's text anyway."""
    who = F.when(F.col(role) == "user", "User").when(F.col(role) == "assistant", "Assistant")
    lines = df.where(who.isNotNull()).select(session, F.struct(F.col(turn).alias("t"), F.concat(who, F.lit(": "), F.coalesce(text, F.lit(""))).alias("line")).alias("x"))
    return lines.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("history"))


def closed_turns(df: DataFrame, session: str, order: list, is_end: Column, size: Column) -> DataFrame:
    """Frames between end marks as turns: (session, turn_id, n_frames, total_size); empty and open buffers give none."""
    by = Window.partitionBy(session).orderBy(*order)
    ends = F.sum(is_end.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = df.withColumn("_end", is_end).withColumn("_size", size).withColumn("turn_id", F.when(is_end, ends - 1).otherwise(ends).cast("bigint"))
    found = own.groupBy(session, "turn_id").agg(F.count(F.when(~F.col("_end"), 1)).alias("n_frames"), F.sum(F.when(~F.col("_end"), F.col("_size"))).alias("total_size"), F.max("_end").alias("closed"))
    return found.where("closed and n_frames > 0").drop("closed")


def latest_within(df: DataFrame, session: str, order: list[str], tokens: str, limit: int | None) -> DataFrame:
    """The latest messages of each session whose tokens add up to limit at most; all without one.

    Where even the last message is longer, none is kept. A message counts as its number in the column tokens (null: 0).
    """
    if limit is None:
        return df
    later = Window.partitionBy(session).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = new_name(df, "_total")
    return df.withColumn(total, F.sum(F.coalesce(F.col(tokens), F.lit(0))).over(later)).where(F.col(total) <= limit).drop(total)


def session_metrics(df: DataFrame, session: str, order: str, latency: str, language: str) -> DataFrame:
    """Turns, total and mean latency, and languages in the order of their first turn."""
    firsts = df.where((F.col(language) != "") & F.col(language).isNotNull()).groupBy(session, language).agg(F.min(order).alias("_at"))
    languages = firsts.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", language))), lambda x: x[language]), ",").alias("languages"))
    totals = df.groupBy(session).agg(F.count("*").alias("total_turns"), F.round(F.sum(latency), 2).alias("total_ms"), F.round(F.avg(latency), 2).alias("avg_ms"))
    return totals.join(languages, session, "left").withColumn("languages", F.coalesce("languages", F.lit("")))
