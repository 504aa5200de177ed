"""Assembly of records and texts: defaults, display, template repair, summaries, set comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.functions.semantics import filled


def get_or_create(requests: DataFrame, states: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Requests with their key's state, or the defaults and created = true."""
    marked = states.select(key, *defaults).withColumn("_found", F.lit(True))
    joined = requests.join(marked, key, "left")
    fields = {c: F.when(F.col("_found"), F.col(c)).otherwise(F.lit(v)) for c, v in defaults.items()}
    return joined.withColumns(fields).withColumn("created", F.col("_found").isNull()).drop("_found")


def display(fields: dict[str, Column]) -> Column:
    """map of the filled fields."""
    names = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields.values()))
    return F.map_filter(names, lambda k, v: filled(v))


def keep_unless_new(new: Column, old: Column) -> Column:
    """The new array if it has elements."""
    return F.when(F.coalesce(F.size(new), F.lit(0)) > 0, new).otherwise(old)


def with_missing_lines(template: DataFrame, content: DataFrame, on: list[str]) -> DataFrame:
    """Template lines (section_ord, ord) with the content's values; missing ones are added after their section's head."""
    own = content.select(*on, F.col("value").alias("_own"))
    joined = template.join(own, on, "left")
    return joined.withColumn("added", F.col("_own").isNull()).withColumn("value", F.coalesce("_own", "value")).drop("_own")


def line_order() -> list[Column]:
    return [F.col("section_ord"), F.desc("added"), F.col("ord")]


def template_rows(lines: DataFrame, file: str, order: list[str], label: str = "label", section: str = "section") -> DataFrame:
    """(file, value): the lines (section, label, value) of each file in order as a template's text, a section's first one with the head before it; lines without a section come before all heads."""
    before = F.lag(section).over(Window.partitionBy(file).orderBy(*order, section, label, "value"))
    head = F.when(F.col(section).isNotNull() & ~before.eqNullSafe(F.col(section)), F.concat(F.lit("["), section, F.lit("]\n"))).otherwise("")
    return lines.select(file, F.concat(head, label, F.lit(' = "'), F.coalesce("value", F.lit("")), F.lit('"')).alias("value"))


def comments_inserted(content: DataFrame, comments: DataFrame, label: str, order: str, suffix: str = "_comments") -> DataFrame:
    """Content lines with each comment line right after its label's line; comments of unknown labels are dropped."""
    base = comments.withColumn("_base", F.regexp_replace(label, f"{suffix}$", "")).select("_base", F.col(label).alias("_label"), F.col("value").alias("_value"))
    notes = content.select(F.col(label).alias("_base"), F.col(order)).join(base, "_base").select(F.col("_label").alias(label), F.col("_value").alias("value"), F.col(order), F.lit(1).alias("part"))
    return content.select(label, "value", order, F.lit(0).alias("part")).unionByName(notes)


def outcome_summary(df: DataFrame, outcome: str) -> DataFrame:
    """Counts of success, failed and skipped rows."""
    return df.agg(*(F.count_if(F.col(outcome) == k).alias(k) for k in ("success", "failed", "skipped")))


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether a and b have the same distinct rows; counts of rows that only one has."""
    both = a.distinct().withColumn("_side", F.lit(1)).unionByName(b.distinct().withColumn("_side", F.lit(2)))
    sides = both.groupBy(*a.columns).agg(F.sum("_side").alias("s"))
    return sides.agg(F.count_if(F.col("s") == 1).alias("only_first"), F.count_if(F.col("s") == 2).alias("only_second")).withColumn("equal", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def implicit_recall(expected: Column, found: Column) -> Column:
    """Share of expected keys that are filled in a map; 1 without expected keys."""
    hit = F.size(F.filter(expected, lambda k: filled(F.element_at(found, k))))
    return F.when(F.size(expected) > 0, hit / F.size(expected)).otherwise(1.0)


def unwrapped(text: Column) -> Column:
    """Text without the fence lines of a model's answer."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s*```[A-Za-z]*\n", ""), r"\n?```\s*$", "")
