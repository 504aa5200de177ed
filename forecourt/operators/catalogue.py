"""Catalogue documents: text and metadata from label entries, template checks and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forecourt.functions.semantics import let, truthy
from forecourt.functions.vocabulary import COMBUSTION_LABELS, COMBUSTION_TYPES, ELECTRIC_LABELS, ELECTRIC_TYPE, FILTER_FIELDS, NONE_TEXT

SECTIONS = ["PriciseLabels", "AmbiguousLabels"]
COMMENTS = "_comments"


def document_text(car_model: Column, key_details: Column, key_comments: Column, entries: Column) -> Column:
    """Description from array<struct<section, ord, key, value>>: details, then each filled comment in order."""
    notes = F.filter(entries, lambda e: e["key"].endswith(COMMENTS) & truthy(e["value"]))
    rank = lambda e: F.when(e["section"] == SECTIONS[0], 0).otherwise(1)
    ordered = F.array_sort(F.transform(notes, lambda e: F.struct(rank(e).alias("s"), e["ord"].alias("o"), e["key"].alias("k"), e["value"].alias("v"))))
    lines = F.transform(ordered, lambda e: F.concat(F.initcap(F.replace(F.replace(e["k"], F.lit(COMMENTS), F.lit("")), F.lit("_"), F.lit(" "))), F.lit(": "), e["v"]))
    head = F.array(F.concat(F.lit("Vehicle: "), F.coalesce(car_model, F.lit("Unknown Vehicle"))), F.when(truthy(key_details), F.concat(F.lit("Overview: "), key_details)), F.when(truthy(key_comments), F.concat(F.lit("Details: "), key_comments)))
    return F.array_join(F.concat(F.array_compact(head), lines), "\n")


def metadata(car_model: Column, entries: Column) -> Column:
    """map of the model and the filled filter fields; the ambiguous section overrides the precise one."""
    of = lambda section: F.filter(entries, lambda e: (e["section"] == section) & e["key"].isin(FILTER_FIELDS) & truthy(e["value"]))
    pair = lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))
    precise, vague = of(SECTIONS[0]), of(SECTIONS[1])
    kept = F.filter(precise, lambda e: ~F.exists(vague, lambda x: x["key"] == e["key"]))
    own = F.when(truthy(car_model), F.array(F.struct(F.lit("car_model").alias("key"), car_model.alias("value")))).otherwise(F.array().cast("array<struct<key: string, value: string>>"))
    return F.map_from_entries(F.concat(own, F.transform(kept, pair), F.transform(vague, pair)))


def visible(m: Column) -> Column:
    """Metadata without the source path."""
    return F.map_filter(m, lambda k, v: k != "source_file")


def inapplicable_to_none(label: Column, value: Column, powertrain: Column) -> Column:
    """"None" for labels that don't apply to the powertrain; comments and unknown powertrains stay."""
    off = (powertrain.isin(COMBUSTION_TYPES) & label.isin(ELECTRIC_LABELS)) | ((powertrain == ELECTRIC_TYPE) & label.isin(COMBUSTION_LABELS))
    return F.when(F.coalesce(off, F.lit(False)), F.lit(NONE_TEXT)).otherwise(value)


def missing_labels(template: DataFrame, content: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the template that the content hasn't."""
    return template.join(content.select(*on), on, "left_anti")


def labels_without_comments(labels: DataFrame, on: list[str], label: str = "label") -> DataFrame:
    """Labels that have no companion label of their name with the comment ending."""
    notes = labels.where(F.col(label).endswith(COMMENTS)).withColumn(label, F.regexp_replace(label, f"{COMMENTS}$", ""))
    plain = labels.where(~F.col(label).endswith(COMMENTS) & ~F.col(label).isin("title", "car_model"))
    return plain.join(notes.select(*on, label), [*on, label], "left_anti")


def first_occurrences(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first order) of each key, by partial aggregation."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def price_range(text: Column) -> Column:
    """struct<lo, hi> of "Below x", "a~b" or "Above x"; null for other texts."""
    number = lambda pattern, i: F.regexp_replace(F.regexp_extract(text, pattern, i), ",", "").try_cast("double")
    between = r"^([0-9,]+)~([0-9,]+)$"
    return (
        F.when(text.rlike(between), F.struct(number(between, 1).alias("lo"), number(between, 2).alias("hi")))
        .when(text.startswith("Below "), F.struct(F.lit(0.0).alias("lo"), number(r"^Below ([0-9,]+)", 1).alias("hi")))
        .when(text.startswith("Above "), F.struct(number(r"^Above ([0-9,]+)", 1).alias("lo"), F.lit(float("inf")).alias("hi")))
    )


def overlaps(a: Column, lo: Column, hi: Column) -> Column:
    """Whether a range meets [lo, hi]; unknown ranges don't."""
    return F.coalesce((a["lo"] <= hi) & (a["hi"] >= lo), F.lit(False))


HEAD, LINE = r"^\[([^\]]+)\]$", r'^([A-Za-z0-9_]+)\s*=\s*"?(.*?)"?$'


def template_line(line: Column) -> Column:
    """struct<head, label, value> of a template's line: head in a section's first line, else null; label is empty without one."""
    found = F.regexp_extract(line, HEAD, 1)
    return F.struct(F.when(found != "", found).alias("head"), F.regexp_extract(line, LINE, 1).alias("label"), F.regexp_extract(line, LINE, 2).alias("value"))


def template_lines(text: Column) -> Column:
    """array<struct<section, label, value>> of a template's lines; comment lines are skipped. Work grows with the lines."""
    row = lambda section: lambda x: F.struct(section.alias("section"), x["label"].alias("label"), x["value"].alias("value"))
    own = lambda lines, section, first, end: F.transform(F.filter(F.slice(lines, first + 1, end - first), lambda x: x["label"] != ""), row(section))

    def sections(lines: Column, heads: Column) -> Column:
        """The lines before the first head, and those from each head to the next."""
        end = lambda i: F.coalesce(F.get(heads, i), F.size(lines))
        return F.flatten(F.concat(F.array(own(lines, F.lit(""), F.lit(0), end(F.lit(0)))), F.transform(heads, lambda h, i: own(lines, F.get(lines, h)["head"], h, end(i + 1)))))

    at = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(x["head"].isNotNull(), i)), lambda i: i.isNotNull())
    return let(F.transform(F.split(text, "\n"), lambda x: template_line(F.trim(x))), lambda lines: let(at(lines), lambda heads: sections(lines, heads)))


def read_template_lines(spark: SparkSession, folder: str, file: str) -> DataFrame:
    """(file, section, label, value): the lines of the templates below folder (file=name/...) as template_lines finds them.

    A file is read in blocks, which carry their last section on to the next, so that no file is held whole.
    """
    text = spark.read.schema(f"value string, {file} string").option("lineSep", "\n").text(folder)
    places = F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")  # rows of a block are in its order
    lines = text.select(file, *places, template_line(F.trim("value")).alias("_line")).select(file, "_path", "_block", "_at", "_line.*")
    last = lines.groupBy("_path", "_block").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("_at"))).alias("_last"))
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_path", "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    own = F.last("head", ignorenulls=True).over(Window.partitionBy("_path", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("_own", own).where("label <> ''").join(carried, ["_path", "_block"])
    return rows.select(file, F.coalesce("_own", "_before", F.lit("")).alias("section"), "label", "value")
