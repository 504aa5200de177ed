"""Evaluation: precision and recall, response scores, task completion, latencies, reports by category."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.functions.semantics import CJK, contains_any, count_of, filled, has_chinese, ratio, strip, truthy
from forecourt.functions.vocabulary import INVITING, POLITE, SLANG, STAGE_WORDS, STAGES
from forecourt.operators.funnel import stage_index


def precision_recall_f1(correct: Column, extracted: Column, expected: Column) -> list[Column]:
    """Three columns from counts; an empty denominator gives 1."""
    p, r = ratio(correct, extracted), ratio(correct, expected)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1")]


def field_scores(expected: Column, extracted: Column) -> Column:
    """struct<correct, extracted, expected>: how many fields, of two maps. Only expected keys with a value count.

    An extracted value counts if there is one, and is correct if it equals the expected one but for case and outer blanks.
    """
    known = F.filter(F.map_entries(expected), lambda e: truthy(e["value"]))
    found = F.filter(known, lambda e: truthy(F.try_element_at(extracted, e["key"])))
    right = F.filter(found, lambda e: F.lower(strip(F.try_element_at(extracted, e["key"]))) == F.lower(strip(e["value"])))
    size = lambda xs: F.greatest(F.coalesce(F.size(xs), F.lit(0)), F.lit(0)).cast("bigint")
    return F.struct(size(right).alias("correct"), size(found).alias("extracted"), size(known).alias("expected"))


def extraction_report(df: DataFrame, expected: str, extracted: str, group: Column) -> DataFrame:
    """Per group, summed field_scores and precision, recall and F1 from the sums."""
    counts = df.select(group.alias("group"), field_scores(F.col(expected), F.col(extracted)).alias("s")).groupBy("group")
    summed = counts.agg(*(F.sum(f"s.{c}").alias(c) for c in ("correct", "extracted", "expected")))
    return summed.select("*", *precision_recall_f1(F.col("correct"), F.col("extracted"), F.col("expected")))


def stage_accuracy(turns: DataFrame, dialogue: str, expected: str, actual: str) -> DataFrame:
    """macro (mean over dialogues) and micro (over turns) share of turns whose stage is the expected one."""
    right = F.coalesce((F.col(expected) == F.col(actual)).cast("int"), F.lit(0))
    own = turns.groupBy(dialogue).agg(F.count("*").alias("n"), F.sum(right).alias("k"))
    return own.agg(F.avg(F.col("k") / F.col("n")).alias("macro"), (F.sum("k") / F.sum("n")).alias("micro"))


#: Scores of a dialogue that a report averages; stage accuracy is a share, all others go to 100.
REPORTED = ("overall", "stage_accuracy", "relevance", "task_completion", "conversion", "professionalism", "language")


def report_totals(dialogues: DataFrame) -> DataFrame:
    """One row from dialogues (turns and the REPORTED scores): how many, their turns, and the seven means to a digit."""
    mean = lambda c: F.round(F.coalesce(F.avg(F.col(c) * (100 if c == "stage_accuracy" else 1)), F.lit(0.0)), 1)
    return dialogues.agg(F.count("*").alias("dialogues"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), *(mean(c).alias(f"avg_{c}") for c in REPORTED))


def report_text(summary: dict[str, object], targets: dict[str, float] | None = None, title: str = "Evaluation") -> str:
    """A Markdown table of one row's values, with targets where there are some."""
    lines = [f"# {title}", "", "| metric | value | target | met |", "|---|---|---|---|"]
    for name, value in summary.items():
        target = (targets or {}).get(name)
        lines.append(f"| {name} | {value} | {'' if target is None else target} | {'' if target is None or value is None else 'yes' if value >= target else 'no'} |")
    return "\n".join(lines) + "\n"


def relevance(response: Column, stage: Column, words: Column, product: str | None = None) -> Column:
    """0 to 100: stage words 40, share of the user's words 30, length 15, question 15 or invitation 10.

    product is the seller's own name, which counts among the welcoming words.
    """
    low, bare = F.lower(response), strip(response)
    greeting = STAGE_WORDS[STAGES[0]] + ([product.lower()] if product else [])
    known = reduce(lambda e, s: e.when(stage == s, contains_any(low, STAGE_WORDS[s])), STAGES[1:], F.when(stage == STAGES[0], contains_any(low, greeting)))
    n = F.size(words)
    matched = F.size(F.filter(words, lambda w: low.contains(F.lower(w))))
    total = F.when(F.coalesce(known, F.lit(False)), 40.0).otherwise(0.0) + F.when(n > 0, F.least(F.lit(30.0), matched / n * 30.0)).otherwise(0.0)
    total = total + F.when(F.length(bare) > 20, 15.0).otherwise(0.0) + F.when(bare.rlike("(\\?|？|吗|呢|吧)$"), 15.0).when(contains_any(low, INVITING), 10.0).otherwise(0.0)
    return F.least(total, F.lit(100.0))


def context_words(message: Column) -> Column:
    """White-space tokens of more than one character."""
    return F.filter(F.split(strip(message), r"\s+"), lambda w: F.length(w) > 1)


def professionalism(response: Column) -> Column:
    """0 to 100: no slang 40, a polite word 30, two sentences 30 or one 15."""
    low = F.lower(response)
    sentences = F.size(F.filter(F.split(response, "[。！？.!?\n]"), lambda s: F.length(strip(s)) > 5))
    return F.when(contains_any(low, SLANG), 0.0).otherwise(40.0) + F.when(contains_any(low, POLITE), 30.0).otherwise(0.0) + F.when(sentences >= 2, 30.0).when(sentences == 1, 15.0).otherwise(0.0)


def language_consistency(message: Column, response: Column) -> Column:
    return F.when(~filled(response), 0.0).when(has_chinese(message) == has_chinese(response), 100.0).otherwise(0.0)


def chinese_share(text: Column) -> Column:
    """Share of CJK ideographs among letters; null without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, f"[^{CJK[1:-1]}]", "")) / letters)


def voice_language(text: Column, default: str = "zh", other: str = "en", least: float = 0.3) -> Column:
    share = chinese_share(text)
    return F.when(share.isNull() | (share > least), default).otherwise(other)


def funnel_score(furthest: Column) -> Column:
    """Share of the seven stages, from the furthest stage's index; none counts as the first."""
    return (F.coalesce(furthest, F.lit(0)) + 1) / 7 * 100


def task_completion(expected: Column, visited: Column, furthest: Column, profile: list[Column], needs: list[Column], place: list[Column]) -> Column:
    """Stage 30 (in part by the furthest index, -1 for none), profile 25, needs 25, reservation 20."""
    target = stage_index(expected)
    stage = F.when(visited, 30.0).when(target > 0, 30.0 * (F.coalesce(furthest, F.lit(-1)) / target)).otherwise(0.0)
    share = lambda cs: count_of([truthy(c) for c in cs]) / len(cs)
    place_score = F.when(expected.isin(STAGES[4:]), 20.0 * share(place)).otherwise(20.0)
    return F.least(stage + 25.0 * share(profile) + 25.0 * share(needs) + place_score, F.lit(100.0))


def overall(task: Column, conversion: Column, response: Column, profile_f1: Column, needs_f1: Column, stage: Column, latency_ms: Column) -> Column:
    """Business 35, responses 30, extraction 20, stages 10, latency 5 percent. Missing F1 counts as 1."""
    quick = F.when(latency_ms < 50, 100 - latency_ms / 50.0 * 100).otherwise(0.0)
    found = (F.coalesce(profile_f1, F.lit(1.0)) * 100 + F.coalesce(needs_f1, F.lit(1.0)) * 100) / 2
    return 0.35 * (0.5 * task + 0.5 * conversion) + 0.30 * response + 0.20 * found + 0.10 * stage * 100 + 0.05 * quick


def order_statistics(df: DataFrame, group: str, value: str, shares: dict[str, float | Callable[[Column], Column]], parts: int = 64) -> DataFrame:
    """Per group, for each named share q, the value at index min(floor(n q), n - 1) of the sorted values.

    A function in place of a share gives the index from n.

    Approximate quantiles cut each group into ranges; counts of the ranges tell which one holds an index, and
    only rows of those ranges are ranked. So the result is exact, and no group is sorted or collected as a whole.
    Only a single value that fills a range by itself isn't split; it needs no rank.
    """
    rows = df.where(F.col(value).isNotNull()).select(group, F.col(value).alias("_v"))
    cuts = rows.groupBy(group).agg(F.percentile_approx("_v", [i / parts for i in range(1, parts)], 1000).alias("_cuts"), F.count("*").alias("_n"))
    ranged = rows.join(cuts, group).select(group, "_v", "_n", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_r"))
    counts = ranged.groupBy(group, "_r").agg(F.count("*").alias("_k"), F.first("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    before = F.sum("_k").over(Window.partitionBy(group).orderBy("_r")) - F.col("_k")
    counts = counts.withColumn("_before", before)
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.least(q(F.col("_n")) if callable(q) else F.floor(F.col("_n") * q), F.col("_n") - 1).alias("at")) for k, q in shares.items())))
    holds = counts.withColumn("w", wanted).where((F.col("w.at") >= F.col("_before")) & (F.col("w.at") < F.col("_before") + F.col("_k"))).select(group, "_r", "_before", "_lo", "_hi", "w.name", "w.at")
    alone = holds.where("_lo = _hi").select(group, "name", F.col("_lo").alias("value"))
    mixed = holds.where("_lo != _hi")
    own = Window.partitionBy(group, "_r").orderBy("_v")
    picked = ranged.join(mixed.select(group, "_r").distinct(), [group, "_r"], "left_semi").withColumn("_i", F.row_number().over(own) - 1)
    found = picked.join(mixed, [group, "_r"]).where(F.col("_i") == F.col("at") - F.col("_before")).select(group, "name", F.col("_v").alias("value"))
    return found.unionByName(alone).groupBy(group).pivot("name", list(shares)).agg(F.first("value"))


def latency_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group samples, avg, max, p95, p99 and the two middle values, as they are."""
    base = df.groupBy(group).agg(F.count(value).alias("samples"), F.avg(value).alias("avg"), F.max(value).alias("max"))
    ranks = order_statistics(df, group, value, {"p95": 0.95, "p99": 0.99, "upper_median": 0.5, "lower_median": lambda n: F.floor((n - 1) / 2)})
    return base.join(ranks, group, "left")


def latency_report(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, avg, p50 (mean of the middle two), p95, p99 and max, to two digits."""
    two = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 2)
    values = {"avg_ms": F.col("avg"), "p50_ms": (F.col("lower_median") + F.col("upper_median")) / 2} | {f"{c}_ms": F.col(c) for c in ("p95", "p99", "upper_median", "max")}
    return latency_statistics(df, group, value).select(group, "samples", *(two(c).alias(n) for n, c in values.items()))


# Targets of the KPI report. Scores must reach theirs, latencies (in ms) stay below.
F1_TARGETS = {"profile": 0.90, "needs": 0.85, "reservation": 0.90}
STAGE_TARGET = 1.0
LATENCY_TARGETS = {"avg": 10.0, "p95": 50.0}


def _kpis(df: DataFrame, section: str, name: Column, values: dict[str, Column], target: Column, below: bool = False) -> DataFrame:
    """A row (section, name, metric, value, target, met) for each of the named values; target may look at the column metric."""
    entries = F.array(*(F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in values.items()))
    rows = df.select(F.lit(section).alias("section"), name.alias("name"), F.explode(entries).alias("_e")).select("section", "name", "_e.metric", "_e.value")
    rows = rows.withColumn("target", target.cast("double"))
    return rows.withColumn("met", F.col("value") < F.col("target") if below else F.col("value") >= F.col("target"))


def kpi_report(extracted: DataFrame, turns: DataFrame, latencies: DataFrame, f1_targets: dict[str, float] = F1_TARGETS) -> DataFrame:
    """Rows (section, name, metric, value, target, met) of the report's three measured sections.

    extracted holds extractor and the maps expected and extracted, turns the stages expected and actual, latencies ms.
    Precision, recall and F1 come from the summed counts of each extractor; stage accuracy with how many turns are
    right and how many there are; latencies with the values at an index of the sorted ones, as `order_statistics` gives them.
    A value without a target has no verdict. No turns give a value of null, no answers or latencies no rows.
    """
    targets = lambda by, own: F.try_element_at(F.create_map(*(F.lit(x) for e in own.items() for x in e)), by) if own else F.lit(None)
    scores = extraction_report(extracted, "expected", "extracted", F.col("extractor"))
    of_f1 = F.when(F.col("metric") == "f1", targets(F.col("name"), f1_targets))
    extraction = _kpis(scores, "extraction", F.col("group"), {c: F.col(c) for c in ("precision", "recall", "f1")}, of_f1)
    counted = turns.agg(F.count("*").alias("turns"), F.count_if(F.col("expected") == F.col("actual")).alias("right"))
    accuracy = {"accuracy": F.col("right") / F.nullif(F.col("turns"), F.lit(0)), "right": F.col("right"), "turns": F.col("turns")}
    stages = _kpis(counted, "stages", F.lit("all"), accuracy, F.when(F.col("metric") == "accuracy", STAGE_TARGET))
    found = latency_statistics(latencies.select(F.lit("all").alias("all"), "ms"), "all", "ms")
    times = {"avg": F.col("avg"), "p50": F.col("upper_median"), "p95": F.col("p95"), "max": F.col("max"), "samples": F.col("samples")}
    return extraction.unionByName(stages).unionByName(_kpis(found, "latency", F.col("all"), times, targets(F.col("metric"), LATENCY_TARGETS), below=True))


SECTIONS = {"extraction": "Extraction accuracy", "stages": "Stage transitions", "latency": "Latency"}


def kpi_text(rows: DataFrame, stamp: str, title: str = "KPI report") -> str:
    """The rows of `kpi_report` (three for each extractor and eight more) as Markdown, a table for each section."""
    found = sorted(rows.collect(), key=lambda r: (list(SECTIONS).index(r["section"]), r["name"]))
    number = lambda x: "" if x is None else f"{x:.2f}".rstrip("0").rstrip(".")
    lines = [f"# {title}", "", f"Generated: {stamp}"]
    for place, (section, heading) in enumerate(SECTIONS.items(), 1):
        lines += ["", f"## {place}. {heading}", "", "| name | metric | value | target | met |", "|---|---|---|---|---|"]
        sign = "< " if section == "latency" else ">= "
        for r in (r for r in found if r["section"] == section):
            met = "" if r["met"] is None else "yes" if r["met"] else "no"
            lines.append(f"| {r['name']} | {r['metric']} | {number(r['value'])} | {'' if r['target'] is None else sign + number(r['target'])} | {met} |")
    return "\n".join(lines) + "\n"


def health(agent: Column, index: Column) -> Column:
    return F.when(~agent, "unhealthy").when(~index, "degraded").otherwise("ok")


def complete(fields: list[Column]) -> Column:
    """Share of filled fields."""
    return count_of([filled(c) for c in fields]) / len(fields)

