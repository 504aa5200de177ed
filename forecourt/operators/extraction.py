"""Semi-structured payloads: fenced JSON, non-empty-wins merges, missing fields and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.semantics import col, filled, let, or_keep, strip, truthy

MAP = "map<string,string>"


def unfenced(text: Column) -> Column:
    """The text inside the first json fence, else inside the first fence, else the text itself; stripped."""
    body = strip(text)
    json_part = F.split(F.split(body, "```json", 3)[1], "```", 2)[0]
    any_part = F.split(body, "```", 3)[1]
    return strip(F.when(body.contains("```json"), json_part).when(body.contains("```"), any_part).otherwise(body))


def payload(text: Column) -> Column:
    """map of the JSON object in a model's answer; null where there is none."""
    return let(unfenced(text), lambda b: F.from_json(F.when(b.startswith("{") & b.endswith("}"), b), MAP))


def value_text(v: Column) -> Column:
    """Text of a JSON value (a variant): null for what counts as empty (false, 0, "", [], {}, null), True for true."""

    def of(kind: Column) -> Column:
        text = v.try_cast("string")
        return (
            F.when(kind == "BOOLEAN", F.when(text == "true", "True"))
            .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.when(text.try_cast("double") != 0, text))
            .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.when(~F.to_json(v).isin("[]", "{}"), F.to_json(v)))
            .when(kind != "VOID", F.when(text != "", text))
        )

    return let(F.schema_of_variant(v), of)


def answers(text: Column) -> Column:
    """map<string,string> of the JSON object in a model's answer as value_text; null where there is none."""
    typed = lambda b: F.from_json(F.when(b.startswith("{") & b.endswith("}"), b), "map<string,variant>")
    return let(unfenced(text), lambda b: F.transform_values(typed(b), lambda k, v: value_text(v)))


def first_answers(*attempts: Column) -> Column:
    """answers of the first attempt that parses."""
    return F.coalesce(*(answers(a) for a in attempts))


def first_payload(*answers: Column) -> Column:
    """The first attempt that parses."""
    return F.coalesce(*(payload(a) for a in answers))


def merge(df: DataFrame, answer: str, fields: list[str]) -> DataFrame:
    """Each field from the payload column if that has it filled, else as it was; unknown keys are ignored."""
    return df.withColumns({f: or_keep(F.col(answer)[f], f) for f in fields})


def last_filled(value: Column | str, order: str) -> Column:
    """Aggregate: the stripped value of the latest row in which it is filled."""
    return F.max_by(strip(value), F.when(filled(value), col(order)))


def missing_fields(fields: list[str], complete: str) -> Column:
    """Names of blank fields, comma-joined, or the given text."""
    names = F.array_compact(F.array(*(F.when(~truthy(f), F.lit(f)) for f in fields)))
    return F.when(F.size(names) == 0, complete).otherwise(F.array_join(names, ", "))


def implicit_needs(family_size: Column, price_sensitivity: Column, powertrain: Column, expertise: Column) -> dict[str, Column]:
    """Deduced needs: of large families, of price-sensitive, electric and novice buyers."""
    large, saves = family_size.try_cast("int") > 3, F.lower(price_sensitivity) == "high"
    electric, novice = F.lower(powertrain).contains("electric"), F.lower(expertise) == "beginner"
    return {
        "family_friendliness": F.when(large, "High"),
        "space": F.when(large, "Large"),
        "cost_performance": F.when(saves, "High"),
        "energy_consumption_level": F.when(electric, "Low"),
        "driving_range": F.when(electric, "High"),
        "safety": F.when(novice, "High"),
        "smartness": F.when(novice, "High"),
    }


def bracketed_list(text: Column) -> Column:
    """array<string> from the first [ to the last ]."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), "array<string>")
