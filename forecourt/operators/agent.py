"""Dialogue turns as rows: extractors over recorded answers, the turn itself, messages and prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.functions.semantics import let, or_keep, truthy
from forecourt.functions.vocabulary import EXPLICIT_FIELDS, IMPLICIT_FIELDS, PROFILE_FIELDS, RESERVATION_FIELDS, STAGES
from forecourt.operators import extraction, funnel
from forecourt.operators.assembly import keep_unless_new

#: Stages at whose turns each extractor runs.
PROFILE_STAGES, NEEDS_STAGES, RESERVATION_STAGES = STAGES[:2], STAGES[2:4], STAGES[4:6]
PAGE, SHOWN = 50, 200


def merged(found: Column, fields: list[str], when: Column | None = None) -> dict[str, Column]:
    """Each field from a map of answers if it is filled there (and the condition holds), else as it is."""
    new = {f: or_keep(found[f], f) for f in fields}
    return new if when is None else {f: F.when(when, c).otherwise(F.col(f)) for f, c in new.items()}


def extract(df: DataFrame, attempts: list[str], fields: list[str]) -> DataFrame:
    """Fields updated from the first of the recorded answers that parses; none leaves them as they are."""
    return df.withColumn("_found", extraction.first_answers(*map(F.col, attempts))).withColumns(merged(F.col("_found"), fields)).drop("_found")


def extract_profile(df: DataFrame, attempts: list[str]) -> DataFrame:
    return extract(df, attempts, PROFILE_FIELDS)


def extract_explicit(df: DataFrame, attempts: list[str]) -> DataFrame:
    return extract(df, attempts, EXPLICIT_FIELDS)


def extract_implicit(df: DataFrame, attempts: list[str]) -> DataFrame:
    return extract(df, attempts, IMPLICIT_FIELDS)


def extract_reservation(df: DataFrame, attempts: list[str]) -> DataFrame:
    return extract(df, attempts, RESERVATION_FIELDS)


def combined_needs(answer: Column) -> Column:
    """struct<explicit, implicit> of one payload's answers; null if it doesn't parse or a part isn't an object."""
    part = lambda whole, k: F.when(whole[k].isNull(), F.create_map().cast("map<string,string>")).otherwise(extraction.answers(whole[k]))
    both = lambda whole: F.when(whole.isNotNull(), F.struct(part(whole, "explicit").alias("explicit"), part(whole, "implicit").alias("implicit")))
    return let(let(extraction.payload(answer), both), lambda x: F.when(x["explicit"].isNotNull() & x["implicit"].isNotNull(), x))


def extract_needs(df: DataFrame, answer: str, when: Column | None = None) -> DataFrame:
    """Explicit and implicit needs from one answer, which isn't asked for again."""
    df = df.withColumn("_needs_found", combined_needs(F.col(answer)))
    new = merged(F.col("_needs_found.explicit"), EXPLICIT_FIELDS, when) | merged(F.col("_needs_found.implicit"), IMPLICIT_FIELDS, when)
    return df.withColumns(new).drop("_needs_found")


def _step(df: DataFrame, stage: str, cars: Column) -> Column:
    cols = lambda names: [F.col(n) for n in names]
    has_cars = F.coalesce(F.size(cars), F.lit(0)) > 0
    return funnel.next_stage(F.col(stage), cols(funnel.PROFILE), cols(funnel.NEEDS), has_cars, cols(funnel.PLACE), cols(funnel.CONTACT))


def _extracted(df: DataFrame, profile: list[str], needs: str, reservation: list[str]) -> DataFrame:
    """Extractors by the stage at which the turn begins."""
    stage = F.col("stage")
    df = df.withColumns({"_p": extraction.first_answers(*map(F.col, profile)), "_r": extraction.first_answers(*map(F.col, reservation))})
    df = df.withColumns(merged(F.col("_p"), PROFILE_FIELDS, stage.isin(PROFILE_STAGES)) | merged(F.col("_r"), RESERVATION_FIELDS, stage.isin(RESERVATION_STAGES)))
    return extract_needs(df, needs, stage.isin(NEEDS_STAGES)).drop("_p", "_r")


def process_turns(df: DataFrame, profile: list[str], needs: str, reservation: list[str], retrieved: str = "retrieved_cars") -> DataFrame:
    """One turn of each row's session state: extract by the entry stage, take retrieved cars if there are any, go at most a step on.

    A row has stage, matched_cars, all fields of profile, needs and reservation, the recorded answers and the retrieved
    cars. Adds previous_stage and stage_changed.
    """
    df = _extracted(df, profile, needs, reservation).withColumn("matched_cars", keep_unless_new(F.col(retrieved), F.col("matched_cars")))
    df = df.withColumn("previous_stage", F.col("stage")).withColumn("stage", _step(df, "stage", F.col("matched_cars")))
    return df.withColumn("stage_changed", F.col("stage") != F.col("previous_stage"))


def process_turns_legacy(df: DataFrame, profile: list[str], needs: str, reservation: list[str], retrieved: str = "retrieved_cars") -> DataFrame:
    """The older order: the step comes before retrieval, whose result replaces the cars even if it is empty (null: it failed)."""
    df = _extracted(df, profile, needs, reservation).withColumn("previous_stage", F.col("stage"))
    df = df.withColumn("stage", _step(df, "stage", F.col("matched_cars"))).withColumn("stage_changed", F.col("stage") != F.col("previous_stage"))
    return df.withColumn("matched_cars", F.when(F.col("stage").isin(NEEDS_STAGES), F.coalesce(retrieved, "matched_cars")).otherwise(F.col("matched_cars")))


def message_page(df: DataFrame, order: list, limit: int = PAGE) -> DataFrame:
    """The latest messages, newest first."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(limit)


def with_ids(df: DataFrame, clock: Column | None = None, unique: Column | None = None) -> DataFrame:
    """Adds session_id, message_id and timestamp (ISO, UTC). The clock and the source of unique ids can be replaced."""
    now = F.current_timestamp() if clock is None else clock
    iso = F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return df.withColumns({"session_id": F.uuid() if unique is None else unique, "message_id": F.concat(F.lit("msg_"), F.unix_micros(now.cast("timestamp")).cast("string")), "timestamp": iso})


def message_lists(df: DataFrame, session: str, turn: str, role: str, text: str) -> DataFrame:
    """Per session, array<struct<message_id, sender_type, content>> of its messages in order: user, and system for the rest."""
    who = F.when(F.col(role) == "user", "user").otherwise("system")
    one = F.struct(F.col(turn).alias("t"), F.concat(F.lit("msg_"), F.col(turn).cast("string")).alias("message_id"), who.alias("sender_type"), F.coalesce(text, F.lit("")).alias("content"))
    found = df.groupBy(session).agg(F.array_sort(F.collect_list(one)).alias("m"))  # the session's own messages are the result
    return found.select(session, F.transform("m", lambda x: x.dropFields("t")).alias("messages"))


def prompts(df: DataFrame, templates: dict[str, str], values: dict[str, Column], stage: str = "stage") -> Column:
    """The stage's template (the first stage's for an unknown one) with {name} replaced by values."""
    text = reduce(lambda e, kv: e.when(F.col(stage) == kv[0], kv[1]), list(templates.items())[1:], F.when(F.col(stage) == next(iter(templates)), next(iter(templates.values()))))
    text = text.otherwise(templates[STAGES[0]])
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), text)


def turn_view(text: str, response: str, **milliseconds: Column) -> list[Column]:
    """What a report shows of a turn: 200 characters of the message and of the response, times to two digits."""
    cut = lambda c: F.left(F.coalesce(F.col(c), F.lit("")), F.lit(SHOWN)).alias(c)
    return [cut(text), cut(response), *(F.round(c, 2).alias(k) for k, c in milliseconds.items())]


def voice_events(turns: DataFrame, session: str, turn: str, text: str, answer: str) -> DataFrame:
    """What a client is sent for each closed turn, in order: its transcription, the response and the start of speech."""
    events = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(k).alias("event"), v.alias("payload")) for i, (k, v) in enumerate((("transcription", F.col(text)), ("response", F.col(answer)), ("tts_start", F.lit(None).cast("string"))))))
    return turns.select(session, turn, F.explode(F.when(truthy(text), events).otherwise(F.slice(events, 1, 1))).alias("e")).select(session, turn, "e.*")


def cleaned_lines(lines: DataFrame, file: str, order: str, label: str, last_label: str) -> DataFrame:
    """Label lines of each file without repeats; after the last label of the template only comments (and that label) stay."""
    by = Window.partitionBy(file).orderBy(order)  # the lines of one file
    reached = F.coalesce(F.max(F.col(label) == last_label).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    kept = lines.withColumn("_reached", reached).where(~F.col("_reached") | F.col(label).endswith("_comments") | (F.col(label) == last_label)).drop("_reached")
    first = Window.partitionBy(file, label).orderBy(order)
    return kept.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def brand_models(text: Column) -> Column:
    """array<string>: the model list of a brand's file, whatever stands around it; empty if there is none."""
    return F.coalesce(extraction.bracketed_list(F.regexp_extract(text, r"(?s)model_list\s*=\s*(\[.*\])", 1)), F.array().cast("array<string>"))


def model_file(brand: Column, models: Column) -> Column:
    """The text of a brand's model list."""
    return F.concat(F.lit("# Models of "), brand, F.lit("\nmodel_list = "), F.to_json(models), F.lit("\n"))
