"""Queries of dialogue turns, extractors, field scores, reports, stores and the built index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from forecourt.functions.vocabulary import EXPLICIT_FIELDS, IMPLICIT_FIELDS, PROFILE_FIELDS, RESERVATION_FIELDS, STAGES
from forecourt.operators import agent, assembly, catalogue, evaluation, records, retrieval, speech
from forecourt.plans.dialogue_queries import EVENT_STAGE_SQL, STAGE_LIST, event_stage
from forecourt.plans.retrieval_queries import table
from forecourt.sources import record_store

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- extractors: answers made from the customer's key, as SQL texts that both engines evaluate ----------------

def _answers(fields: list[str]):
    """A first attempt that fails for a third of the rows and a second one, over two of the fields."""
    k = F.col("c_custkey")
    odd = F.when(k % 6 == 0, "false").when(k % 6 == 1, "0").when(k % 6 == 2, "true").when(k % 6 == 3, '"  "').when(k % 6 == 4, "[]").otherwise(k.cast("string"))
    body = F.concat(F.lit(f'{{"{fields[0]}": " v'), k.cast("string"), F.lit(f' ", "{fields[1]}": '), odd, F.lit(', "unknown": "x"}'))
    return F.when(k % 3 == 0, F.lit("{broken")).otherwise(body), F.when(k % 3 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).otherwise(F.lit("not asked"))


EXTRACTED_SQL = "SELECT c_custkey, 'v' || c_custkey AS first, CASE c_custkey % 6 WHEN 2 THEN 'True' WHEN 5 THEN CAST(c_custkey AS VARCHAR) ELSE 'old' END AS second, 'old' AS last FROM customer"


def _extracted(spark, sf_dir, extractor, fields):
    one, two = _answers(fields)
    rows = table(spark, sf_dir, "customer").select("c_custkey", one.alias("_one"), two.alias("_two"), *(F.lit("old").alias(f) for f in fields))
    found = extractor(rows, ["_one", "_two"])
    return found.select("c_custkey", F.col(fields[0]).alias("first"), F.col(fields[1]).alias("second"), F.col(fields[-1]).alias("last"))


@query(EXTRACTED_SQL)
def extract_profile(spark, sf_dir):
    return _extracted(spark, sf_dir, agent.extract_profile, PROFILE_FIELDS)


@query(EXTRACTED_SQL)
def extract_explicit_needs(spark, sf_dir):
    return _extracted(spark, sf_dir, agent.extract_explicit, EXPLICIT_FIELDS)


@query(EXTRACTED_SQL)
def extract_implicit_needs(spark, sf_dir):
    return _extracted(spark, sf_dir, agent.extract_implicit, IMPLICIT_FIELDS)


@query(EXTRACTED_SQL)
def extract_reservation(spark, sf_dir):
    return _extracted(spark, sf_dir, agent.extract_reservation, RESERVATION_FIELDS)


#: Field j of customer k is empty, true, a number, a padded text or null by (k + j) % 5; what isn't filled (the number 0 too) stays old.
def _every(fields: list[str]):
    k = F.col("c_custkey")
    value = lambda j: F.when((k + j) % 5 == 0, '""').when((k + j) % 5 == 1, "true").when((k + j) % 5 == 2, k.cast("string")).when((k + j) % 5 == 3, F.concat(F.lit('" v'), k.cast("string"), F.lit(f'_{j} "'))).otherwise("null")
    return F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{f}": '), value(j)) for j, f in enumerate(fields))), F.lit("}"))


def _every_sql(fields: list[str], heard: str = "TRUE") -> str:
    one = "CASE WHEN NOT ({heard}) THEN 'old' WHEN (c_custkey + {j}) % 5 = 1 THEN 'True' WHEN (c_custkey + {j}) % 5 = 2 AND c_custkey <> 0 THEN CAST(c_custkey AS VARCHAR) WHEN (c_custkey + {j}) % 5 = 3 THEN 'v' || c_custkey || '_{j}' ELSE 'old' END AS \"{f}\""
    return ", ".join(one.format(heard=heard, j=j, f=f) for j, f in enumerate(fields))


def _extract_every(spark, sf_dir, extractor, fields):
    """All fields of an extractor; the first attempt is broken for a third of the rows, whose second one is fenced."""
    k, body = F.col("c_custkey"), _every(fields)
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, "{broken").otherwise(body).alias("_one"), F.when(k % 3 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).otherwise("not asked").alias("_two"), *(F.lit("old").alias(f) for f in fields))
    return extractor(rows, ["_one", "_two"]).select("c_custkey", *fields)


@query(f"SELECT c_custkey, {_every_sql(PROFILE_FIELDS)} FROM customer")
def profile_fields(spark, sf_dir):
    return _extract_every(spark, sf_dir, agent.extract_profile, PROFILE_FIELDS)


@query(f"SELECT c_custkey, {_every_sql(EXPLICIT_FIELDS)} FROM customer")
def explicit_needs_fields(spark, sf_dir):
    return _extract_every(spark, sf_dir, agent.extract_explicit, EXPLICIT_FIELDS)


@query(f"SELECT c_custkey, {_every_sql(IMPLICIT_FIELDS)} FROM customer")
def implicit_needs_fields(spark, sf_dir):
    return _extract_every(spark, sf_dir, agent.extract_implicit, IMPLICIT_FIELDS)


@query(f"SELECT c_custkey, {_every_sql(RESERVATION_FIELDS)} FROM customer")
def reservation_fields(spark, sf_dir):
    return _extract_every(spark, sf_dir, agent.extract_reservation, RESERVATION_FIELDS)


@query(f"SELECT c_custkey, {_every_sql(EXPLICIT_FIELDS, 'c_custkey % 4 < 2')}, {_every_sql(IMPLICIT_FIELDS, 'c_custkey % 4 = 0')} FROM customer")
def combined_needs_fields(spark, sf_dir):
    """All 36 fields from one answer: both parts, explicit needs only, a part that is no object, a broken one."""
    k, part = F.col("c_custkey") % 4, lambda name, fields: F.concat(F.lit(f'"{name}": '), _every(fields))
    explicit, implicit = part("explicit", EXPLICIT_FIELDS), part("implicit", IMPLICIT_FIELDS)
    whole = lambda *parts: F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    answer = F.when(k == 0, whole(explicit, implicit)).when(k == 1, whole(explicit)).when(k == 2, whole(explicit, F.lit('"implicit": [1]'))).otherwise("{")
    rows = table(spark, sf_dir, "customer").select("c_custkey", answer.alias("_answer"), *(F.lit("old").alias(f) for f in EXPLICIT_FIELDS + IMPLICIT_FIELDS))
    return agent.extract_needs(rows, "_answer").select("c_custkey", *EXPLICIT_FIELDS, *IMPLICIT_FIELDS)


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN c_mktsegment ELSE 'old' END AS brand, CASE WHEN c_custkey % 4 = 0 THEN 'High' ELSE 'old' END AS safety FROM customer"""
)
def extract_combined_needs(spark, sf_dir):
    """One answer with both parts, one with explicit needs only, one with a part that is no object, one that is broken."""
    k, brand = F.col("c_custkey") % 4, F.col("c_mktsegment")
    explicit = F.concat(F.lit('"explicit": {"brand": "'), brand, F.lit('"}'))
    answer = F.when(k == 0, F.concat(F.lit("{"), explicit, F.lit(', "implicit": {"safety": "High"}}'))).when(k == 1, F.concat(F.lit("{"), explicit, F.lit("}"))).when(k == 2, F.concat(F.lit("{"), explicit, F.lit(', "implicit": "x"}'))).otherwise("{")
    rows = table(spark, sf_dir, "customer").select("c_custkey", answer.alias("_answer"), *(F.lit("old").alias(f) for f in EXPLICIT_FIELDS + IMPLICIT_FIELDS))
    return agent.extract_needs(rows, "_answer").select("c_custkey", "brand", "safety")


# ---- the turn -------------------------------------------------------------------------------------------------

#: State and answers of customer k's turn: every part answers all the time, but only the entry stage's extractor is heard.
TURN_SQL = f"""WITH c AS (SELECT c_custkey AS k, {STAGE_LIST}[c_custkey % 7 + 1] AS stage, c_custkey % 5 AS f, c_custkey % 3 AS r FROM customer),
e AS (SELECT *, CASE WHEN stage IN ('welcome', 'profile_analysis') AND f > 0 THEN 'n' || k ELSE '' END AS name, CASE WHEN stage IN ('needs_analysis', 'car_selection_confirmation') AND f > 1 THEN 'b' ELSE '' END AS brand,
  CASE WHEN stage IN ('reservation4s', 'reservation_confirmation') AND f > 2 THEN 'd' ELSE '' END AS day, CASE r WHEN 0 THEN 'new' WHEN 1 THEN '' END AS retrieved, CASE WHEN k % 2 = 0 THEN 'car' ELSE '' END AS old FROM c),
{{cars}}
s AS (SELECT *, CASE WHEN stage = 'welcome' THEN 'profile_analysis' WHEN stage = 'profile_analysis' AND name <> '' THEN 'needs_analysis' WHEN stage = 'needs_analysis' AND brand <> '' THEN 'car_selection_confirmation'
  WHEN stage = 'car_selection_confirmation' AND had <> '' THEN 'reservation4s' WHEN stage = 'reservation4s' AND day <> '' THEN 'reservation_confirmation' WHEN stage = 'reservation_confirmation' AND day <> '' THEN 'farewell' ELSE stage END AS nxt FROM m)
SELECT k AS c_custkey, stage AS previous_stage, nxt AS stage, nxt <> stage AS stage_changed, name, brand, day, {{shown}} AS cars FROM s"""


def _turns(spark, sf_dir, process):
    k = F.col("c_custkey")
    f, r = k % 5, k % 3
    given = lambda least, text: F.when(f > least, text).otherwise(F.lit("{}"))
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.get(F.array(*map(F.lit, STAGES)), (k % 7).cast("int")).alias("stage"),
        F.when(k % 2 == 0, F.array(F.lit("car"))).otherwise(none).alias("matched_cars"),
        F.when(r == 0, F.array(F.lit("new"))).when(r == 1, none).alias("retrieved_cars"),
        given(0, F.concat(F.lit('{"name": "n'), k.cast("string"), F.lit('"}'))).alias("_profile"),
        given(1, F.lit('{"explicit": {"brand": "b", "prize": "p"}}')).alias("_needs"),
        given(2, F.lit('{"reservation_date": "d", "reservation_time": "t", "reservation_location": "l", "test_driver": "x", "reservation_phone_number": "1"}')).alias("_reservation"),
        *(F.lit("").alias(x) for x in PROFILE_FIELDS + EXPLICIT_FIELDS + IMPLICIT_FIELDS + RESERVATION_FIELDS),
    )
    found = process(rows, ["_profile"], "_needs", ["_reservation"])
    return found.select("c_custkey", "previous_stage", "stage", "stage_changed", "name", "brand", F.col("reservation_date").alias("day"), F.array_join("matched_cars", ",").alias("cars"))


@query(TURN_SQL.format(cars="m AS (SELECT *, CASE WHEN retrieved <> '' THEN retrieved ELSE old END AS had FROM e),", shown="had"))
def turn_process(spark, sf_dir):
    return _turns(spark, sf_dir, agent.process_turns)


@query(TURN_SQL.format(cars="m AS (SELECT *, old AS had FROM e),", shown="CASE WHEN nxt IN ('needs_analysis', 'car_selection_confirmation') THEN coalesce(retrieved, old) ELSE old END"))
def turn_process_legacy(spark, sf_dir):
    return _turns(spark, sf_dir, agent.process_turns_legacy)


# ---- field scores, stage accuracy, reports --------------------------------------------------------------------

FIELDS_SQL = """WITH c AS (SELECT {group} AS "group", c_custkey AS k, c_name, c_mktsegment, c_nationkey FROM customer),
s AS (SELECT "group", sum((k % 5 <> 0)::INT + (k % 3 <> 0)::INT) AS correct, sum(1 + 1 + 0 - (k % 5 = 0)::INT) AS extracted, sum(3) AS expected FROM c GROUP BY 1),
r AS (SELECT *, CASE WHEN extracted = 0 THEN 1.0 ELSE correct / extracted END::DOUBLE AS p, CASE WHEN expected = 0 THEN 1.0 ELSE correct / expected END::DOUBLE AS q FROM s)
SELECT "group", CAST(correct AS BIGINT) AS correct, CAST(extracted AS BIGINT) AS extracted, CAST(expected AS BIGINT) AS expected, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 6) AS f1 FROM r"""


def _answered(customers, group):
    """Expected and extracted maps: a name in another case, a segment that is wrong for a third, a nation that is missing, one that isn't expected."""
    k = F.col("c_custkey")
    expected = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("blank"), F.lit(""))
    extracted = F.create_map(F.lit("name"), F.when(k % 5 != 0, F.concat(F.lit(" "), F.upper("c_name"), F.lit(" "))).otherwise(""), F.lit("segment"), F.when(k % 3 == 0, "wrong").otherwise(F.lower("c_mktsegment")), F.lit("blank"), F.lit("x"), F.lit("other"), F.lit("y"))
    return customers.select(group, expected.alias("expected"), extracted.alias("extracted"))


def _fields(spark, sf_dir, group):
    found = evaluation.extraction_report(_answered(table(spark, sf_dir, "customer"), group.alias("g")), "expected", "extracted", F.col("g"))
    return found.withColumns({x: F.round(x, 6) for x in ("precision", "recall", "f1")})


@query(FIELDS_SQL.format(group="c_mktsegment"))
def extraction_prf1(spark, sf_dir):
    return _fields(spark, sf_dir, F.col("c_mktsegment"))


@query(FIELDS_SQL.format(group="'all'"))
def extraction_prf1_micro(spark, sf_dir):
    return _fields(spark, sf_dir, F.lit("all"))


@query(
    f"""WITH t AS (SELECT user_id, {EVENT_STAGE_SQL} AS actual, {STAGE_LIST}[event_id % 5 + 1] AS expected FROM events),
    u AS (SELECT user_id, count(*) AS n, sum(CASE WHEN expected = actual THEN 1 ELSE 0 END) AS k FROM t GROUP BY user_id) SELECT round(avg(k / n), 6) AS macro, round(sum(k) / sum(n), 6) AS micro FROM u"""
)
def stage_accuracy(spark, sf_dir):
    turns = table(spark, sf_dir, "events").select("user_id", event_stage().alias("actual"), F.get(F.array(*map(F.lit, STAGES)), (F.col("event_id") % 5).cast("int")).alias("expected"))
    return evaluation.stage_accuracy(turns, "user_id", "expected", "actual").select(F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"))


#: Scores of a user's dialogue, made from its events.
DIALOGUES_SQL = f"""SELECT user_id, count(*) AS turns, avg(value) AS overall, avg(CASE WHEN {EVENT_STAGE_SQL} = {STAGE_LIST}[event_id % 5 + 1] THEN 1.0 ELSE 0.0 END) AS stage_accuracy, max(value) AS relevance, min(value) AS task_completion,
(max(list_position({STAGE_LIST}, {EVENT_STAGE_SQL})) + 0) / 7 * 100 AS conversion, avg(value) / 2 AS professionalism, avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 100.0 END) AS language FROM events GROUP BY user_id"""


def _dialogues(spark, sf_dir):
    from forecourt.operators import funnel

    e, v = table(spark, sf_dir, "events").withColumn("stage", event_stage()), F.col("value")
    expected = F.get(F.array(*map(F.lit, STAGES)), (F.col("event_id") % 5).cast("int"))
    return e.groupBy("user_id").agg(
        F.count("*").alias("turns"), F.avg(v).alias("overall"), F.avg((F.col("stage") == expected).cast("double")).alias("stage_accuracy"), F.max(v).alias("relevance"), F.min(v).alias("task_completion"),
        evaluation.funnel_score(F.max(funnel.stage_index(F.col("stage")))).alias("conversion"), (F.avg(v) / 2).alias("professionalism"), F.avg(F.when(F.col("event_type") == "error", 0.0).otherwise(100.0)).alias("language"),
    )


DIALOGUES_WRITTEN_SQL = f"""SELECT CAST(count(*) AS BIGINT) AS dialogues, CAST(sum(turns) AS BIGINT) AS turns, round(avg(overall), 1) AS avg_overall, round(avg(stage_accuracy * 100), 1) AS avg_stage_accuracy, round(avg(relevance), 1) AS avg_relevance,
    round(avg(task_completion), 1) AS avg_task_completion, round(avg(conversion), 1) AS avg_conversion, round(avg(professionalism), 1) AS avg_professionalism, round(avg(language), 1) AS avg_language FROM ({DIALOGUES_SQL})"""


@query(DIALOGUES_WRITTEN_SQL)
def report_totals(spark, sf_dir):
    return evaluation.report_totals(_dialogues(spark, sf_dir))


@query(f"SELECT CAST(count(*) AS BIGINT) AS n_reports, CAST(max(n) AS BIGINT) AS dialogues FROM (SELECT count(*) AS n FROM ({DIALOGUES_SQL}))")
def report_written(spark, sf_dir):
    """The report as JSON in the shared folder, read back."""
    path = record_store.write_report(evaluation.report_totals(_dialogues(spark, sf_dir)), f"{record_store.shared_folder(spark)}/reports-{uuid.uuid4().hex}", "20240101_000000")
    return spark.read.schema("dialogues bigint").json(path).agg(F.count("*").alias("n_reports"), F.max("dialogues").alias("dialogues"))


EXTRACTOR_SQL = "CASE c_custkey % 3 WHEN 0 THEN 'profile' WHEN 1 THEN 'needs' ELSE 'reservation' END"
KPI_SQL = f"""WITH x AS ({FIELDS_SQL.format(group=EXTRACTOR_SQL)}),
t AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER ({EVENT_STAGE_SQL} = {STAGE_LIST}[event_id % 5 + 1]) AS DOUBLE) AS k FROM events),
l AS (SELECT list(value ORDER BY value) AS a FROM events),
r AS (SELECT 'extraction' AS section, "group" AS name, unnest(['precision', 'recall', 'f1']) AS metric, unnest([precision, recall, f1]) AS value FROM x
UNION ALL SELECT 'stages', 'all', unnest(['accuracy', 'right', 'turns']), unnest([k / n, k, n]) FROM t
UNION ALL SELECT 'latency', 'all', unnest(['avg', 'p50', 'p95', 'max', 'samples']), unnest([list_avg(a), a[len(a) // 2 + 1], a[floor(len(a) * 0.95::DOUBLE)::INT + 1], list_max(a), len(a)::DOUBLE]) FROM l),
g AS (SELECT *, CASE WHEN metric = 'f1' THEN CASE name WHEN 'needs' THEN 0.85 ELSE 0.9 END WHEN metric = 'accuracy' THEN 1.0 WHEN metric = 'avg' THEN 10.0 WHEN metric = 'p95' THEN 50.0 END::DOUBLE AS target FROM r)
SELECT section, name, metric, round(value, 6) AS value, target, coalesce(CAST(CASE WHEN section = 'latency' THEN value < target ELSE value >= target END AS VARCHAR), 'no target') AS met FROM g"""


def _kpi_inputs(spark, sf_dir):
    """Answers of three extractors over the customers, expected and actual stages and latencies of the events."""
    k = F.col("c_custkey")
    extractor = F.when(k % 3 == 0, "profile").when(k % 3 == 1, "needs").otherwise("reservation")
    turns = table(spark, sf_dir, "events").select(event_stage().alias("actual"), F.get(F.array(*map(F.lit, STAGES)), (F.col("event_id") % 5).cast("int")).alias("expected"))
    return _answered(table(spark, sf_dir, "customer"), extractor.alias("extractor")), turns, table(spark, sf_dir, "events").select(F.col("value").alias("ms"))


@query(KPI_SQL)
def kpi_report(spark, sf_dir):
    rows = evaluation.kpi_report(*_kpi_inputs(spark, sf_dir))
    return rows.withColumns({"value": F.round("value", 6), "met": F.coalesce(F.col("met").cast("string"), F.lit("no target"))})


@query(DIALOGUES_WRITTEN_SQL)
def report_columns_written(spark, sf_dir):
    """All columns of the written report, read back."""
    totals = evaluation.report_totals(_dialogues(spark, sf_dir))
    path = record_store.write_report(totals, f"{record_store.shared_folder(spark)}/reports-{uuid.uuid4().hex}", "20240101_000000")
    return spark.read.schema(totals.schema).json(path)


# ---- messages, prompts, voice ---------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role FROM conversations ORDER BY turn DESC, conv_id DESC LIMIT 50")
def message_page(spark, sf_dir):
    return agent.message_page(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["turn", "conv_id"])


@query("""SELECT conv_id, '[' || string_agg('{"message_id":"msg_' || turn || '","sender_type":"' || CASE WHEN role = 'user' THEN 'user' ELSE 'system' END || '","content":' || to_json(coalesce(text, '')) || '}', ',' ORDER BY turn) || ']' AS messages FROM conversations GROUP BY conv_id""")
def message_lists(spark, sf_dir):
    found = agent.message_lists(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return found.select("conv_id", F.to_json("messages").alias("messages"))


@query("SELECT event_id, 's-' || user_id AS session_id, 'msg_' || epoch_us(ts) AS message_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS timestamp FROM events")
def message_ids(spark, sf_dir):
    """Ids and time stamps by a clock of our own: the event's."""
    e = table(spark, sf_dir, "events")
    utc = F.to_timestamp(F.col("ts").cast("string"))
    return agent.with_ids(e.withColumn("now", utc), F.col("now"), F.concat(F.lit("s-"), F.col("user_id").cast("string"))).select("event_id", "session_id", "message_id", "timestamp")


TEMPLATES = {"welcome": "Greet {name}.", "needs_analysis": "Ask {name} for needs: {missing}.", "farewell": "Thank {name}."}


@query("SELECT c_custkey, CASE c_custkey % 7 WHEN 2 THEN 'Ask ' || c_name || ' for needs: ' || c_mktsegment || '.' WHEN 6 THEN 'Thank ' || c_name || '.' ELSE 'Greet ' || c_name || '.' END AS prompt FROM customer")
def prompt_rendering(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("stage", F.get(F.array(*map(F.lit, STAGES)), (F.col("c_custkey") % 7).cast("int")))
    return c.select("c_custkey", agent.prompts(c, TEMPLATES, {"name": F.col("c_name"), "missing": F.col("c_mktsegment")}).alias("prompt"))


@query(
    """SELECT conv_id, turn, step, event, CASE event WHEN 'transcription' THEN text WHEN 'response' THEN 'to ' || text END AS payload FROM (SELECT conv_id, turn, text, unnest(['transcription', 'response', 'tts_start']) AS event, unnest([0, 1, 2]) AS step FROM conversations)
    WHERE step = 0 OR text <> ''"""
)
def voice_events(spark, sf_dir):
    return agent.voice_events(table(spark, sf_dir, "conversations").withColumn("answer", F.concat(F.lit("to "), F.col("text"))), "conv_id", "turn", "text", "answer")


@query("SELECT vec_id, round(1 - CASE WHEN label % 3 = 0 THEN 0 ELSE label / 10.0 END, 6) AS confidence, label % 2 = 0 AS speaks FROM embeddings")
def speech_confidence(spark, sf_dir):
    label = F.col("label")
    locale = F.when(label % 2 == 0, "zh-CN").otherwise("en-US")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(speech.confidence(F.when(label % 3 != 0, label / 10.0)), 6).alias("confidence"), speech.voices_of(locale, "zh").alias("speaks"))


# ---- records and catalogue ------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 < 8 THEN c_name END AS name, CASE WHEN c_custkey % 10 < 8 THEN c_mktsegment END AS residence FROM customer WHERE c_custkey % 2 = 0")
def profile_lookup(spark, sf_dir):
    """A store of lines of both shapes, some missing and some corrupt; every second key is looked up."""
    k, c = F.col("c_custkey"), table(spark, sf_dir, "customer")
    flat = F.to_json(F.struct(k.cast("string").alias("phone_number"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("residence")))
    nested = F.to_json(F.struct(k.cast("string").alias("phone_number"), F.struct(F.col("c_mktsegment").alias("residence")).alias("additional_information"), F.struct(F.col("c_name").alias("name")).alias("connection_information")))
    line = F.when(k % 10 == 8, F.lit("{corrupt")).when(k % 3 == 0, nested).otherwise(flat)
    folder = f"{record_store.shared_folder(spark)}/profiles-{uuid.uuid4().hex}"
    c.where(k % 10 != 9).select(line.alias("value")).write.text(folder)
    found = record_store.lookup(record_store.read_profiles(spark, folder, "phone_number"), c.where(k % 2 == 0).select(k.cast("string").alias("key")))
    return found.select(F.col("key").cast("bigint").alias("c_custkey"), "name", "residence")


@query("SELECT CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def record_keys(spark, sf_dir):
    folder = f"{record_store.shared_folder(spark)}/drives-{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("phone_number"))).alias("value")).write.text(folder)
    return record_store.keys_of(record_store.read_json(spark, folder, "phone_number string", "phone_number"))


@query("SELECT c_custkey AS phone_number, CASE WHEN n.k IS NOT NULL THEN n.day ELSE 'old' END AS reservation_date, 'phone' AS reservation_phone_number, CASE WHEN n.model <> '' THEN n.model ELSE 'car' END AS car_model FROM customer LEFT JOIN (SELECT o_custkey AS k, arg_max(CAST(o_orderdate AS DATE)::VARCHAR, o_orderkey) AS day, arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS model FROM orders GROUP BY 1) n ON n.k = c_custkey")
def reservation_merge(spark, sf_dir):
    """All orders of a customer as changes in the order of their keys; the reservation's phone isn't taken."""
    now = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("phone_number"), F.lit("old").alias("reservation_date"), F.lit("phone").alias("reservation_phone_number"), F.lit("car").alias("car_model"))
    changes = table(spark, sf_dir, "orders").join(now.select(F.col("phone_number").alias("o_custkey")), "o_custkey", "left_semi")
    changes = changes.select(F.col("o_custkey").alias("phone_number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("reservation_date"), F.lit("other").alias("reservation_phone_number"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("car_model"), "o_orderkey")
    return records.merge_reservation(now, changes, "phone_number", "o_orderkey")


@query("SELECT p_partkey, split_part(n, '-', 1) AS brand, split_part(n, '-', 2) AS model FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 4 = 0 THEN 'nohyphen' ELSE replace(p_brand, '#', '') || '-' || p_partkey END AS n FROM part) WHERE p_partkey % 4 <> 0 AND split_part(n, '-', 1) IN (SELECT replace(p_brand, '#', '') FROM part WHERE p_size = 1)")
def model_brands(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("b", F.replace("p_brand", F.lit("#"), F.lit("")))
    names = p.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "nohyphen").otherwise(F.concat_ws("-", "b", "p_partkey")).alias("name"))
    return records.known_models(names, p.where("p_size = 1").select(F.col("b").alias("brand"))).select("p_partkey", "brand", "model")


@query("SELECT o_orderkey, o_orderpriority AS priority, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders")
def dealer_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.struct(F.col("o_orderpriority").alias("priority")).alias("test_drive_info"))
    return records.dealer_rows(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "priority", "id")


@query(
    """WITH l AS (SELECT p_brand, p_partkey AS ord, 'label_' || CAST(p_size % 9 AS VARCHAR) || CASE WHEN p_partkey % 5 = 0 THEN '_comments' ELSE '' END AS label FROM part),
    r AS (SELECT *, coalesce(max((label = 'label_8')::INT) OVER (PARTITION BY p_brand ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM l)
    SELECT p_brand, label, CAST(min(ord) AS BIGINT) AS ord FROM r WHERE reached = 0 OR label LIKE '%\\_comments' ESCAPE '\\' OR label = 'label_8' GROUP BY 1, 2"""
)
def template_cleaned(spark, sf_dir):
    label = F.concat(F.lit("label_"), (F.col("p_size") % 9).cast("string"), F.when(F.col("p_partkey") % 5 == 0, "_comments").otherwise(""))
    return agent.cleaned_lines(table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("ord"), label.alias("label")), "p_brand", "ord", "label", "label_8")


@query("SELECT p_brand, unnest(list_concat(list(p_name ORDER BY p_partkey) FILTER (WHERE p_partkey % 2 = 0), list(p_name ORDER BY p_partkey) FILTER (WHERE p_partkey % 2 = 1))) AS model FROM part GROUP BY p_brand")
def model_lists(spark, sf_dir):
    """Lists of models per brand as files: written with existing and new models in turn (repeats stay), and read back."""
    named = lambda odd: F.transform(F.array_sort(F.collect_list(F.when(F.col("p_partkey") % 2 == odd, F.struct("p_partkey", "p_name")))), lambda x: x["p_name"])
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.concat(named(0), named(1)).alias("models"))  # a file's content
    folder = f"{record_store.shared_folder(spark)}/models-{uuid.uuid4().hex}"
    p.select("p_brand", agent.model_file(F.col("p_brand"), F.col("models")).alias("value")).write.partitionBy("p_brand").option("lineSep", "\x00").text(folder)
    rows = spark.read.text(folder, wholetext=True)
    return rows.select("p_brand", F.explode(agent.brand_models(F.col("value"))).alias("model"))


@query(
    """WITH l AS (SELECT p_brand, p_partkey AS line, 's' || CAST(p_size // 20 AS VARCHAR) AS section, 'l' || p_partkey AS label, p_type AS value FROM part)
    SELECT p_brand, section, label, value FROM l"""
)
def template_files(spark, sf_dir):
    """Templates written as a file a brand, their sections in order, and parsed again."""
    p = table(spark, sf_dir, "part")
    lines = p.select("p_brand", F.concat(F.lit("s"), F.floor(F.col("p_size") / 20).cast("string")).alias("section"), F.concat(F.lit("l"), F.col("p_partkey").cast("string")).alias("label"), F.col("p_type").alias("value"), "p_partkey")
    folder = f"{record_store.shared_folder(spark)}/templates-{uuid.uuid4().hex}"
    text = assembly.template_rows(lines, "p_brand", ["section", "p_partkey"])
    text.write.partitionBy("p_brand").option("maxRecordsPerFile", 0).text(folder)  # a brand is in one task, so in one file
    return catalogue.read_template_lines(spark, folder, "p_brand").withColumn("section", F.nullif("section", F.lit("")))


@query("SELECT conv_id, turn, left(coalesce(text, ''), 200) AS text, left('to ' || coalesce(text, ''), 200) AS response, round(length(coalesce(text, '')) / 7, 2) AS total_ms FROM conversations")
def turn_view(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("response", F.concat(F.lit("to "), F.coalesce("text", F.lit(""))))
    return t.select("conv_id", "turn", *agent.turn_view("text", "response", total_ms=F.length(F.coalesce("text", F.lit(""))) / 7))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'No vehicles matched yet.' ELSE '1. ' || CASE WHEN c_custkey % 3 = 1 THEN c_name ELSE 'Unknown' END || ' (relevance: ' || CASE WHEN c_custkey % 2 = 0 THEN '0.5' ELSE 'N/A' END || ')' || chr(10) || '   ' || left(repeat(c_mktsegment, 30), 200)
    || chr(10) || '2. second (relevance: 0.25)' || chr(10) || '   ' END AS cars FROM customer"""
)
def matched_cars_text(spark, sf_dir):
    k = F.col("c_custkey")
    car = lambda name, score, text: F.struct(name.alias("car_model"), score.cast("double").alias("score"), text.alias("text_snippet"))
    first = car(F.when(k % 3 == 1, F.col("c_name")), F.when(k % 2 == 0, 0.5), F.repeat("c_mktsegment", F.lit(30)))
    cars = F.when(k % 3 != 0, F.array(first, car(F.lit("second"), F.lit(0.25), F.lit(None).cast("string"))))
    return table(spark, sf_dir, "customer").select("c_custkey", retrieval.matched_cars_text(cars).alias("cars"))


WORDS_SQL = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '')"
BUCKETS_SQL = f"list_transform({WORDS_SQL}, lambda w: ('0x' || left(md5(w), 6))::INT % 64)"


@query(
    f"""WITH d AS (SELECT doc_id, lang, {BUCKETS_SQL} AS b FROM documents), v AS (SELECT doc_id, lang, list_transform(range(64), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS e FROM d),
    q AS (SELECT e FROM v WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE lang = 'en')), s AS (SELECT doc_id, round(list_cosine_similarity(v.e, q.e), 12) AS s FROM v, q WHERE lang = 'en')
    SELECT doc_id, round(s, 4) AS score FROM s WHERE s IS NOT NULL AND NOT isnan(s) ORDER BY s DESC, doc_id LIMIT 5"""
)
def index_build_search(spark, sf_dir):
    """Builds an index of all documents by the default embedding, opens it, and searches one language of it with a document's text."""
    folder = f"{record_store.shared_folder(spark)}/built-{uuid.uuid4().hex}"
    record_store.build_index(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), folder, "text", partition="lang")
    index = record_store.load_index(spark, folder).where("lang = 'en'")
    first = list(index.orderBy("doc_id").select("embedding").first()[0])
    return retrieval.top_k(index.select("doc_id", "embedding"), first, 5, key="doc_id").where("score is not null").select("doc_id", F.round("score", 4).alias("score"))
