"""Queries over conversations and sessions: payloads, merges, histories, the funnel, changes, turn buffers."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.functions.semantics import filled
from forecourt.functions.vocabulary import EDGES, STAGES
from forecourt.operators import extraction, funnel, sequence
from forecourt.plans.retrieval_queries import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, event_id % 4 <> 3 AS parsed FROM events")
def json_payload_parse(spark, sf_dir):
    p, kind = F.col("props"), F.col("event_id") % 4
    text = F.when(kind == 0, p).when(kind == 1, F.concat(F.lit("Sure:\n```json\n"), p, F.lit("\n```\nDone"))).when(kind == 2, F.concat(F.lit("```\n"), p, F.lit("```"))).otherwise(F.lit("no json here"))
    rows = table(spark, sf_dir, "events").select("event_id", extraction.payload(text).alias("m"))
    return rows.select("event_id", F.col("m")["k"].alias("k"), F.col("m").isNotNull().alias("parsed"))


@query(
    """SELECT conv_id, arg_max(trim(text), turn) FILTER (WHERE role = 'user' AND trim(text) <> '') AS last_user, arg_max(trim(text), turn) FILTER (WHERE role = 'assistant' AND trim(text) <> '') AS last_assistant
    FROM conversations GROUP BY conv_id"""
)
def merge_non_empty_wins(spark, sf_dir):
    of = lambda r: extraction.last_filled(F.when(F.col("role") == r, F.trim("text")), "turn").alias(f"last_{r}")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(of("user"), of("assistant"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS age FROM customer")
def payload_merge(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    first = F.when(k % 2 == 0, F.concat(F.lit('{"age": '), k.cast("string"), F.when(k % 3 == 0, F.lit(', "name": " new "')).otherwise(F.lit(', "name": "  "')), F.lit(', "other": "x"}')))
    second = F.when(k % 3 == 0, F.lit('```json\n{"name": "new"}\n```')).otherwise(F.lit("{broken"))
    rows = c.select("c_custkey", F.col("c_name").alias("name"), F.lit("").alias("age"), extraction.first_payload(first, second).alias("answer"))
    return extraction.merge(rows, "answer", ["name", "age"]).select("c_custkey", "name", "age")


@query("SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(text, ''), chr(10) ORDER BY turn) AS history FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def history_text(spark, sf_dir):
    return sequence.history(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


#: Facts of a turn, derived from the length of its text.
FACTS = {"name": "n % 3 = 0", "family_size": "n % 7 = 0", "brand": "n % 4 = 0", "prize": "n % 5 < 3", "style": "n % 6 = 1", "cars": "n % 2 = 0", "day": "n % 3 <> 1", "hour": "n % 4 <> 2", "place": "n % 5 <> 0", "driver": "n % 2 = 1", "phone": "n % 3 <> 2"}
STATELESS = [
    "stage = 'welcome'",
    "stage = 'profile_analysis' AND (n % 3 = 0 OR n % 7 = 0)",
    "stage = 'needs_analysis' AND (CAST(n % 4 = 0 AS INT) + CAST(n % 5 < 3 AS INT) + CAST(n % 6 = 1 AS INT)) >= 2",
    "stage = 'car_selection_confirmation' AND n % 2 = 0",
    "stage = 'reservation4s' AND n % 3 <> 1 AND n % 4 <> 2 AND n % 5 <> 0",
    "stage = 'reservation_confirmation' AND n % 3 <> 1 AND n % 4 <> 2 AND n % 5 <> 0 AND n % 2 = 1 AND n % 3 <> 2",
]
STAGE_LIST = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"


@query(
    f"WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, {STAGE_LIST}[turn % 7 + 1] AS stage FROM conversations) SELECT conv_id, turn, stage, CASE "
    + " ".join(f"WHEN {c} THEN '{STAGES[i + 1]}'" for i, c in enumerate(STATELESS))
    + " ELSE stage END AS next_stage FROM t"
)
def fsm_next_stage(spark, sf_dir):
    stages = F.array(*map(F.lit, STAGES))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.get(stages, (F.col("turn") % 7).cast("int")).alias("stage"))
    has = lambda k: F.when(F.expr(FACTS[k]), "x").otherwise("")
    nxt = funnel.next_stage(F.col("stage"), [has("name"), has("family_size")], [has("brand"), has("prize"), has("style")], F.expr(FACTS["cars"]), [has("day"), has("hour"), has("place")], [has("driver"), has("phone")])
    return t.select("conv_id", "turn", "stage", nxt.alias("next_stage"))


#: Per transition: facts, how many are needed, and the transition that opens their collection.
GATES = [([], 0, 0), (["name", "family_size"], 1, 0), (["brand", "prize", "style"], 2, 2), (["cars"], 1, 2), (["day", "hour", "place"], 3, 4), (["day", "hour", "place", "driver", "phone"], 5, 4)]
OPENED = ["st <= 1", "st <= 1", "st IN (2, 3)", "st IN (2, 3)", "st IN (2, 3)", "st IN (2, 3)", "st IN (4, 5)", "st IN (4, 5)", "st IN (4, 5)", "st IN (4, 5)", "st IN (4, 5)"]
_new = {k: f"(f_{k} OR ({o} AND {FACTS[k].replace('n %', 't.n %')}))" for (k, o) in zip(FACTS, [x.replace("st", "s.st") for x in OPENED], strict=True)}
_next = (
    f"CASE WHEN s.st = 0 THEN 1 WHEN s.st = 1 AND ({_new['name']} OR {_new['family_size']}) THEN 2 "
    f"WHEN s.st = 2 AND (CAST({_new['brand']} AS INT) + CAST({_new['prize']} AS INT) + CAST({_new['style']} AS INT)) >= 2 THEN 3 WHEN s.st = 3 AND {_new['cars']} THEN 4 "
    f"WHEN s.st = 4 AND {_new['day']} AND {_new['hour']} AND {_new['place']} THEN 5 WHEN s.st = 5 AND {_new['day']} AND {_new['hour']} AND {_new['place']} AND {_new['driver']} AND {_new['phone']} THEN 6 ELSE s.st END"
)


@query(
    f"""WITH RECURSIVE t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
    s AS (SELECT conv_id, CAST(0 AS BIGINT) AS rn, 0 AS st, {', '.join(f'false AS f_{k}' for k in FACTS)} FROM (SELECT DISTINCT conv_id FROM t)
    UNION ALL SELECT s.conv_id, t.rn, {_next}, {', '.join(_new[k] for k in FACTS)} FROM s JOIN t ON t.conv_id = s.conv_id AND t.rn = s.rn + 1)
    SELECT conv_id, {STAGE_LIST}[max(st) + 1] AS stage FROM s GROUP BY conv_id"""
)
def fsm_fold(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    gates = [([F.expr(FACTS[k]) for k in facts], least, opened) for facts, least, opened in GATES]
    return funnel.session_stages(t, "conv_id", "turn", gates)


@query("SELECT event_id, event_type, lag(event_type) OVER w AS previous, coalesce(event_type <> lag(event_type) OVER w, false) AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def stage_lag_changed(spark, sf_dir):
    by = sequence.turns_of("user_id", "ts", "event_id")
    return sequence.with_change(table(spark, sf_dir, "events"), by, "event_type").select("event_id", "event_type", "previous", "changed")


@query(
    """SELECT event_id, row_number() OVER w > 1 AND event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND coalesce(lag(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER w > 0, false) AS skip
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def skip_unchanged(spark, sf_dir):
    by = sequence.turns_of("user_id", "ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("matches", (F.col("value") > 50).cast("int"))
    return e.select("event_id", sequence.skippable(by, "event_type", "matches").alias("skip"))


EVENT_STAGE = {"view": STAGES[1], "click": STAGES[2], "signup": STAGES[3], "purchase": STAGES[4], "error": STAGES[0]}
EVENT_STAGE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_STAGE.items()) + " END"


def event_stage():
    return F.create_map(*(F.lit(x) for kv in EVENT_STAGE.items() for x in kv))[F.col("event_type")]


@query(
    f"""WITH t AS (SELECT user_id, {EVENT_STAGE_SQL} AS stage, lead({EVENT_STAGE_SQL}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_stage FROM events)
    SELECT stage, CAST(count(*) AS BIGINT) AS n_transitions, round(avg(CASE WHEN (stage, next_stage) IN ({', '.join(str(e) for e in EDGES)}) THEN 0.0 ELSE 1.0 END), 6) AS invalid_rate
    FROM t WHERE next_stage IS NOT NULL AND stage <> next_stage GROUP BY stage"""
)
def invalid_transition_rate(spark, sf_dir):
    by = sequence.turns_of("user_id", "ts", "event_id")
    t = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", event_stage().alias("stage")).withColumn("next_stage", F.lead("stage").over(by)).where("next_stage is not null and stage <> next_stage")
    ok = F.broadcast(funnel.edges(spark).withColumn("ok", F.lit(True)))  # the fixed edges
    return t.join(ok, ["stage", "next_stage"], "left").groupBy("stage").agg(F.count("*").alias("n_transitions"), F.round(F.avg(F.when(F.col("ok").isNull(), 1.0).otherwise(0.0)), 6).alias("invalid_rate"))


@query("SELECT event_id, round(least(100.0, (CAST(value AS INTEGER) % 5 - coalesce(lag(CAST(value AS INTEGER) % 5) OVER w, 0)) / 3.0 * 100.0), 4) AS rate FROM (SELECT event_id, ts, user_id, floor(value) AS value FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def info_gathering_rate(spark, sf_dir):
    by = sequence.turns_of("user_id", "ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("n_filled", F.floor("value").cast("int") % 5)
    return e.select("event_id", F.round(sequence.gathering_rate(by, "n_filled"), 4).alias("rate"))


@query(
    """WITH t AS (SELECT user_id, event_type = 'purchase' AS e, value, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM events),
    u AS (SELECT user_id, CAST(c - CASE WHEN e THEN 1 ELSE 0 END AS BIGINT) AS turn_id, e, value FROM t)
    SELECT user_id, turn_id, CAST(count(*) FILTER (WHERE NOT e) AS BIGINT) AS n_frames, round(sum(value) FILTER (WHERE NOT e), 4) AS total_size FROM u GROUP BY user_id, turn_id HAVING bool_or(e) AND count(*) FILTER (WHERE NOT e) > 0"""
)
def turn_buffer_batch(spark, sf_dir):
    found = sequence.closed_turns(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("value"))
    return found.withColumn("total_size", F.round("total_size", 4))


METRICS_SQL = """WITH f AS (SELECT user_id, event_type, min(event_id) AS a FROM events WHERE event_type <> '' GROUP BY ALL), l AS (SELECT user_id, string_agg(event_type, ',' ORDER BY a) AS languages FROM f GROUP BY user_id)
SELECT user_id, CAST(count(*) AS BIGINT) AS total_turns, round(sum(value), 2) AS total_ms, round(avg(value), 2) AS avg_ms, coalesce(any_value(languages), '') AS languages FROM events LEFT JOIN l USING (user_id) GROUP BY user_id"""


@query(METRICS_SQL)
def voice_session_metrics(spark, sf_dir):
    return sequence.session_metrics(table(spark, sf_dir, "events"), "user_id", "event_id", "value", "event_type")


@query("SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS turns_so_far, round(sum(value) OVER w, 4) AS total_so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def voice_running_metrics(spark, sf_dir):
    from pyspark.sql import Window

    by = sequence.turns_of("user_id", "ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(by).alias("turns_so_far"), F.round(F.sum("value").over(by), 4).alias("total_so_far"))


@query("SELECT role, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN trim(coalesce(text, '')) <> '' THEN 1.0 ELSE 0.0 END), 6) AS response_rate FROM conversations GROUP BY role")
def response_rate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(filled("text").cast("double")), 6).alias("response_rate"))


@query(
    """SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) FILTER (WHERE role IN ('user', 'assistant')) AS history, CAST(sum(n) AS BIGINT) AS n_tokens FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS later
    FROM (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^ \\n]+')) AS n FROM conversations)) WHERE later <= 60 GROUP BY conv_id HAVING bool_or(role IN ('user', 'assistant'))"""
)
def history_within_limit(spark, sf_dir):
    """The latest messages of sixty tokens at most, as a history text; a token is what spaces and line ends separate."""
    t = table(spark, sf_dir, "conversations").withColumn("n", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ \\n]+"), F.lit(0))))
    kept = sequence.latest_within(t, "conv_id", ["turn"], "n", 60)
    return sequence.history(kept, "conv_id", "turn", "role", "text").join(kept.groupBy("conv_id").agg(F.sum("n").alias("n_tokens")), "conv_id")
