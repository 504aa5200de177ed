"""Streaming twins over the events table, processed as far as it is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.functions.vocabulary import STAGES
from forecourt.operators import funnel
from forecourt.plans.dialogue_queries import FACTS, GATES, STAGE_LIST
from forecourt.plans.dialogue_queries import ORACLES as DIALOGUE
from forecourt.streaming import conversations, sessions

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _frames(spark, sf_dir):
    e = sessions.stream_table(spark, sf_dir, "events")
    frames = e.select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "end_turn").otherwise("bytes").alias("kind"), F.col("value").alias("size"))
    return frames.withColumn("seq", F.concat(F.date_format("seq.ts", "yyyyMMddHHmmss.SSSSSS"), F.lpad(F.col("seq.event_id").cast("string"), 20, "0")))


@query(DIALOGUE["turn_buffer_batch"])
def stream_turn_buffer(spark, sf_dir):
    rows = sessions.run_available(sessions.state_by_key(_frames(spark, sf_dir), "session", sessions.TurnBuffer(), "session bigint, turn_id bigint, n_frames bigint, total_size double"), "update")
    return rows.select(F.col("session").alias("user_id"), "turn_id", "n_frames", F.round("total_size", 4).alias("total_size"))


@query(
    f"""SELECT user_id, turn_id, CAST(step AS INTEGER) AS step, event, n_frames
    FROM (SELECT user_id, turn_id, n_frames, unnest([0, 1, 2]) AS step, unnest(['transcription', 'response', 'tts_start']) AS event FROM ({DIALOGUE['turn_buffer_batch']}))"""
)
def stream_turn_events(spark, sf_dir):
    rows = sessions.run_available(sessions.state_by_key(_frames(spark, sf_dir), "session", sessions.TurnEvents(), "session bigint, turn_id bigint, step int, event string, n_frames bigint"), "update")
    return rows.select(F.col("session").alias("user_id"), "turn_id", "step", "event", "n_frames")


@query(DIALOGUE["fsm_fold"].replace(f"SELECT conv_id, {STAGE_LIST}", f"SELECT conv_id, CAST(max(rn) AS BIGINT) AS turns, {STAGE_LIST}"))
def stream_session_state(spark, sf_dir):
    """The funnel over conversations as a stream: each session's stage and turns after all of its turns."""
    bits, rules = funnel.fact_bits([([F.expr(FACTS[k]) for k in facts], least, opened) for facts, least, opened in GATES])
    t = sessions.stream_table(spark, sf_dir, "conversations").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    t = t.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), bits.alias("facts"))
    rows = sessions.run_available(sessions.state_by_key(t, "session", sessions.ChatState(rules), "session bigint, stage int, previous int, turns bigint, ended boolean"), "update")
    last = sessions.latest(rows, "session")
    return last.select(F.col("session").alias("conv_id"), F.get(F.array(*map(F.lit, STAGES)), F.col("stage")).alias("stage"), "turns")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS total_turns, round(sum(value), 2) AS total_ms FROM events GROUP BY user_id")
def stream_metrics(spark, sf_dir):
    e = sessions.stream_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total_turns"), F.sum("value").alias("total_ms"))
    return sessions.latest(sessions.run_available(e, "update"), "user_id").withColumn("total_ms", F.round("total_ms", 2))


#: The fields that a turn's facts fill, the stages that hear them, and how a session with them goes on.
FILLED = {"name": "name", "family_size": "family_size", "brand": "brand", "prize": "prize", "style": "design_style", "day": "reservation_date", "hour": "reservation_time", "place": "reservation_location", "driver": "test_driver", "phone": "reservation_phone_number"}
PARTS = {"profile": ("name", "family_size"), "explicit": ("brand", "prize", "style"), "reservation": ("day", "hour", "place", "driver", "phone")}
ENTRY = {"profile": "s.st <= 1", "explicit": "s.st IN (2, 3)", "reservation": "s.st IN (4, 5)"}
_value = {k: f"CASE WHEN {ENTRY[part]} AND {FACTS[k].replace('n %', 't.n %')} THEN '{k}' || t.turn ELSE s.v_{k} END" for part, keys in PARTS.items() for k in keys}
_cars = f"CASE WHEN {FACTS['cars'].replace('n %', 't.n %')} THEN 'car' || t.turn ELSE s.cars END"
_has = lambda k: f"({_value[k]}) <> ''"
_place = " AND ".join(map(_has, ("day", "hour", "place")))
_step = f"""CASE WHEN s.st = 0 THEN 1 WHEN s.st = 1 AND ({_has('name')} OR {_has('family_size')}) THEN 2 WHEN s.st = 2 AND {' + '.join(f'CAST({_has(k)} AS INT)' for k in ('brand', 'prize', 'style'))} >= 2 THEN 3
  WHEN s.st = 3 AND ({_cars}) <> '' THEN 4 WHEN s.st = 4 AND {_place} THEN 5 WHEN s.st = 5 AND {_place} AND {_has('driver')} AND {_has('phone')} THEN 6 ELSE s.st END"""
CONVERSATION_SQL = f"""WITH RECURSIVE t AS (SELECT conv_id, turn, text, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
    s AS (SELECT conv_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS turn, 0 AS st, 0 AS before, CAST(NULL AS VARCHAR) AS response, '' AS cars, {', '.join(f"'' AS v_{k}" for k in _value)} FROM (SELECT DISTINCT conv_id FROM t)
    UNION ALL SELECT s.conv_id, t.rn, t.turn, {_step}, s.st, CASE WHEN t.n % 5 = 0 THEN '{conversations.APOLOGY}' ELSE 'Reply ' || t.turn END, {_cars}, {', '.join(_value.values())} FROM s JOIN t ON t.conv_id = s.conv_id AND t.rn = s.rn + 1)
    SELECT conv_id, turn, {STAGE_LIST}[st + 1] AS stage, {STAGE_LIST}[before + 1] AS previous_stage, st <> before AS stage_changed, CAST(2 * rn AS BIGINT) AS n_messages, response, cars, {', '.join(f'v_{k} AS {FILLED[k]}' for k in _value)} FROM s WHERE rn > 0"""


def conversation_turns(t):
    """Turns for Conversation: what a turn says follows from the length of its text."""
    n = t.withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    said = lambda k: F.when(F.expr(FACTS[k]), F.concat(F.lit(k), F.col("turn").cast("string")))
    part = lambda keys: F.struct(*(said(k).alias(FILLED[k]) for k in keys))
    reply = F.when(F.col("n") % 5 != 0, F.concat(F.lit("Reply "), F.col("turn").cast("string")))
    cars = F.when(F.expr(FACTS["cars"]), F.to_json(F.array(F.concat(F.lit("car"), F.col("turn").cast("string")))))
    return n.select(F.col("conv_id").alias("session"), F.lpad(F.col("turn").cast("string"), 20, "0").alias("seq"), F.lit("message").alias("kind"), conversations.answers_json(**{k: part(v) for k, v in PARTS.items()}).alias("answers"), cars.alias("cars"), "text", reply.alias("response"))


def conversation_rows(rows):
    return rows.select(
        F.col("session").alias("conv_id"), F.col("seq").cast("bigint").alias("turn"), "stage", "previous_stage", "stage_changed", "n_messages", "response",
        F.array_join(F.from_json("cars", "array<string>"), ",").alias("cars"), *(F.coalesce(F.get_json_object("fields", f"$.{f}"), F.lit("")).alias(f) for f in FILLED.values()),
    )


@query(CONVERSATION_SQL)
def stream_conversations(spark, sf_dir):
    """Every turn of all conversations with the whole state after it: fields, cars, stage, reply and number of messages."""
    t = conversation_turns(sessions.stream_table(spark, sf_dir, "conversations"))
    return conversation_rows(sessions.run_available(conversations.conversations(t), "update"))


@query(
    """WITH f AS (SELECT user_id, event_id, ts, event_type, coalesce(sum(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn_id FROM events),
    g AS (SELECT user_id, CAST(turn_id AS BIGINT) AS turn_id, CAST(count(*) FILTER (WHERE event_type <> 'purchase') AS BIGINT) AS n_frames, string_agg(event_id || event_type, '' ORDER BY ts, event_id) FILTER (WHERE event_type <> 'purchase') AS audio, bool_or(event_type = 'purchase') AS closed FROM f GROUP BY ALL)
    SELECT user_id, turn_id, n_frames, CAST(strlen(audio) AS BIGINT) AS n_bytes, sha256(audio) AS audio_sha256 FROM g WHERE closed AND n_frames > 0"""
)
def stream_turn_audio(spark, sf_dir):
    """The bytes of every closed turn, joined from the frames that the state kept."""
    e = sessions.stream_table(spark, sf_dir, "events")
    seq = F.concat(F.date_format("ts", "yyyyMMddHHmmss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    end = F.col("event_type") == "purchase"
    frames = e.select(F.col("user_id").alias("session"), seq.alias("seq"), F.when(end, "end_turn").otherwise("bytes").alias("kind"), F.when(~end, F.concat(F.col("event_id").cast("string"), "event_type").cast("binary")).alias("frame"))
    rows = sessions.run_available(sessions.state_by_key(frames, "session", conversations.TurnAudio(), "session bigint, turn_id bigint, n_frames bigint, audio binary"), "update")
    return rows.select(F.col("session").alias("user_id"), "turn_id", "n_frames", F.octet_length("audio").cast("bigint").alias("n_bytes"), F.sha2("audio", 256).alias("audio_sha256"))


@query(
    """SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS turns, round(sum(value) OVER w, 2) AS total_ms, round(avg(value) OVER w, 9) AS avg_ms, string_agg(CASE WHEN first THEN event_type END, ',') OVER w AS languages
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS first FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
)
def stream_running_metrics(spark, sf_dir):
    """After every turn: turns, total, mean and languages of its session so far."""
    e = sessions.stream_table(spark, sf_dir, "events")
    seq = F.concat(F.date_format("ts", "yyyyMMddHHmmss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    rows = sessions.run_available(conversations.running_metrics(e.select(F.col("user_id").alias("session"), seq.alias("seq"), F.col("value").alias("latency"), F.col("event_type").alias("language"))), "update")
    return rows.where("not ended").select(F.substring("seq", 22, 20).cast("bigint").alias("event_id"), "turns", F.round("total_ms", 2).alias("total_ms"), F.round("avg_ms", 9).alias("avg_ms"), "languages")
