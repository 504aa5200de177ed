"""Evaluation queries: extraction quality, stages, latencies, categories, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.functions.vocabulary import INVITING, POLITE, SLANG, STAGE_WORDS, STAGES
from forecourt.operators import evaluation, funnel
from forecourt.plans.dialogue_queries import EVENT_STAGE_SQL, STAGE_LIST, event_stage
from forecourt.plans.retrieval_queries import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(
    """SELECT event_type, CAST(len(a) AS BIGINT) AS samples, round(list_avg(a), 2) AS avg_ms, round(list_median(a), 2) AS p50_ms, round(a[least(floor(len(a) * 0.95::DOUBLE)::INT, len(a) - 1) + 1], 2) AS p95_ms,
    round(a[least(floor(len(a) * 0.99::DOUBLE)::INT, len(a) - 1) + 1], 2) AS p99_ms, round(a[least(floor(len(a) * 0.5::DOUBLE)::INT, len(a) - 1) + 1], 2) AS upper_median_ms, round(list_max(a), 2) AS max_ms
    FROM (SELECT event_type, list(value ORDER BY value) AS a FROM events GROUP BY event_type)"""
)
def latency_stats(spark, sf_dir):
    return evaluation.latency_report(table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT o_orderstatus AS category, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 1) AS avg_price, round(avg(CASE WHEN o_totalprice > 50000 THEN 100.0 ELSE 0.0 END), 1) AS avg_high, round(avg(o_custkey), 1) AS avg_key FROM orders GROUP BY 1")
def category_summary(spark, sf_dir):
    one = lambda c: F.round(F.avg(c), 1)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("category")).agg(F.count("*").alias("n"), one("o_totalprice").alias("avg_price"), one(F.when(F.col("o_totalprice") > 50000, 100.0).otherwise(0.0)).alias("avg_high"), one("o_custkey").alias("avg_key"))


INDEX_SQL = f"list_position({STAGE_LIST}, {EVENT_STAGE_SQL}) - 1"


@query(f"SELECT user_id, CAST(coalesce(max({INDEX_SQL}), 0) AS INTEGER) AS furthest, round((coalesce(max({INDEX_SQL}), 0) + 1) / 7 * 100, 4) AS score FROM events GROUP BY user_id")
def funnel_score(spark, sf_dir):
    far = table(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(F.max(funnel.stage_index(event_stage())), F.lit(0)).alias("furthest"))
    return far.select("user_id", "furthest", F.round(evaluation.funnel_score(F.col("furthest")), 4).alias("score"))


TASK_SQL = f"""WITH v AS (SELECT user_id, max({INDEX_SQL}) AS far, list(DISTINCT {EVENT_STAGE_SQL}) AS visited FROM events GROUP BY user_id),
c AS (SELECT c_custkey, {STAGE_LIST}[c_custkey % 7 + 1] AS expected, c_custkey % 7 AS target, c_custkey AS k FROM customer),
s AS (SELECT c_custkey, expected, k, coalesce(far, -1) AS far,
  CASE WHEN coalesce(list_contains(visited, expected), false) THEN 30.0 WHEN target > 0 THEN 30.0 * coalesce(far, -1) / target ELSE 0.0 END
  + 25.0 * ((k % 2 = 0)::INT + (k % 3 = 0)::INT + 1 + 1 + 0) / 5 + 25.0 * ((k % 4 = 0)::INT + 1 + 0 + 0 + 0) / 5
  + CASE WHEN expected IN ('reservation4s', 'reservation_confirmation', 'farewell') THEN 20.0 * ((k % 5 = 0)::INT + 1 + 1 + 0) / 4 ELSE 20.0 END AS task
FROM c LEFT JOIN v ON user_id = c_custkey)"""


def _tasks(spark, sf_dir):
    stage, key = event_stage(), F.col("c_custkey")
    v = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max(funnel.stage_index(stage)).alias("far"), F.collect_set(stage).alias("visited"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.get(F.array(*map(F.lit, STAGES)), (key % 7).cast("int")).alias("expected")).join(v, "c_custkey", "left")
    has = lambda n: F.when(key % n == 0, "x").otherwise("")
    x, none = F.lit("x"), F.lit("")
    visited = F.coalesce(F.array_contains("visited", F.col("expected")), F.lit(False))
    task = evaluation.task_completion(F.col("expected"), visited, F.col("far"), [has(2), has(3), x, x, none], [has(4), x, none, none, none], [has(5), x, x, none])
    return c.select("c_custkey", "expected", task.alias("task"), F.coalesce("far", F.lit(-1)).alias("far"))


@query(f"{TASK_SQL} SELECT c_custkey, expected, round(least(task, 100.0), 4) AS task FROM s")
def task_completion(spark, sf_dir):
    return _tasks(spark, sf_dir).select("c_custkey", "expected", F.round("task", 4).alias("task"))


@query(
    f"""{TASK_SQL} SELECT c_custkey, round(0.35 * (0.5 * least(task, 100.0) + 0.5 * (greatest(far, 0) + 1) / 7.0 * 100) + 0.30 * 60.0 + 0.20 * (CASE WHEN k % 2 = 0 THEN 80.0 ELSE 100.0 END + 100.0) / 2 + 0.10 * 50.0
    + 0.05 * CASE WHEN k % 60 < 50 THEN 100 - (k % 60) / 50.0 * 100 ELSE 0 END, 4) AS overall FROM s"""
)
def overall_score(spark, sf_dir):
    k = F.col("c_custkey")
    score = evaluation.overall(F.col("task"), evaluation.funnel_score(F.greatest("far", F.lit(0))), F.lit(60.0), F.when(k % 2 == 0, 0.8), F.lit(None).cast("double"), F.lit(0.5), (k % 60).cast("double"))
    return _tasks(spark, sf_dir).select("c_custkey", F.round(score, 4).alias("overall"))


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


STAGE_CASE = " ".join(f"WHEN '{s}' THEN {_any('lower(text)', ws)}" for s, ws in STAGE_WORDS.items())
BARE = r"regexp_replace(text, '^[\s]+|[\s]+$', '', 'g')"


@query(
    f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, {STAGE_LIST}[turn % 7 + 1] AS stage, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS message FROM conversations),
    w AS (SELECT *, list_filter(string_split_regex({BARE.replace('text', 'message', 1)}, '\\s+'), lambda x: length(x) > 1) AS words FROM t)
    SELECT conv_id, turn, round(least(100.0, CASE WHEN CASE stage {STAGE_CASE} END THEN 40.0 ELSE 0.0 END
    + CASE WHEN len(words) > 0 THEN least(30.0, len(list_filter(words, lambda x: contains(lower(text), lower(x)))) / len(words) * 30.0) ELSE 0.0 END
    + CASE WHEN length({BARE}) > 20 THEN 15.0 ELSE 0.0 END + CASE WHEN regexp_matches({BARE}, '(\\?|？|吗|呢|吧)$') THEN 15.0 WHEN {_any('lower(text)', INVITING)} THEN 10.0 ELSE 0.0 END), 4) AS relevance FROM w"""
)
def relevance_score(spark, sf_dir):
    from forecourt.operators.sequence import turns_of

    stages = F.array(*map(F.lit, STAGES))
    t = table(spark, sf_dir, "conversations").withColumn("message", F.coalesce(F.lag("text").over(turns_of("conv_id", "turn")), F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    score = evaluation.relevance(F.col("text"), F.get(stages, (F.col("turn") % 7).cast("int")), evaluation.context_words(F.col("message")))
    return t.select("conv_id", "turn", F.round(score, 4).alias("relevance"))


@query(
    f"""SELECT conv_id, turn, CASE WHEN {_any('lower(text)', SLANG)} THEN 0.0 ELSE 40.0 END + CASE WHEN {_any('lower(text)', POLITE)} THEN 30.0 ELSE 0.0 END
    + CASE WHEN n >= 2 THEN 30.0 WHEN n = 1 THEN 15.0 ELSE 0.0 END AS professionalism FROM (SELECT conv_id, turn, coalesce(text, '') AS text,
    len(list_filter(string_split_regex(coalesce(text, ''), '[。！？.!?\\n]'), lambda s: length(regexp_replace(s, '^[\\s]+|[\\s]+$', '', 'g')) > 5)) AS n FROM conversations)"""
)
def professionalism_score(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", evaluation.professionalism(F.coalesce("text", F.lit(""))).alias("professionalism"))


@query(
    """SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN 0.0 WHEN regexp_matches(text, '[一-鿿]') = (conv_id % 3 = 0) THEN 100.0 ELSE 0.0 END AS consistency FROM conversations"""
)
def language_consistency(spark, sf_dir):
    asked = F.when(F.col("conv_id") % 3 == 0, "你好").otherwise("hello")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", evaluation.language_consistency(asked, F.coalesce("text", F.lit(""))).alias("consistency"))


VOICE_TEXT = "CASE WHEN doc_id % 3 = 0 THEN '汽车试驾' || left(text, 6) WHEN doc_id % 3 = 1 THEN '123 !' ELSE text END"


@query(
    f"""SELECT doc_id, CASE WHEN l = 0 OR c / l > 0.3 THEN 'zh' ELSE 'en' END AS voice FROM (SELECT doc_id, length(regexp_replace({VOICE_TEXT}, '[^\\p{{L}}]', '', 'g')) AS l,
    length(regexp_replace({VOICE_TEXT}, '[^一-鿿]', '', 'g')) AS c FROM documents)"""
)
def voice_language_detect(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("汽车试驾"), F.left("text", F.lit(6)))).when(F.col("doc_id") % 3 == 1, "123 !").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", evaluation.voice_language(text).alias("voice"))


@query("SELECT o_orderstatus, CASE WHEN NOT bool_and(o_totalprice > 0) THEN 'unhealthy' WHEN NOT bool_and(o_totalprice < 400000) THEN 'degraded' ELSE 'ok' END AS health FROM orders GROUP BY 1")
def health_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(evaluation.health(F.bool_and(F.col("o_totalprice") > 0), F.bool_and(F.col("o_totalprice") < 400000)).alias("health"))
