"""Queries of record assembly, template repair, summaries, speech data and the persisted index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from forecourt.operators import assembly, catalogue, evaluation, extraction, retrieval, sequence, speech
from forecourt.plans.retrieval_queries import COSINE, query_vector, shown, table
from forecourt.sources.record_store import shared_folder, write_snapshot

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey, coalesce(c_name, 'new') AS name, coalesce(c_mktsegment, 'welcome') AS stage, c_custkey IS NULL AS created FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2")
def session_get_or_create(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("key"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("stage"))
    return assembly.get_or_create(asked, known, "key", {"name": "new", "stage": "welcome"}).select("o_orderkey", "name", "stage", "created")


@query("SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 = 1 THEN 'age' END, 'name', CASE WHEN c_mktsegment <> 'BUILDING' THEN 'residence' END) AS shown FROM customer")
def profile_display(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    shown = assembly.display({"name": F.col("c_name"), "age": F.when(F.col("c_custkey") % 2 == 1, "30").otherwise(" "), "residence": F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))})
    return c.select("c_custkey", F.array_join(F.array_sort(F.map_keys(shown)), ",").alias("shown"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN lag(event_type) OVER w ELSE event_type END AS cars, lag(event_type) OVER w AS retrieved_with FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def stale_retrieval(spark, sf_dir):
    """Retrieval of a turn uses the needs before it; its matches replace the old ones only if there are any."""
    by = sequence.turns_of("user_id", "ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(by))
    new = F.when(F.col("event_id") % 3 != 0, F.array("event_type")).otherwise(F.array().cast("array<string>"))
    return e.select("event_id", F.get(assembly.keep_unless_new(new, F.array("before")), F.lit(0)).alias("cars"), F.col("before").alias("retrieved_with"))


TEMPLATE_SQL = "SELECT b.p_brand, s AS ord, CAST(s // 4 AS INTEGER) AS section_ord, 'label_' || CAST(s AS VARCHAR) AS label FROM (SELECT DISTINCT p_brand FROM part) b, range(8) r(s)"


def _template(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select("p_brand").distinct().select("p_brand", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("ord"))
    return brands.select("p_brand", F.col("ord").cast("bigint").alias("ord"), F.floor(F.col("ord") / 4).cast("int").alias("section_ord"), F.concat(F.lit("label_"), F.col("ord").cast("string")).alias("label"))


@query(
    f"""WITH t AS ({TEMPLATE_SQL}), c AS (SELECT p_brand, 'label_' || CAST(p_size % 8 AS VARCHAR) AS label, max(p_type) AS value FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL)
    SELECT p_brand, label, coalesce(value, '') AS value, value IS NULL AS added, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY section_ord, value IS NULL DESC, ord) AS INTEGER) AS line FROM t LEFT JOIN c USING (p_brand, label)"""
)
def template_repair(spark, sf_dir):
    from pyspark.sql import Window

    own = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").groupBy("p_brand", F.concat(F.lit("label_"), (F.col("p_size") % 8).cast("string")).alias("label")).agg(F.max("p_type").alias("value"))
    lines = assembly.with_missing_lines(_template(spark, sf_dir).withColumn("value", F.lit("")), own, ["p_brand", "label"])
    by = Window.partitionBy("p_brand").orderBy(*assembly.line_order())  # as many lines as the template has
    return lines.select("p_brand", "label", "value", "added", F.row_number().over(by).alias("line"))


@query(
    """WITH a AS (SELECT p_partkey AS ord, 'l' || CAST(p_partkey AS VARCHAR) AS label, p_type AS value FROM part)
    SELECT label, value, ord, CAST(0 AS INTEGER) AS part FROM a UNION ALL SELECT label || '_comments', 'note ' || value, ord, CAST(1 AS INTEGER) FROM a WHERE ord % 2 = 0"""
)
def comment_lines(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("l"), F.col("p_partkey").cast("string")).alias("label"), F.col("p_type").alias("value"))
    notes = a.where("ord % 2 = 0").select(F.concat("label", F.lit("_comments")).alias("label"), F.concat(F.lit("note "), F.col("value")).alias("value"))
    return assembly.comments_inserted(a, notes.unionByName(spark.createDataFrame([("unknown_comments", "x")], "label string, value string")), "label", "ord")


@query("SELECT CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS success, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS skipped FROM orders")
def batch_summary(spark, sf_dir):
    outcome = F.create_map(*map(F.lit, ("F", "success", "O", "failed", "P", "skipped")))[F.col("o_orderstatus")]
    return assembly.outcome_summary(table(spark, sf_dir, "orders").select(outcome.alias("outcome")), "outcome")


@query(
    """WITH a AS (SELECT DISTINCT p_type FROM part WHERE p_size < 5), b AS (SELECT DISTINCT p_type FROM part WHERE p_size > 45), x AS (SELECT count(*) AS k FROM a WHERE p_type NOT IN (SELECT p_type FROM b)),
    y AS (SELECT count(*) AS k FROM b WHERE p_type NOT IN (SELECT p_type FROM a)) SELECT CAST(x.k AS BIGINT) AS only_first, CAST(y.k AS BIGINT) AS only_second, x.k = 0 AND y.k = 0 AS equal FROM x, y"""
)
def set_equality(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return assembly.same_sets(p.where("p_size < 5").select("p_type"), p.where("p_size > 45").select("p_type"))


@query("SELECT 'F' AS category, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'O', o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'P', o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def scenario_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    parts = [o.where(F.col("o_orderstatus") == s).select(F.lit(s).alias("category"), "o_orderkey") for s in "FOP"]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT c_custkey, round(((c_name <> '')::INT + (c_custkey % 2 = 0)::INT + (c_mktsegment = 'BUILDING')::INT) / 3, 4) AS completeness, round(((c_custkey % 2 = 0)::INT + 1) / 3, 4) AS recall FROM customer")
def completeness(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    age = F.when(F.col("c_custkey") % 2 == 0, "30").otherwise(" ")
    found = F.create_map(F.lit("space"), age, F.lit("safety"), F.lit("High"), F.lit("other"), F.lit("x"))
    return c.select(
        "c_custkey", F.round(evaluation.complete([F.col("c_name"), age, F.when(F.col("c_mktsegment") == "BUILDING", "x")]), 4).alias("completeness"), F.round(assembly.implicit_recall(F.array(*map(F.lit, ("space", "safety", "size"))), found), 4).alias("recall")
    )


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'pong' WHEN 'error' THEN 'stop' WHEN 'click' THEN 'error' ELSE event_type END AS reply FROM events")
def control_messages(spark, sf_dir):
    t = F.col("event_type")
    text = F.when(t == "view", '{"type": "ping"}').when(t == "error", '{"type": "end_session"}').when(t == "click", "{broken").otherwise(F.concat(F.lit('{"type": "'), t, F.lit('"}')))
    return table(spark, sf_dir, "events").select("event_id", speech.control_reply(text).alias("reply"))


@query(
    "SELECT conv_id, turn, length(coalesce(text, '')) / 5 * 1000 AS duration_ms, to_base64(encode(coalesce(text, ''))) AS audio_base64, CAST(octet_length(encode(coalesce(text, ''))) AS INTEGER) AS audio_bytes FROM conversations"
)
def speech_payloads(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", speech.duration_ms(text).alias("duration_ms"), *speech.audio_payload(F.encode(text, "UTF-8")))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (trunc(x * 1000)::DOUBLE + 100) / 2 / 32768)), 6) AS level FROM embeddings")
def pcm_levels(spark, sf_dir):
    samples = F.transform("embedding", lambda x: (x * 1000).cast("int").cast("double"))
    mixed = speech.pcm_to_float(speech.downmixed(samples, F.transform(samples, lambda x: F.lit(100.0))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(mixed, F.lit(0.0), lambda a, x: a + x), 6).alias("level"))


@query("SELECT p_partkey, p_type AS powertrain, p_brand || ',' || CAST(p_size AS VARCHAR) AS models, 'x = ' || p_type AS body FROM part")
def model_answers(spark, sf_dir):
    """Powertrain of a TOML text, a bracketed list in prose, and a text without its fence."""
    p = table(spark, sf_dir, "part")
    toml = F.concat(F.lit('a = "b"\npowertrain_type = "'), F.col("p_type"), F.lit('"\nc = "d"'))
    answer = F.concat(F.lit('Here: ["'), F.col("p_brand"), F.lit('", "'), F.col("p_size").cast("string"), F.lit('"] done'))
    fenced = F.concat(F.lit("```toml\nx = "), F.col("p_type"), F.lit("\n```\n"))
    return p.select("p_partkey", F.regexp_extract(toml, r'powertrain_type\s*=\s*"([^"]+)"', 1).alias("powertrain"), F.array_join(extraction.bracketed_list(answer), ",").alias("models"), assembly.unwrapped(fenced).alias("body"))


@query("SELECT p_brand, label, CAST(min(ord) AS BIGINT) AS ord FROM (SELECT p_brand, p_partkey AS ord, 'label_' || CAST(p_size % 7 AS VARCHAR) AS label FROM part) GROUP BY ALL")
def label_first_occurrence(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.struct("p_brand", F.concat(F.lit("label_"), (F.col("p_size") % 7).cast("string")).alias("label")).alias("key"), F.col("p_partkey").alias("ord"))
    return catalogue.first_occurrences(rows, "key", "ord").select("key.p_brand", "key.label", "ord")


@query(
    """SELECT c_custkey, '{"message":"' || c_name || '","stage":"welcome","cars":["a","b"]}' AS response FROM customer"""
)
def chat_response_json(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("message"), F.lit("welcome").alias("stage"), F.slice(F.array(*map(F.lit, "ab")), 1, 5).alias("cars"))).alias("response"))


@query(f"SELECT vec_id, round(s, 4) AS score FROM (SELECT e.vec_id, {COSINE} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY s DESC, vec_id LIMIT 5)")
def persisted_index_topk(spark, sf_dir):
    """Writes the index partitioned by label, replaces it, and searches one partition of what was written."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    for _ in range(2):
        write_snapshot(table(spark, sf_dir, "embeddings"), folder, "label")
    return retrieval.top_k(spark.read.parquet(folder).where("label = 3"), query_vector(spark, sf_dir), 5).select("vec_id", shown())
