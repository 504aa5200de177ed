"""Retrieval and catalogue queries over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.functions.vocabulary import FILTER_FIELDS
from forecourt.operators import catalogue, retrieval
from forecourt.sources import vector_index
from forecourt.sources.record_store import shared_folder
from forecourt.sources.toml_source import read_catalogue, write_catalogue, write_text

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector with id 0, of which there is one."""
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


#: Ranks go by 12 digits of the score; what is shown has four.
COSINE = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12)"


def shown():
    return F.round("score", 4).alias("score")


@query(f"SELECT vec_id, round(s, 4) AS score FROM (SELECT e.vec_id, {COSINE} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY s DESC, vec_id LIMIT 5)")
def vector_topk(spark, sf_dir):
    return retrieval.top_k(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 5).select("vec_id", shown())


@query(f"SELECT vec_id, label, round(s, 4) AS score FROM (SELECT e.vec_id, e.label, {COSINE} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY s DESC, vec_id LIMIT 5)")
def vector_topk_filtered(spark, sf_dir):
    own = retrieval.metadata_filter(table(spark, sf_dir, "embeddings"), {"brand": "3", "unknown": "x", "prize": ""}, {"brand": "label"})
    return retrieval.top_k(own, query_vector(spark, sf_dir), 5).select("vec_id", "label", shown())


@query(
    f"""SELECT query_id, vec_id, round(s, 4) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {COSINE} AS s,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, e.vec_id) AS INTEGER) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND q.label = 3 AND e.label = 3) WHERE rank <= 5"""
)
def vector_topk_batch(spark, sf_dir):
    """The filtered batch search: vectors of one label, of which those with an id divisible by 20 are queries."""
    vectors = table(spark, sf_dir, "embeddings").where("label = 3")
    return retrieval.top_k_batch(vectors, vectors.where("vec_id % 20 = 0"), 5).withColumn("score", shown())


@query(
    f"""SELECT query_id, vec_id, round(s, 4) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {COSINE} AS s,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, e.vec_id) AS INTEGER) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 5"""
)
def vector_topk_every_20th(spark, sf_dir):
    """Every vector whose id is divisible by 20 is a query, at every size."""
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.top_k_batch(vectors, vectors.where("vec_id % 20 = 0"), 5).withColumn("score", shown())


@query("SELECT CASE WHEN source <> '' THEN source ELSE 'Unknown' END AS car_model, round(n_chars / 7.0, 4) AS score, left(coalesce(text, ''), 300) AS text_snippet, 'lang=' || coalesce(lang, '') AS metadata FROM documents")
def format_results(spark, sf_dir):
    own = table(spark, sf_dir, "documents").withColumn("score", F.col("n_chars") / 7.0).withColumn("m", F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("")), F.lit("source_file"), F.lit("x")))
    found = retrieval.format_results(own, "source", "text", metadata="m")
    return found.withColumn("metadata", F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


PART = {"brand": "p_brand", "powertrain_type": "p_type", "size": "p_size", "prize": "p_retailprice"}


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_type = (SELECT min(p_type) FROM part)")
def metadata_filter_and_eq(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    brand, kind = part.agg(F.min("p_brand"), F.min("p_type")).first()
    return retrieval.metadata_filter(part, {"brand": brand, "powertrain_type": kind}, PART).select("p_partkey", "p_brand", "p_type")


@query("SELECT p_partkey, p_brand FROM part")
def metadata_filter_ignored_keys(spark, sf_dir):
    return retrieval.metadata_filter(table(spark, sf_dir, "part"), {"colour": "red", "brand": "", "prize": None}, PART).select("p_partkey", "p_brand")


NEEDS_SQL = """SELECT *, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS category, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'Electric' END AS powertrain,
CASE WHEN p_size % 5 = 0 THEN 'Sporty' ELSE '' END AS style, CASE WHEN p_size % 6 = 0 THEN '' ELSE p_brand END AS brand, CASE WHEN p_size % 7 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS price FROM part"""


def _needs(spark, sf_dir):
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    blank = lambda n, other, empty="": F.when(size % n == 0, F.lit(empty)).otherwise(other)
    return p.select("p_partkey", blank(3, F.col("p_type")).alias("category"), blank(4, F.lit("Electric"), None).alias("powertrain"), F.when(size % 5 == 0, "Sporty").otherwise("").alias("style"), blank(6, F.col("p_brand")).alias("brand"), blank(7, size.cast("string")).alias("price"))


def _parts_sql(*parts: str) -> str:
    text = "concat_ws(' ', nullif(category, ''), nullif(powertrain, ''), nullif(style, ''), nullif(brand, '') || ' brand', " + ", ".join(parts) + ")"
    return f"SELECT p_partkey, coalesce(nullif({text}, ''), 'recommend a good vehicle') AS query FROM ({NEEDS_SQL})"


@query(_parts_sql("'price range ' || nullif(price, '')", "nullif(style, '')"))
def retrieval_query_text(spark, sf_dir):
    return _needs(spark, sf_dir).select("p_partkey", retrieval.query_text(*map(F.col, ("category", "powertrain", "style", "brand", "price", "style"))).alias("query"))


@query(_parts_sql("nullif(price, '') || ' comfort'", "nullif(style, '') || ' family friendliness'"))
def retrieval_query_text_legacy(spark, sf_dir):
    return _needs(spark, sf_dir).select("p_partkey", retrieval.query_text_legacy(*map(F.col, ("category", "powertrain", "style", "brand", "price", "style"))).alias("query"))


def _entries():
    e = lambda section, i, key, value: F.struct(F.lit(section).alias("section"), F.lit(i).alias("ord"), F.lit(key).alias("key"), value.cast("string").alias("value"))
    odd = F.col("p_size") % 2 == 1
    return F.array(
        e("PriciseLabels", 0, "brand", F.col("p_brand")),
        e("PriciseLabels", 1, "brand_comments", F.concat(F.lit("made by "), F.col("p_brand"))),
        e("PriciseLabels", 2, "drive_type_comments", F.when(odd, F.lit("")).otherwise(F.col("p_type"))),
        e("PriciseLabels", 3, "size", F.col("p_size")),
        e("AmbiguousLabels", 0, "size", F.when(odd, F.lit("Large")).otherwise(F.lit(""))),
        e("AmbiguousLabels", 1, "comfort_level_comments", F.lit("soft")),
        e("AmbiguousLabels", 2, "colour", F.lit("red")),
    )


@query(
    """SELECT p_partkey, 'Vehicle: ' || coalesce(nullif(p_name, ''), 'Unknown Vehicle') || chr(10) || 'Overview: ' || p_type || chr(10) || 'Brand: made by ' || p_brand
    || CASE WHEN p_size % 2 = 1 THEN '' ELSE chr(10) || 'Drive Type: ' || p_type END || chr(10) || 'Comfort Level: soft' AS text FROM part"""
)
def doc_text_build(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", catalogue.document_text(F.col("p_name"), F.col("p_type"), F.lit(None).cast("string"), _entries()).alias("text"))


@query("SELECT p_partkey, p_name AS car_model, p_brand AS brand, CASE WHEN p_size % 2 = 1 THEN 'Large' ELSE CAST(p_size AS VARCHAR) END AS size, CAST(3 AS INTEGER) AS n_fields FROM part")
def metadata_last_wins(spark, sf_dir):
    m = table(spark, sf_dir, "part").select("p_partkey", catalogue.visible(catalogue.metadata(F.col("p_name"), _entries())).alias("m"))
    return m.select("p_partkey", F.col("m")["car_model"].alias("car_model"), F.col("m")["brand"].alias("brand"), F.col("m")["size"].alias("size"), F.size("m").alias("n_fields"))


@query("SELECT source, CAST(count(*) AS BIGINT) AS n_documents FROM documents GROUP BY source")
def index_document_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_documents"))


@query(
    """SELECT p_brand, lo, hi, CAST(count(*) AS BIGINT) AS n FROM (SELECT p_brand, CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN p_size * 1000 ELSE p_size * 1000 END::DOUBLE AS lo,
    CASE p_size % 3 WHEN 0 THEN p_size * 1000 WHEN 1 THEN p_size * 1000 + 5000 ELSE 'Infinity'::DOUBLE END::DOUBLE AS hi FROM part) WHERE lo <= 30000 AND hi >= 20000 AND hi < 1e12 GROUP BY ALL"""
)
def price_bucket_overlap(spark, sf_dir):
    size = F.col("p_size") * 1000
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Below "), F.format_number(size, 0))).when(F.col("p_size") % 3 == 1, F.concat(F.format_number(size, 0), F.lit("~"), F.format_number(size + 5000, 0))).otherwise(F.concat(F.lit("Above "), F.format_number(size, 0)))
    r = table(spark, sf_dir, "part").select("p_brand", catalogue.price_range(text).alias("r")).where(catalogue.overlaps(F.col("r"), F.lit(20000.0), F.lit(30000.0)))
    return r.where(F.col("r.hi") < 1e12).groupBy("p_brand", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi")).agg(F.count("*").alias("n"))


@query(
    """SELECT p_partkey, label, CASE WHEN (p_type LIKE 'S%' AND label = 'battery_capacity') OR (p_type NOT LIKE 'S%' AND label = 'fuel_consumption') THEN 'None' ELSE CAST(p_size AS VARCHAR) END AS value
    FROM part, (VALUES ('battery_capacity'), ('fuel_consumption'), ('fuel_consumption_comments')) v(label)"""
)
def inapplicable_to_none(spark, sf_dir):
    kind = F.when(F.col("p_type").startswith("S"), "Diesel Engine").otherwise("Battery Electric Vehicle")
    rows = table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), F.col("p_size").cast("string").alias("value"), F.explode(F.array(*map(F.lit, ("battery_capacity", "fuel_consumption", "fuel_consumption_comments")))).alias("label"))
    return rows.select("p_partkey", "label", catalogue.inapplicable_to_none(F.col("label"), F.col("value"), F.col("kind")).alias("value"))


LABELS_SQL = "SELECT p_brand, 'label_' || CAST(p_size % 97 AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN '_comments' ELSE '' END AS label FROM part"


def _labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_brand", F.concat(F.lit("label_"), (F.col("p_size") % 97).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "_comments").otherwise("")).alias("label")).distinct()


@query(f"SELECT DISTINCT a.p_brand, 'label_' || CAST(s AS VARCHAR) AS label FROM part a, range(60) r(s) WHERE NOT EXISTS (SELECT 1 FROM ({LABELS_SQL}) l WHERE l.p_brand = a.p_brand AND l.label = 'label_' || CAST(s AS VARCHAR))")
def missing_labels(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    template = brands.select("p_brand", F.explode(F.array(*(F.lit(f"label_{i}") for i in range(60)))).alias("label"))
    return catalogue.missing_labels(template, _labels(spark, sf_dir), ["p_brand", "label"])


@query(f"WITH l AS (SELECT DISTINCT * FROM ({LABELS_SQL})) SELECT p_brand, label FROM l WHERE label NOT LIKE '%_comments' AND NOT EXISTS (SELECT 1 FROM l x WHERE x.p_brand = l.p_brand AND x.label = l.label || '_comments')")
def labels_without_comments(spark, sf_dir):
    return catalogue.labels_without_comments(_labels(spark, sf_dir), ["p_brand"]).select("p_brand", "label")


@query("SELECT DISTINCT p_type, p_brand FROM part p WHERE p_size <= 10 AND NOT EXISTS (SELECT 1 FROM part x WHERE x.p_size > 40 AND x.p_type = p.p_type AND x.p_brand = p.p_brand)")
def anti_new_models(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return catalogue.missing_labels(p.where("p_size <= 10").select("p_type", "p_brand").distinct(), p.where("p_size > 40"), ["p_type", "p_brand"])


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS text_sha256 FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedupe_first_occurrence(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    return catalogue.first_occurrences(rows, "text_sha256", "doc_id")


def part_catalogue(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a catalogue file for each part, written from the tasks, beside a template and a broken file."""
    folder = f"{shared_folder(spark)}/catalogue-{uuid.uuid4().hex}"
    part = table(spark, sf_dir, "part")
    car = F.struct(
        F.lit("Car").alias("title"),
        F.concat_ws("-", "p_brand", "p_partkey").alias("car_model"),
        F.struct(F.col("p_brand").alias("brand"), F.concat(F.lit("A "), "p_type", F.lit(" car")).alias("brand_comments")).alias("PriciseLabels"),
        F.struct(F.col("p_size").cast("string").alias("size")).alias("AmbiguousLabels"),
        F.struct(F.col("p_name").alias("key_details")).alias("KeyDetails"),
    )
    write_catalogue(part.select(F.col("p_partkey").cast("string").alias("name"), car.alias("car")), f"{folder}/nested")
    write_text(spark, f"{folder}/CarLabels.toml", 'title = "CarLabels"\ncar_model = "x"\n')
    write_text(spark, f"{folder}/broken.toml", "= nothing")
    return folder


def car_documents(rows: DataFrame) -> DataFrame:
    meta = catalogue.metadata(F.col("car_model"), F.col("entries"))
    return rows.select("car_model", catalogue.document_text(F.col("car_model"), F.col("key_details"), F.col("key_details_comments"), F.col("entries")).alias("text"), F.size(meta).alias("n_fields"), F.lit(len(FILTER_FIELDS)).alias("n_filters"))


TOML_SQL = """SELECT p_brand || '-' || p_partkey AS car_model, 'Vehicle: ' || p_brand || '-' || p_partkey || chr(10) || 'Overview: ' || p_name || chr(10) || 'Brand: A ' || p_type || ' car' AS text, CAST(3 AS INTEGER) AS n_fields,
    CAST(13 AS INTEGER) AS n_filters FROM part"""


@query(TOML_SQL)
def toml_ingest(spark, sf_dir):
    """Writes a catalogue file for each part to the shared folder, from the tasks, and reads all back as documents."""
    return car_documents(read_catalogue(spark, part_catalogue(spark, sf_dir)))


@query()
def index_probe_topk(spark, sf_dir):
    """Every row whose id is divisible by 20 against the inverted lists of all vectors that are nearest to it."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    vector_index.build_index(vectors, folder)
    found = vector_index.search_index(vectors.where("vec_id % 20 = 0"), folder, 5)
    return found.select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")
