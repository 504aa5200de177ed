"""Queries over keyed records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from forecourt.functions.vocabulary import PROFILE_FIELDS
from forecourt.operators import extraction, records
from forecourt.plans.retrieval_queries import table
from forecourt.sources import versioned_store
from forecourt.sources.record_store import shared_folder

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _dealer(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("brand"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("model"))
    return o.join(c, "o_custkey")


DEALER = "(SELECT o_orderkey, o_custkey, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS model, c_name AS name, c_mktsegment AS brand FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"SELECT o_orderkey, name, brand, status FROM {DEALER} WHERE lower(brand) = 'building' AND status = 'F' AND (contains(lower(name), '7') OR contains(lower(brand), '7') OR contains(lower(model), '7'))")
def dealer_filter(spark, sf_dir):
    return records.dealer_filter(_dealer(spark, sf_dir), brand="Building", status="F", search="7").select("o_orderkey", "name", "brand", "status")


@query(f"SELECT o_orderkey, date, status FROM {DEALER} WHERE status = 'O' AND date >= '1995-01-01' AND date <= '1997-12-31' ORDER BY date, o_orderkey LIMIT 40 OFFSET 10")
def reservation_list(spark, sf_dir):
    return records.reservations(_dealer(spark, sf_dir), ["date", "o_orderkey"], status="O", start="1995-01-01", end="1997-12-31", limit=40, offset=10).select("o_orderkey", "date", "status")


@query(
    """SELECT coalesce(c.c_custkey, n.k) AS c_custkey, CASE WHEN n.name <> '' THEN n.name ELSE c.c_name END AS c_name, CASE WHEN n.seg <> '' THEN n.seg ELSE c.c_mktsegment END AS c_mktsegment
    FROM customer c FULL JOIN (SELECT o_custkey + 5 AS k, CASE WHEN max(o_orderkey) % 2 = 0 THEN '' ELSE 'new ' || CAST(max(o_orderkey) AS VARCHAR) END AS name, max(o_orderpriority) AS seg FROM orders GROUP BY o_custkey) n ON c.c_custkey = n.k"""
)
def record_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") + 5).alias("c_custkey")).agg(F.max("o_orderkey").alias("k"), F.max("o_orderpriority").alias("c_mktsegment"))
    changes = o.select("c_custkey", F.when(F.col("k") % 2 == 0, "").otherwise(F.concat(F.lit("new "), F.col("k").cast("string"))).alias("c_name"), "c_mktsegment")
    return records.upsert(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), changes, "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def record_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return records.delete(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), gone, "c_custkey")


@query(
    """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 400 WHEN o_orderkey % 3 = 0 AND c_custkey IS NOT NULL THEN 409 WHEN o_orderkey % 3 <> 0 AND c_custkey IS NULL THEN 404 ELSE 200 END AS INTEGER) AS status
    FROM orders LEFT JOIN customer ON c_custkey = CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey * 2 END"""
)
def request_status(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey") * 2).alias("c_custkey"), F.when(F.col("o_orderkey") % 3 == 0, "create").otherwise("update").alias("method"))
    return records.request_status(requests, table(spark, sf_dir, "customer"), "c_custkey", "method").select("o_orderkey", "status")


@query(
    """SELECT c_custkey, coalesce(nullif(concat_ws(', ', CASE WHEN c_custkey % 2 = 0 THEN 'phone_number' END, CASE WHEN c_custkey % 3 = 0 THEN 'age' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'residence' END), ''), 'None (profile complete)') AS missing FROM customer"""
)
def missing_fields(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    own = {"phone_number": F.when(F.col("c_custkey") % 2 == 0, "").otherwise("1"), "age": F.when(F.col("c_custkey") % 3 != 0, " "), "residence": F.when(F.col("c_mktsegment") != "BUILDING", "here")}
    rows = c.select("c_custkey", *(own.get(f, F.lit("x")).alias(f) for f in PROFILE_FIELDS))
    return rows.select("c_custkey", extraction.missing_fields(PROFILE_FIELDS, "None (profile complete)").alias("missing"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 6 > 3 THEN 'High' END AS family_friendliness, CASE WHEN c_custkey % 6 > 3 THEN 'Large' END AS space, CASE WHEN c_acctbal < 0 THEN 'High' END AS cost_performance,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Low' END AS energy_consumption_level, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'High' END AS driving_range, CASE WHEN c_nationkey < 5 THEN 'High' END AS safety,
    CASE WHEN c_nationkey < 5 THEN 'High' END AS smartness FROM customer"""
)
def implicit_rules(spark, sf_dir):
    needs = extraction.implicit_needs((F.col("c_custkey") % 6).cast("string"), F.when(F.col("c_acctbal") < 0, "High").otherwise("Low"), F.when(F.col("c_mktsegment") == "MACHINERY", "Battery Electric Vehicle").otherwise("Gasoline Engine"), F.when(F.col("c_nationkey") < 5, "Beginner").otherwise("expert"))
    return table(spark, sf_dir, "customer").select("c_custkey", *(v.alias(k) for k, v in needs.items()))


@query(
    """SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'name' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'brand' END, CASE WHEN c_custkey % 5 = 0 THEN 'phone' WHEN c_custkey % 5 = 1 THEN 'phone_digits' END) AS errors FROM customer"""
)
def form_errors(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "  ").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise("b").alias("brand"), F.when(F.col("c_custkey") % 5 == 0, "").when(F.col("c_custkey") % 5 == 1, "12a").otherwise(" 123 ").alias("phone"))
    return c.select("c_custkey", F.array_join(records.form_errors({"name": "name", "brand": "brand", "phone": "phone"}, "phone"), ",").alias("errors"))


@query("SELECT p_partkey, p_brand AS brand, CAST(p_partkey AS VARCHAR) || '-x' AS model FROM part WHERE p_partkey % 4 <> 0")
def model_name_split(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 4 == 0, F.lit("nohyphen")).otherwise(F.concat(F.translate("p_brand", "-", "_"), F.lit("-"), F.col("p_partkey").cast("string"), F.lit("-x")))
    return table(spark, sf_dir, "part").select("p_partkey", records.split_model(name).alias("m")).where("m is not null").select("p_partkey", "m.brand", "m.model")


@query(
    """SELECT c_custkey AS key, CASE WHEN o_custkey IS NULL THEN c_name ELSE 'ordered ' || n END AS name, c_mktsegment AS segment
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey WHERE c_custkey % 50 = 0"""
)
def store_lookup(spark, sf_dir):
    """A store of all customers, a second version of it with changes from their orders, and point reads of every 50th key."""
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    versioned_store.commit(customers, folder, 0, buckets=64)
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.concat(F.lit("ordered "), F.count("*").cast("string")).alias("name"))
    known = counts.join(customers.select("key"), "key", "left_semi")
    versioned_store.change(spark, folder, lambda rows: records.upsert(rows, known, "key"))
    return versioned_store.lookup(customers.where("key % 50 = 0").select("key"), folder)
