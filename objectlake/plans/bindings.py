"""Object types over the star-schema tables, and inputs derived from them by fixed rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Field, LinkType, ObjectType, Ontology, Security, User


def _f(name: str, data_type: str = "string", links_to: str | None = None, searchable: bool = False) -> Field:
    return Field(name, data_type=data_type, links_to=links_to, searchable=searchable)


TYPES = (
    ObjectType("Region", "region", "r_regionkey", (_f("r_regionkey", "integer"), _f("r_name", searchable=True)), Security(field="r_name"), "r_name"),
    ObjectType("Nation", "nation", "n_nationkey", (_f("n_nationkey", "integer"), _f("n_name", searchable=True), _f("n_regionkey", "integer", "Region")), Security(via="n_regionkey"), "n_name"),
    ObjectType("Customer", "customer", "c_custkey", (
        _f("c_custkey", "integer"), _f("c_name", searchable=True), _f("c_nationkey", "integer", "Nation"), _f("c_acctbal", "number"), _f("c_mktsegment", searchable=True),
    ), Security(via="c_nationkey"), "c_name"),
    ObjectType("Supplier", "supplier", "s_suppkey", (_f("s_suppkey", "integer"), _f("s_name", searchable=True), _f("s_nationkey", "integer", "Nation"), _f("s_acctbal", "number")), Security(via="s_nationkey"), "s_name"),
    ObjectType("Part", "part", "p_partkey", (
        _f("p_partkey", "integer"), _f("p_name", searchable=True), _f("p_brand", searchable=True), _f("p_type", searchable=True), _f("p_size", "integer"), _f("p_retailprice", "number"),
    ), None, "p_name"),
    ObjectType("Order", "orders", "o_orderkey", (
        _f("o_orderkey", "integer"), _f("o_custkey", "integer", "Customer"), _f("o_orderstatus"), _f("o_totalprice", "number"), _f("o_orderdate", "timestamp"), _f("o_orderpriority", searchable=True),
    ), Security(via="o_custkey")),
    ObjectType("LineItem", "lineitem", "l_orderkey", (
        _f("l_orderkey", "integer", "Order"), _f("l_partkey", "integer", "Part"), _f("l_suppkey", "integer", "Supplier"), _f("l_linenumber", "integer"), _f("l_quantity", "number"),
        _f("l_extendedprice", "number"), _f("l_discount", "number"), _f("l_returnflag"), _f("l_shipdate", "timestamp"),
    ), Security(via="l_orderkey")),
    ObjectType("Document", "documents", "doc_id", (_f("doc_id", "integer"), _f("text", searchable=True), _f("lang"), _f("source", searchable=True), _f("n_chars", "integer")), Security(field="lang")),
)

LINKS = (
    LinkType("nation", "Customer", "Nation", field="c_nationkey", reverse="customers"),
    LinkType("region", "Nation", "Region", field="n_regionkey", reverse="nations"),
    LinkType("customer", "Order", "Customer", field="o_custkey", reverse="orders"),
    LinkType("parts", "Supplier", "Part", via_table="LineItem", via_source="l_suppkey", via_target="l_partkey", reverse="suppliers"),
)

ONTOLOGY = Ontology({t.name: t for t in TYPES}, {f"{x.source}.{x.name}": x for x in LINKS}).expand()
ALL = frozenset({"read:*"})
ASIA = User("user_asia", "ASIA", ALL)
ENGLISH = User("user_en", "en", ALL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def loader(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    """Reads a type's objects."""
    return lambda type_name: ONTOLOGY.types[type_name].conform(table(spark, sf_dir, ONTOLOGY.types[type_name].table))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user for each region, and one without clearance."""
    named = table(spark, sf_dir, "region").select(F.concat(F.lit("user_"), "r_regionkey").alias("user_id"), F.col("r_name").alias("security_value"))
    return named.unionByName(spark.range(1).select(F.lit("user_none").alias("user_id"), F.lit(None).cast("string").alias("security_value")))


def orders_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


def orders_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1 without every 17th order, every 13th with status X, and a new order for every 101st."""
    v1 = orders_v1(spark, sf_dir)
    kept = v1.filter("o_orderkey % 17 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")))
    return kept.unionByName(v1.filter("o_orderkey % 101 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000))


def dirty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and a text with blank edges, decomposed letters and sentinels put in by rule."""
    text = F.col("text")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  "), text, F.lit("\t"))).otherwise(text)
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(text, F.lit("é"))).otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "N/A").otherwise(text).alias("text"))


DIRTY_SQL = """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'N/A' ELSE
  (CASE WHEN doc_id % 3 = 0 THEN '  ' || text || chr(9) ELSE text END) || (CASE WHEN doc_id % 5 = 0 THEN 'e' || chr(769) ELSE '' END) END AS text FROM documents"""


def customer_sources(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str]]:
    """erp: all customers; crm: two in three, keyed crm-N, some balances and nations changed."""
    c = table(spark, sf_dir, "customer")
    columns = ["c_name", "c_nationkey", "c_acctbal"]
    crm = c.filter("c_custkey % 3 <> 0").select(
        F.concat(F.lit("crm-"), "c_custkey").alias("id"), "c_name",
        F.when(F.col("c_custkey") % 50 == 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey")).cast("int").alias("c_nationkey"),
        F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
    )
    return {"erp": (c.select(F.col("c_custkey").cast("string").alias("id"), *columns), "id"), "crm": (crm, "id")}


SOURCES_SQL = """erp AS (SELECT 'erp' AS source, 0 AS rank, CAST(c_custkey AS VARCHAR) AS source_id, c_name, c_nationkey, c_acctbal FROM customer),
crm AS (SELECT 'crm' AS source, 1 AS rank, 'crm-' || c_custkey AS source_id, c_name,
  CASE WHEN c_custkey % 50 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS c_nationkey,
  CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 3 <> 0),
both_sources AS (SELECT * FROM erp UNION ALL SELECT * FROM crm)"""


def write_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a write log on customers: an entry names the event's user as its object."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    field = F.when(k % 3 == 0, "c_acctbal").when(k % 3 == 1, "c_mktsegment").otherwise("c_phone")
    return e.select(
        k.alias("id"), F.lit("Customer").alias("object_type"), F.col("user_id").cast("string").alias("object_id"),
        F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("update").alias("operation"),
        F.when(k % 50 == 2, F.lit("{}")).otherwise(F.concat(F.lit('{"'), field, F.lit('":"'), F.col("value").cast("string"), F.lit('"}'))).alias("changes"),
        F.when(k % 10 == 0, "pending").when(k % 10 == 1, "abandoned").otherwise("applied").alias("status"),
        F.concat(F.lit("user_"), k % 5).alias("user_id"), F.col("ts").cast("timestamp").alias("created_at"), F.lit(None).cast("string").alias("batch_id"),
    )


LOG_SQL = """log AS (SELECT event_id AS id, 'Customer' AS object_type, CAST(user_id AS VARCHAR) AS object_id,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS operation,
  CASE WHEN event_id % 50 = 2 THEN NULL WHEN event_id % 3 = 0 THEN 'c_acctbal' WHEN event_id % 3 = 1 THEN 'c_mktsegment' ELSE 'c_phone' END AS field,
  CAST(value AS VARCHAR) AS field_value,
  CASE WHEN event_id % 10 = 0 THEN 'pending' WHEN event_id % 10 = 1 THEN 'abandoned' ELSE 'applied' END AS status,
  'user_' || (event_id % 5) AS writer, ts AS created_at FROM events)"""


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as requests: route, at, duration_ms, status 500 for every 20th."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("route"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("duration_ms"),
        F.when(F.col("event_id") % 20 == 0, 500).otherwise(200).alias("status"), F.col("user_id"),
    )


REQUESTS_SQL = """requests AS (SELECT event_id AS request_id, event_type AS route, ts AS at_, value AS duration_ms,
  CASE WHEN event_id % 20 = 0 THEN 500 ELSE 200 END AS status, user_id FROM events)"""
