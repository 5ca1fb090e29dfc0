"""Queries over object sets: filters, security, links, aggregates, order and pages."""

from __future__ import annotations

from functools import reduce

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import User
from ..operators import objects, secure
from ..operators.filters import Condition
from .bindings import ALL, ASIA, ENGLISH, ONTOLOGY, loader, orders_v1, table, users
from .registry import Registry

R = Registry()
NOW = datetime(2001, 6, 1, tzinfo=UTC)
OPEN = User("admin", None, ALL)


def _set(spark, sf_dir, name: str, user: User = ASIA) -> objects.ObjectSet:
    return objects.ObjectSet.of(ONTOLOGY, name, loader(spark, sf_dir), user)


def _all(spark, sf_dir, name: str) -> objects.ObjectSet:
    load = loader(spark, sf_dir)
    return objects.ObjectSet(ONTOLOGY, name, load, OPEN, load(name))


#: Boundary of each customer, order and line item, for the SQL side.
CHAIN = "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
ASIA_ORDERS = f"orders JOIN customer ON o_custkey = c_custkey {CHAIN} WHERE r_name = 'ASIA'"
MONEY = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def money(name: str):
    return F.sum(F.col(name).cast("decimal(18,2)")).cast("double")


def _ids(name: str, sql: str, type_name: str, *conditions: Condition) -> None:
    key = ONTOLOGY.types[type_name].id_field
    R.add(name, sql)(lambda spark, sf_dir: _all(spark, sf_dir, type_name).where(*conditions, now=NOW).rows.select(key))


_ids("filter_equals", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", "Order", Condition("o_orderstatus", "equals", "F"))
_ids("filter_in", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')", "Order", Condition("o_orderstatus", "in", ["F", "P"]))
_ids("filter_not_in", "SELECT p_partkey FROM part WHERE p_type IS NULL OR p_type NOT IN ('ECONOMY', 'PROMO')", "Part", Condition("p_type", "not_in", ["ECONOMY", "PROMO"]))
_ids("filter_range", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 2500.5", "Customer", Condition("c_acctbal", "range", {"min": 0, "max": 2500.5}))
_ids("filter_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN '1997-03-01' AND '1997-09-30'", "Order", Condition("o_orderdate", "date_range", {"start": "1997-03-01", "end": "1997-09-30"}))
_ids("filter_relative_date", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '2001-03-03' AND o_orderdate <= '2001-05-02'", "Order", Condition("o_orderdate", "relative_date", {"since_days": 90, "until_days": 30}))
_ids("filter_contains", "SELECT p_partkey FROM part WHERE contains(p_name, 'ring')", "Part", Condition("p_name", "contains", "ring"))


@R.add("decimal_filter", "SELECT p_partkey FROM part WHERE CAST(p_retailprice AS DECIMAL(38,9)) = 950.5")
def decimal_filter(spark, sf_dir) -> DataFrame:
    priced = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(38,9)").alias("price"))
    return priced.filter(F.col("price") == F.lit("950.5").cast("decimal(38,9)")).select("p_partkey")


@R.add("free_text_and_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars BETWEEN 100 AND 5000 AND (contains(lower(text), 'thing') OR contains(lower(source), 'thing'))")
def free_text_and_filter(spark, sf_dir) -> DataFrame:
    return _set(spark, sf_dir, "Document", ENGLISH).text("THing").where(Condition("n_chars", "range", {"min": 100, "max": 5000})).rows.select("doc_id")


@R.add("secure_count_direct", "SELECT CAST(COUNT(*) AS BIGINT) AS n FROM documents WHERE lang = 'en'")
def secure_count_direct(spark, sf_dir) -> DataFrame:
    return _set(spark, sf_dir, "Document", ENGLISH).count()


@R.add("secure_sum_chain", f"""SELECT l_returnflag, {MONEY.format('l_extendedprice')} AS price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey {CHAIN}
WHERE r_name = 'ASIA' AND l_shipdate BETWEEN '1995-01-01' AND '1995-12-31' GROUP BY 1""")
def secure_sum_chain(spark, sf_dir) -> DataFrame:
    lines = _set(spark, sf_dir, "LineItem").where(Condition("l_shipdate", "date_range", {"start": "1995-01-01", "end": "1995-12-31"}))
    return lines.rows.groupBy("l_returnflag").agg(money("l_extendedprice").alias("price"))


@R.add("per_user_counts", f"""WITH u AS (SELECT 'user_' || r_regionkey AS user_id, r_name FROM region UNION ALL SELECT 'user_none', NULL)
SELECT user_id, CAST(COUNT(c_custkey) AS BIGINT) AS n FROM u LEFT JOIN (SELECT c_custkey, r_name FROM customer {CHAIN}) v ON u.r_name = v.r_name GROUP BY 1""")
def per_user_counts(spark, sf_dir) -> DataFrame:
    return secure.per_user_counts(secure.with_boundary(ONTOLOGY, "Customer", loader(spark, sf_dir)), users(spark, sf_dir))


@R.add("partitions_touched", f"SELECT CAST(COUNT(*) AS BIGINT) AS considered, CAST(COUNT(*) FILTER (r_name <> 'ASIA') AS BIGINT) AS denied, CAST(COUNT(DISTINCT r_name) AS BIGINT) AS partitions FROM customer {CHAIN}")
def partitions_touched(spark, sf_dir) -> DataFrame:
    return secure.partitions_touched(secure.with_boundary(ONTOLOGY, "Customer", loader(spark, sf_dir)), "ASIA")


@R.add("compartment_crossings", f"""WITH c AS (SELECT c_custkey, r_name FROM customer {CHAIN}), s AS (SELECT s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT o_orderkey AS action_id, c.r_name AS read_label, s.r_name AS write_label FROM orders JOIN c ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN s ON l_suppkey = s_suppkey WHERE c.r_name <> s.r_name""")
def compartment_crossings(spark, sf_dir) -> DataFrame:
    load = loader(spark, sf_dir)
    reads = secure.with_boundary(ONTOLOGY, "Order", load).select(F.col("o_orderkey").alias("action_id"), F.col(secure.BOUNDARY).alias("label"))
    suppliers = secure.with_boundary(ONTOLOGY, "Supplier", load).select("s_suppkey", F.col(secure.BOUNDARY).alias("label"))
    writes = load("LineItem").select(F.col("l_orderkey").alias("action_id"), F.col("l_suppkey").alias("s_suppkey")).join(suppliers, "s_suppkey")
    return secure.crossings(reads, writes)


@R.add("search_around_fk", f"SELECT DISTINCT o_orderkey FROM {ASIA_ORDERS} AND c_mktsegment = 'MACHINERY'")
def search_around_fk(spark, sf_dir) -> DataFrame:
    return _set(spark, sf_dir, "Customer").where(Condition("c_mktsegment", "equals", "MACHINERY")).search_around("orders").rows.select("o_orderkey")


@R.add("search_around_forward", f"SELECT DISTINCT c_custkey FROM {ASIA_ORDERS} AND o_orderstatus = 'P'")
def search_around_forward(spark, sf_dir) -> DataFrame:
    return _set(spark, sf_dir, "Order").where(Condition("o_orderstatus", "equals", "P")).search_around("customer").rows.select("c_custkey")


@R.add("search_around_m2m", "SELECT DISTINCT l_partkey AS p_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND s_acctbal >= 5000")
def search_around_m2m(spark, sf_dir) -> DataFrame:
    return _set(spark, sf_dir, "Supplier").where(Condition("s_acctbal", "range", {"min": 5000})).search_around("parts").rows.select("p_partkey")


@R.add("link_counts", """WITH n AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
SELECT c_custkey AS source_id, 'orders' AS link, CAST(COUNT(DISTINCT o_orderkey) AS BIGINT) AS n FROM customer JOIN n ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
UNION ALL SELECT c_custkey, 'nation', 1 FROM customer JOIN n ON c_nationkey = n_nationkey""")
def link_counts(spark, sf_dir) -> DataFrame:
    return _set(spark, sf_dir, "Customer").link_counts("orders", "nation").withColumn("n", F.col("n").cast("long"))


@R.add("reverse_links", """SELECT DISTINCT n_nationkey AS source_id, c_custkey AS target_id
FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA'""")
def reverse_links(spark, sf_dir) -> DataFrame:
    return _set(spark, sf_dir, "Nation").reverse_links("customers")


def _aggregate(how: str, sql: str) -> None:
    @R.add(f"aggregate_{how}", f"SELECT o_orderpriority AS \"group\", {sql} AS value FROM {ASIA_ORDERS} AND o_orderpriority IS NOT NULL GROUP BY 1")
    def query(spark, sf_dir) -> DataFrame:
        orders = _set(spark, sf_dir, "Order")
        if how in ("sum", "avg"):  # decimals, so that the order of addition does not matter
            orders = objects.replace(orders, rows=orders.rows.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")))
            if how == "avg":
                n, s = orders.aggregate("count", "o_totalprice", "o_orderpriority"), orders.aggregate("sum", "o_totalprice", "o_orderpriority")
                return s.withColumnRenamed("value", "s").join(n, "group").select("group", (F.col("s").cast("double") / F.col("value")).alias("value"))
            return orders.aggregate(how, "o_totalprice", "o_orderpriority").withColumn("value", F.col("value").cast("double"))
        return orders.aggregate(how, "o_totalprice", "o_orderpriority")


_aggregate("count", "CAST(COUNT(o_totalprice) AS BIGINT)")
_aggregate("sum", MONEY.format("o_totalprice"))
_aggregate("avg", MONEY.format("o_totalprice") + " / COUNT(o_totalprice)")
_aggregate("min", "MIN(o_totalprice)")
_aggregate("max", "MAX(o_totalprice)")


@R.add("aggregate_mean", "SELECT p_brand AS \"group\", AVG(p_size) AS value FROM part WHERE p_brand IS NOT NULL GROUP BY 1")
def aggregate_mean(spark, sf_dir) -> DataFrame:
    return objects.ObjectSet.of(ONTOLOGY, "Part", loader(spark, sf_dir), ASIA).aggregate("avg", "p_size", "p_brand")


@R.add("denied_ids", f"SELECT r_name AS boundary, o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey {CHAIN} WHERE r_name <> 'ASIA'")
def denied_ids(spark, sf_dir) -> DataFrame:
    """The orders that a read for Asia denies, kept as bitmaps by boundary and given back."""
    return secure.denied_ids(secure.denied_bitmaps(secure.with_boundary(ONTOLOGY, "Order", loader(spark, sf_dir)), "o_orderkey", "ASIA"))


_VISIBLE_SQL = [f"SELECT 'reader' AS user_id, '{c}' AS field, CAST(COUNT({c}) AS BIGINT) AS filled FROM customer {CHAIN} WHERE r_name = 'ASIA' UNION ALL SELECT 'finder', '{c}', CAST(0 AS BIGINT)" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")]


@R.add("visible_values", " UNION ALL ".join(_VISIBLE_SQL))
def visible_values(spark, sf_dir) -> DataFrame:
    """What users see of customers: one may read them, one only discover that their fields exist, one nothing."""
    users = [User("reader", "ASIA", frozenset({"read:Customer"})), User("finder", "ASIA", frozenset({"discover:Customer"})), User("other", "ASIA", frozenset({"read:Order"}))]
    found = [secure.visible_values(ONTOLOGY, "Customer", u, loader(spark, sf_dir)).select(F.lit(u.user_id).alias("user_id"), "field", "filled") for u in users]
    return reduce(DataFrame.unionByName, found)


@R.add("aggregate_ungrouped", f"SELECT '' AS \"group\", MAX(o_totalprice) AS value FROM {ASIA_ORDERS}")
def aggregate_ungrouped(spark, sf_dir) -> DataFrame:
    return _set(spark, sf_dir, "Order").aggregate("max", "o_totalprice")


@R.add("value_counts_other", """WITH n AS (SELECT p_brand AS value, COUNT(*) AS n FROM part GROUP BY 1), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, value) AS k FROM n)
SELECT value, CAST(n AS BIGINT) AS n FROM r WHERE k <= 12 UNION ALL SELECT 'Other (' || COUNT(*) || ')', CAST(SUM(n) AS BIGINT) FROM r WHERE k > 12 HAVING COUNT(*) > 0""")
def value_counts_other(spark, sf_dir) -> DataFrame:
    return _all(spark, sf_dir, "Part").value_counts("p_brand")


@R.add("histogram", "SELECT p_size AS value, CAST(COUNT(*) AS BIGINT) AS n FROM part WHERE p_size IS NOT NULL GROUP BY 1")
def histogram(spark, sf_dir) -> DataFrame:
    return _all(spark, sf_dir, "Part").histogram("p_size")


@R.add("facets_cross_filtered", """SELECT 'p_type' AS facet, p_type AS value, CAST(COUNT(*) AS BIGINT) AS n FROM part WHERE p_brand = 'Brand#2' AND p_size BETWEEN 10 AND 30 GROUP BY 1, 2
UNION ALL SELECT 'p_brand', p_brand, COUNT(*) FROM part WHERE p_type = 'ECONOMY' AND p_size BETWEEN 10 AND 30 GROUP BY 1, 2
UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), COUNT(*) FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#2' GROUP BY 1, 2""")
def facets_cross_filtered(spark, sf_dir) -> DataFrame:
    return _all(spark, sf_dir, "Part").facets({
        "p_type": Condition("p_type", "equals", "ECONOMY"), "p_brand": Condition("p_brand", "equals", "Brand#2"), "p_size": Condition("p_size", "range", {"min": 10, "max": 30}),
    })


@R.add("order_page", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC NULLS LAST, c_custkey DESC LIMIT 50 OFFSET 100")
def order_page(spark, sf_dir) -> DataFrame:
    return _all(spark, sf_dir, "Customer").page("c_mktsegment:desc", 100).select("c_custkey", "c_mktsegment")


@R.add("search_page", f"SELECT c_custkey, c_name, CAST(COUNT(*) OVER () AS BIGINT) AS total FROM customer {CHAIN} WHERE r_name = 'ASIA' AND c_acctbal >= 1000 AND contains(lower(c_name || ' ' || c_mktsegment), 'building') ORDER BY c_name, c_custkey LIMIT 20")
def search_page(spark, sf_dir) -> DataFrame:
    found = _set(spark, sf_dir, "Customer").text("building").where(Condition("c_acctbal", "range", {"min": 1000}))
    total = found.count().select(F.col("n").alias("total"))
    return found.page("c_name", 0, 20).select("c_custkey", "c_name").crossJoin(total)  # a page by one row


@R.add("bulk_ids", f"SELECT c_custkey FROM customer {CHAIN} WHERE r_name = 'ASIA' AND c_mktsegment = 'BUILDING'")
def bulk_ids(spark, sf_dir) -> DataFrame:
    return _set(spark, sf_dir, "Customer").where(Condition("c_mktsegment", "equals", "BUILDING")).ids(ceiling=1_000_000_000)


@R.add("regression_by_segment", """SELECT c_mktsegment, ROUND(REGR_SLOPE(o_totalprice, c_acctbal), 6) AS slope, ROUND(REGR_INTERCEPT(o_totalprice, c_acctbal), 3) AS intercept, CAST(COUNT(*) AS BIGINT) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def regression_by_segment(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return objects.regression(rows, "o_totalprice", "c_acctbal", "c_mktsegment").select("c_mktsegment", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), "n")


@R.add("function_over_sets", """SELECT c_mktsegment, CAST(COUNT(DISTINCT o_orderkey) AS BIGINT) AS orders, CAST(COUNT(DISTINCT c_custkey) AS BIGINT) AS customers
FROM """ + ASIA_ORDERS + " GROUP BY 1")
def function_over_sets(spark, sf_dir) -> DataFrame:
    """A user function over the two governed sets that it declares."""
    read = objects.Declared(ONTOLOGY, loader(spark, sf_dir), ASIA, frozenset({"Order", "Customer"}))
    orders, customers = read("Order").rows, read("Customer").rows
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.countDistinct("o_orderkey").alias("orders"), F.countDistinct("c_custkey").alias("customers"))


@R.add("uneven_coverage", """WITH x AS (SELECT conv_id % 50 AS g, conv_id, list_sort(list(DISTINCT role)) AS roles FROM conversations GROUP BY 1, 2)
SELECT g AS "group", CAST(COUNT(DISTINCT roles) AS BIGINT) AS shapes FROM x GROUP BY 1 HAVING COUNT(DISTINCT roles) > 1""")
def uneven_coverage(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("group", F.col("conv_id") % 50)
    return objects.uneven_coverage(turns, "group", "conv_id", "role")


@R.add("get_objects", f"SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer {CHAIN} WHERE r_name = 'ASIA' AND c_custkey IN (SELECT o_custkey FROM orders)")
def get_objects(spark, sf_dir) -> DataFrame:
    clerk = User("clerk", "ASIA", frozenset({"read:Customer.c_name", "read:Customer.c_custkey", "discover:Customer"}))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    rows = _set(spark, sf_dir, "Customer").among(wanted).rows
    return secure.readable(ONTOLOGY, "Customer", clerk, rows).select("c_custkey", "c_name", "c_acctbal")


@R.add("field_catalog", " UNION ALL ".join(f"SELECT '{t}' AS type, '{f}' AS field, '{name}' AS \"table\", CAST({k} AS BIGINT) AS position, CAST(COUNT({c}) AS BIGINT) AS filled FROM {name}" for t, f, name, c, k in secure.field_catalog(ONTOLOGY)))
def field_catalog(spark, sf_dir) -> DataFrame:
    """The catalog of all types with how many rows of its table fill each column; a scan for each table."""
    fields = spark.createDataFrame(secure.field_catalog(ONTOLOGY), "type string, field string, table string, column string, position long")
    counts = []
    for t in ONTOLOGY.types.values():
        names = [f.source for f in t.fields]
        one = table(spark, sf_dir, t.table).agg(*[F.count(c).alias(c) for c in names])
        counts.append(one.select(F.explode(F.array(*[F.struct(F.lit(t.name).alias("type"), F.lit(c).alias("column"), F.col(c).alias("filled")) for c in names])).alias("c")).select("c.*"))
    return fields.join(reduce(DataFrame.unionByName, counts), ["type", "column"]).select("type", "field", "table", "position", "filled")


@R.add("reauthorised_view", f"SELECT c_custkey FROM customer {CHAIN} WHERE r_name = 'ASIA' AND c_mktsegment = 'BUILDING'")
def reauthorised_view(spark, sf_dir) -> DataFrame:
    """A saved view whose balance condition its user may no longer use: that condition is set aside."""
    clerk = User("clerk", "ASIA", frozenset({"read:Customer.c_mktsegment"}))
    view = [Condition("c_mktsegment", "equals", "BUILDING"), Condition("c_acctbal", "range", {"min": 0})]
    runs, _ = secure.reauthorise(ONTOLOGY, "Customer", view, clerk)
    return _set(spark, sf_dir, "Customer").where(*runs).rows.select("c_custkey")


@R.add("dangling_links", "SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS o_custkey FROM orders) o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def dangling_links(spark, sf_dir) -> DataFrame:
    orders = orders_v1(spark, sf_dir).withColumn("o_custkey", F.when(F.col("o_orderkey") % 31 == 0, F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey")))
    return orders.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").select("o_orderkey")


@R.add("published_ids", "SELECT DISTINCT l_orderkey FROM lineitem")
def published_ids(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
