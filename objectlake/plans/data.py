"""Queries over cleaning, validation, change capture and versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import drift, lenient
from ..functions.text import standardised
from ..operators import changes, clean
from ..operators.clean import Constraint
from ..session import shared_folder
from ..sources import tables
from ..sources.tables import Lake
from .bindings import DIRTY_SQL, dirty_documents, orders_v1, orders_v2, table
from .registry import Registry

R = Registry()
V1_SQL = "v1 AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders)"
V2_SQL = """v2 AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM v1 WHERE o_orderkey % 17 <> 0
UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus FROM v1 WHERE o_orderkey % 101 = 0)"""
DIFF_SQL = f"""WITH {V1_SQL}, {V2_SQL}, d AS (SELECT COALESCE(CAST(a.o_orderkey AS VARCHAR), CAST(b.o_orderkey AS VARCHAR)) AS id,
  CASE WHEN a.o_orderkey IS NULL THEN 'INSERT' WHEN b.o_orderkey IS NULL THEN 'DELETE' WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_custkey IS DISTINCT FROM b.o_custkey THEN 'UPDATE' END AS change,
  COALESCE(b.o_orderstatus, a.o_orderstatus) AS status FROM v1 a FULL JOIN v2 b ON a.o_orderkey = b.o_orderkey)"""


@R.add("standardise_text", f"""WITH d AS ({DIRTY_SQL}), n AS (SELECT doc_id, nfc_normalize(text) AS text FROM d),
a AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM n),
b AS (SELECT doc_id, regexp_replace(text, '[ \\t\\x0b\\x0c\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g') AS text FROM a),
c AS (SELECT doc_id, regexp_replace(text, ' ?\\n ?', chr(10), 'g') AS text FROM b)
SELECT doc_id, NULLIF(regexp_replace(text, '^[ \\n]+|[ \\n]+$', '', 'g'), 'N/A') AS text FROM c""")
def standardise_text(spark, sf_dir) -> DataFrame:
    return standardised(dirty_documents(spark, sf_dir).select("doc_id", "text"), ["text"], null_if=("N/A",))


def _raw_events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.get_json_object("props", "$.k").alias("k"),
        F.when(F.col("event_id") % 40 == 0, F.concat(F.col("value").cast("string"), F.lit("x"))).otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_id") % 25 == 0, F.lit("2024-1-5")).otherwise(F.lit("2024-01-05")).alias("day"),
    )


RAW_SQL = """raw AS (SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 40 = 0 THEN CAST(value AS VARCHAR) || 'x' ELSE CAST(value AS VARCHAR) END AS value,
  CASE WHEN event_id % 25 = 0 THEN '2024-1-5' ELSE '2024-01-05' END AS day FROM events)"""


@R.add("coerce_drift", f"""WITH {RAW_SQL} SELECT 'k' AS "column", 'integer' AS data_type, CAST(COUNT(*) FILTER (k IS NOT NULL AND NOT regexp_matches(k, '^[+-]?[0-9]+$')) AS BIGINT) AS misfits FROM raw
UNION ALL SELECT 'value', 'number', COUNT(*) FILTER (value IS NOT NULL AND TRY_CAST(value AS DOUBLE) IS NULL) FROM raw
UNION ALL SELECT 'day', 'date', COUNT(*) FILTER (day IS NOT NULL AND NOT regexp_matches(day, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')) FROM raw""")
def coerce_drift(spark, sf_dir) -> DataFrame:
    return drift(_raw_events(spark, sf_dir), {"k": "integer", "value": "number", "day": "date"}).drop("example")


@R.add("lenient_read", f"WITH {RAW_SQL} SELECT event_id, TRY_CAST(value AS DOUBLE) AS value, value AS value_raw FROM raw")
def lenient_read(spark, sf_dir) -> DataFrame:
    return lenient(_raw_events(spark, sf_dir).select("event_id", "value"), {"value": "number"})


RULES = [
    Constraint("c_acctbal", "min", 0, "number", "quarantine"), Constraint("c_acctbal", "max", 9000, "number"),
    Constraint("c_mktsegment", "one_of", ["BUILDING", "MACHINERY", "AUTOMOBILE"], policy="quarantine"), Constraint("c_name", "pattern", r"Customer#[0-9]{9}"),
    Constraint("c_name", "max_length", 18),
]
BROKEN_SQL = """broken AS (SELECT c_custkey, 'c_acctbal' AS field, 'min' AS reason, 'quarantine' AS policy FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'c_acctbal', 'max', 'warn' FROM customer WHERE c_acctbal > 9000
UNION ALL SELECT c_custkey, 'c_mktsegment', 'one_of', 'quarantine' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')
UNION ALL SELECT c_custkey, 'c_name', 'pattern', 'warn' FROM customer WHERE NOT regexp_full_match(c_name, 'Customer#[0-9]{9}')
UNION ALL SELECT c_custkey, 'c_name', 'max_length', 'warn' FROM customer WHERE length(c_name) > 18)"""


@R.add("constraints", f"WITH {BROKEN_SQL} SELECT c_custkey, field, reason FROM broken")
def constraints(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(clean.violations(RULES)).alias("v"))
    return rows.select("c_custkey", "v.field", "v.reason")


@R.add("expectations_split", f"""WITH {BROKEN_SQL}, held AS (SELECT DISTINCT c_custkey FROM broken WHERE policy = 'quarantine')
SELECT field, reason, policy, CAST(COUNT(*) AS BIGINT) AS n FROM broken WHERE policy = 'quarantine' OR c_custkey NOT IN (SELECT c_custkey FROM held) GROUP BY 1, 2, 3
UNION ALL SELECT 'kept', '', '', COUNT(*) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM held)""")
def expectations_split(spark, sf_dir) -> DataFrame:
    kept, _, counts = clean.expectations(table(spark, sf_dir, "customer"), RULES)
    return counts.unionByName(kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("field"), F.lit("").alias("reason"), F.lit("").alias("policy"), "n"))


LINE_KEY = ["l_orderkey", "l_linenumber"]


@R.add("duplicates_quarantine", "SELECT l_orderkey, l_linenumber, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def duplicates_quarantine(spark, sf_dir) -> DataFrame:
    _, held = clean.split_duplicates(table(spark, sf_dir, "lineitem"), LINE_KEY)
    return held.groupBy(*LINE_KEY).agg(F.count(F.lit(1)).alias("n"))


@R.add("duplicates_keep_last", """WITH g AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS n, COUNT(DISTINCT l_extendedprice) AS d, MAX(l_extendedprice) AS last FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, last AS l_extendedprice FROM g WHERE n = d""")
def duplicates_keep_last(spark, sf_dir) -> DataFrame:
    kept, _ = clean.split_duplicates(table(spark, sf_dir, "lineitem"), LINE_KEY, "l_extendedprice")
    return kept.select(*LINE_KEY, "l_extendedprice")


@R.add("join_surrogate", "SELECT DISTINCT l_suppkey || chr(31) || l_partkey AS id FROM lineitem")
def join_surrogate(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(clean.join_surrogate("l_suppkey", "l_partkey").alias("id")).distinct()


@R.add("lineage_hash", """SELECT 'erp' AS _silo, 'orders' AS _source_table, substr(sha256('o_custkey' || chr(31) || '=' || o_custkey || chr(30) || 'o_orderkey' || chr(31) || '=' || o_orderkey || chr(30) || 'o_orderstatus' || chr(31) || '=' || o_orderstatus), 1, 32) AS _row_hash, o_orderkey FROM orders""")
def lineage_hash(spark, sf_dir) -> DataFrame:
    return clean.with_lineage(orders_v1(spark, sf_dir), "erp", "orders").select("_silo", "_source_table", "_row_hash", "o_orderkey")


@R.add("snapshot_diff", DIFF_SQL + " SELECT id, change, status FROM d WHERE change IS NOT NULL")
def snapshot_diff(spark, sf_dir) -> DataFrame:
    return changes.diff(orders_v1(spark, sf_dir), orders_v2(spark, sf_dir), "o_orderkey").select("id", "change", F.col("values.o_orderstatus").alias("status"))


@R.add("generation_diff", DIFF_SQL + " SELECT id, change, status FROM d WHERE change IS NOT NULL AND CAST(id AS BIGINT) % 100 < 3 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'DELETE', o_orderstatus FROM orders WHERE o_orderkey % 1000 = 550")
def generation_diff(spark, sf_dir) -> DataFrame:
    """Changes between two generations of orders, of which ids in three hundredths change as in snapshot_diff and few others go: buckets that stay aren't read."""
    lake, v1, v2, few = _lake(spark), orders_v1(spark, sf_dir), orders_v2(spark, sf_dir), "o_orderkey % 100 < 3"
    for rows in (v1, v2.filter(few).unionByName(v1.filter(f"not ({few}) and o_orderkey % 1000 <> 550"))):
        with lake.together() as now:
            now.publish_buckets("orders", rows, "o_orderkey", 128)
    found = changes.generation_diff(lake.generation(1), lake.generation(2), "orders")
    return found.select("id", "change", F.col("values.o_orderstatus").alias("status"))


@R.add("partial_read_guard", "SELECT CAST(COUNT(*) AS BIGINT) AS before, CAST(COUNT(*) FILTER (o_orderkey % 3 = 0) AS BIGINT) AS after, COUNT(*) FILTER (o_orderkey % 3 = 0) < 0.5 * COUNT(*) AS refused FROM orders")
def partial_read_guard(spark, sf_dir) -> DataFrame:
    v1 = orders_v1(spark, sf_dir)
    return changes.partial_read(v1, v1.filter("o_orderkey % 3 = 0"))


@R.add("changelog_counts", DIFF_SQL + " SELECT change, CAST(COUNT(*) AS BIGINT) AS n FROM d WHERE change IS NOT NULL GROUP BY 1")
def changelog_counts(spark, sf_dir) -> DataFrame:
    """Changes appended to a changelog and read back."""
    lake = _lake(spark)
    lake.append("changelog", changes.checked_diff(orders_v1(spark, sf_dir), orders_v2(spark, sf_dir), "o_orderkey").withColumn("_recorded_at", F.current_timestamp()))
    return lake.appended("changelog").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@R.add("history_of_object", DIFF_SQL + """ SELECT id AS object_id, change, CAST(2 AS INTEGER) AS publication FROM d WHERE change IS NOT NULL AND id IN ('13', '17', '1000000101')
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'INSERT', 1 FROM v1 WHERE o_orderkey IN (13, 17)""")
def history_of_object(spark, sf_dir) -> DataFrame:
    v1, v2 = orders_v1(spark, sf_dir), orders_v2(spark, sf_dir)
    first = changes.as_history(changes.diff(v1.limit(0), v1, "o_orderkey"), 1)
    both = first.unionByName(changes.as_history(changes.diff(v1, v2, "o_orderkey"), 2))
    found = [changes.history_of(both, i) for i in ("13", "17", "1000000101")]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("object_id", "change", "publication")


@R.add("source_type_drift", """SELECT 'o_orderkey' AS "column", 'int' AS was, 'bigint' AS now, 'widened' AS verdict, CAST(COUNT(*) FILTER (TRY_CAST(o_orderkey AS INTEGER) IS NULL) AS BIGINT) AS misfits FROM orders
UNION ALL SELECT 'o_orderstatus', 'int', 'string', 'CHANGED', COUNT(*) FILTER (o_orderkey % 10 <> 0) FROM orders""")
def source_type_drift(spark, sf_dir) -> DataFrame:
    """Columns whose type differs between two published versions of a table, with the new values that the old type can't hold."""
    lake, k = _lake(spark), F.col("o_orderkey")
    rows = orders_v1(spark, sf_dir)
    lake.publish("orders", rows.select(k.cast("int").alias("o_orderkey"), "o_custkey", (k % 3).cast("int").alias("o_orderstatus")))
    lake.publish("orders", rows.withColumn("o_orderstatus", F.when(k % 10 == 0, "7").otherwise(F.col("o_orderstatus"))))
    types = lambda n: spark.createDataFrame(list(tables.source_types(lake.read("orders", n)).items()), "column string, type string")
    return changes.misfits_of_old_types(changes.type_drift(types(1), types(2)), lake.read("orders", 2))


def _held_values(rows: DataFrame) -> DataFrame:
    """column, filled, values: how many rows have a value in each column, and how many different ones there are."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in rows.columns])).alias("_"))
    counted = each.select("_.*").filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("column").agg(F.sum("n").alias("filled"), F.count(F.lit(1)).alias("values"))


def _held(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    short, long_ = d.filter("n_chars < 300"), d.filter("n_chars > 5000")
    pick = lambda df, reason: df.select(F.col("doc_id").alias("object_id"), F.lit(reason).alias("reason"), F.concat(F.lit("2024-01-0"), 1 + F.col("doc_id") % 9).alias("detected_at"))
    return pick(short, "too short").unionByName(pick(long_, "too long")).unionByName(pick(d.filter("lang = 'es'"), "language"))


HELD_SQL = """held AS (SELECT doc_id AS object_id, 'too short' AS reason, '2024-01-0' || (1 + doc_id % 9) AS detected_at FROM documents WHERE n_chars < 300
UNION ALL SELECT doc_id, 'too long', '2024-01-0' || (1 + doc_id % 9) FROM documents WHERE n_chars > 5000 UNION ALL SELECT doc_id, 'language', '2024-01-0' || (1 + doc_id % 9) FROM documents WHERE lang = 'es'),
by_reason AS (SELECT reason, COUNT(*) AS n FROM held GROUP BY 1)"""


@R.add("quarantine_report", f"""WITH {HELD_SQL} SELECT 'documents' AS "table", CAST(COUNT(DISTINCT object_id) AS BIGINT) AS objects, CAST(COUNT(*) AS BIGINT) AS findings,
(SELECT reason FROM by_reason ORDER BY n DESC, reason DESC LIMIT 1) AS worst, MAX(detected_at) AS last_detected FROM held""")
def quarantine_report(spark, sf_dir) -> DataFrame:
    return clean.quarantine_report(_held(spark, sf_dir), "documents")


@R.add("quarantine_summary", f"""WITH {HELD_SQL} SELECT CAST(1 AS BIGINT) + 1 AS tables, CAST((SELECT COUNT(*) FROM held) + (SELECT COUNT(*) FROM customer WHERE c_acctbal < 0) AS BIGINT) AS findings""")
def quarantine_summary(spark, sf_dir) -> DataFrame:
    customers = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("object_id"), F.lit("negative").alias("reason"), F.lit("2024-01-01").alias("detected_at"))
    both = clean.quarantine_report(_held(spark, sf_dir), "documents").unionByName(clean.quarantine_report(customers, "customer"))
    return both.agg(F.count(F.lit(1)).alias("tables"), F.sum("findings").alias("findings"))


@R.add("additive_schema_union", f"WITH {V1_SQL} SELECT o_orderkey, o_custkey, o_orderstatus, CAST(NULL AS DOUBLE) AS o_totalprice FROM v1 WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 1")
def additive_schema_union(spark, sf_dir) -> DataFrame:
    old = orders_v1(spark, sf_dir).filter("o_orderkey % 2 = 0")
    new = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 1").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return tables.union_by_name(old, new)


@R.add("unchanged_fingerprint", "SELECT CAST(COUNT(*) AS BIGINT) AS rows, true AS same_reordered, false AS same_edited FROM orders")
def unchanged_fingerprint(spark, sf_dir) -> DataFrame:
    v1 = orders_v1(spark, sf_dir)
    same = tables.unchanged(v1, v1.repartition(5, "o_custkey").select("o_orderstatus", "o_custkey", "o_orderkey"))
    edited = tables.unchanged(v1, v1.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 3, "Z").otherwise(F.col("o_orderstatus"))))
    return tables.fingerprint(v1).select(F.col("n").alias("rows"), F.lit(same).alias("same_reordered"), F.lit(edited).alias("same_edited"))


ORDERS = {"o_orderkey": True, "o_custkey": True, "o_orderstatus": True, "o_totalprice": False}


@R.add("columns_changed", " UNION ALL ".join(
    f'SELECT \'{c}\' AS "column", ' + ", ".join(
        f'{f"CAST(COUNT({what}) AS BIGINT)" if there else "CAST(NULL AS BIGINT)"} AS "{name}"'
        for there, names in ((old, ("filled_before", "values_before")), (True, ("filled", "values"))) for what, name in zip((c, f"DISTINCT {c}"), names)
    ) + f", {'false' if old else 'true'} AS added, true AS rebuilt FROM orders" for c, old in ORDERS.items()
))
def columns_changed(spark, sf_dir) -> DataFrame:
    """What each column of two published versions holds in either (rows with a value, different values), whether it is new, and whether the table is built anew for its columns."""
    lake = _lake(spark)
    lake.publish("orders", orders_v1(spark, sf_dir))
    lake.publish("orders", table(spark, sf_dir, "orders").select(*ORDERS))
    before, now = lake.read("orders", 1), lake.read("orders", 2)
    both = _held_values(before).select("column", F.col("filled").alias("filled_before"), F.col("values").alias("values_before")).join(_held_values(now), "column", "full")
    return both.withColumns({"added": ~F.col("column").isin(before.columns), "rebuilt": F.lit(changes.columns_changed(before, now))})


def _lake(spark) -> Lake:
    return Lake(spark, f"{shared_folder(spark)}/lake-{uuid.uuid4().hex}")


def _published(spark, sf_dir) -> Lake:
    lake = _lake(spark)
    refuse = lambda new, old: tables.audit(new, "o_orderkey", ["o_custkey"], {}, old.count() if old is not None else None)
    for rows in (orders_v1(spark, sf_dir), orders_v2(spark, sf_dir), orders_v2(spark, sf_dir).filter("o_orderkey % 19 <> 0")):
        lake.publish("orders", rows, refuse)
    return lake


@R.add("pinned_read", f"WITH {V1_SQL}, {V2_SQL} SELECT o_orderkey, o_orderstatus FROM v2")
def pinned_read(spark, sf_dir) -> DataFrame:
    return _published(spark, sf_dir).read("orders", 2).select("o_orderkey", "o_orderstatus")


@R.add("generation_read", f"WITH {V1_SQL} SELECT n_name, CAST(COUNT(*) AS BIGINT) AS orders, CAST(COUNT(DISTINCT c_custkey) AS BIGINT) AS customers FROM v1 JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def generation_read(spark, sf_dir) -> DataFrame:
    """Three tables as they were in one generation, after all of them have been published anew, two of them together."""
    lake, customers, nations = _lake(spark), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    with lake.together() as first:
        for name, rows in (("orders", orders_v1(spark, sf_dir)), ("customer", customers), ("nation", nations)):
            first.publish(name, rows)
    then = lake.generation(first.number)
    with lake.together() as second:
        second.publish("orders", orders_v2(spark, sf_dir))
        second.publish("customer", customers.withColumn("c_nationkey", (F.col("c_nationkey") + 1) % 25))
    lake.publish("nation", nations.filter("n_nationkey < 20"))
    joined = then.read("orders").join(then.read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(then.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("c_custkey").alias("customers"))


@R.add("expired_versions", f"""WITH {V1_SQL}, {V2_SQL} SELECT CAST(1 AS BIGINT) AS version, CAST(COUNT(*) AS BIGINT) AS rows, true AS kept FROM v1 UNION ALL SELECT 2, COUNT(*), false FROM v2
UNION ALL SELECT 3, COUNT(*), true FROM v2 WHERE o_orderkey % 19 <> 0""")
def expired_versions(spark, sf_dir) -> DataFrame:
    """Of three publications the first is pinned and the last current; the one between goes, its line in the log stays."""
    lake = _published(spark, sf_dir)
    lake.pin("first", 1)
    removed = lake.expire(keep=1, grace=0)
    assert removed.count() == 1
    left = [n for n in (1, 2, 3) if _readable(lake, "orders", n)]
    return lake.log().select("version", "rows", F.col("version").isin(left).alias("kept"))


def _readable(lake: Lake, name: str, version: int) -> bool:
    try:
        lake.read(name, version).count()
    except KeyError:
        return False
    return True


@R.add("snapshot_history", f"""WITH {V1_SQL}, {V2_SQL} SELECT 'orders' AS "table", CAST(3 AS BIGINT) AS version, CAST(COUNT(*) AS BIGINT) AS rows, 'replace' AS operation, true AS current FROM v2 WHERE o_orderkey % 19 <> 0
UNION ALL SELECT 'orders', 2, COUNT(*), 'replace', false FROM v2 UNION ALL SELECT 'orders', 1, COUNT(*), 'create', false FROM v1""")
def snapshot_history(spark, sf_dir) -> DataFrame:
    return tables.recent_snapshots(_published(spark, sf_dir).log()).select("table", "version", "rows", "operation", "current")


@R.add("publication_audit", """WITH b AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 31 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS c FROM orders)
SELECT 'missing id' AS problem, CAST(COUNT(*) AS BIGINT) AS n FROM b WHERE k IS NULL
UNION ALL SELECT 'duplicate id', COUNT(*) FROM (SELECT k FROM b WHERE k IS NOT NULL GROUP BY k HAVING COUNT(*) > 1)
UNION ALL SELECT 'dangling o_custkey', COUNT(*) FROM b WHERE c NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'shrunk', (SELECT COUNT(*) * 2 + 2 FROM orders)""")
def publication_audit(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    broken = orders_v1(spark, sf_dir).select(
        F.when(k % 97 == 0, None).when(k % 89 == 0, k + 1).otherwise(k).alias("o_orderkey"), F.when(k % 31 == 0, F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey")).alias("o_custkey"),
    )
    before = 3 * broken.count() + 2
    found = tables.audit(broken, "o_orderkey", ["o_custkey"], {"o_custkey": (table(spark, sf_dir, "customer"), "c_custkey")}, before)
    return found.withColumn("n", F.col("n").cast("long"))


@R.add("integrity", """SELECT 'lineitem' AS "table", 'silver has fewer rows' AS finding WHERE (SELECT COUNT(*) FROM lineitem) > (SELECT COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
UNION ALL SELECT 'part', 'silver without bronze' UNION ALL SELECT 'returns', 'declared but missing' UNION ALL SELECT 'events', 'not declared'""")
def integrity(spark, sf_dir) -> DataFrame:
    count = lambda name, layer, rows: rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), F.lit(layer).alias("layer"), "rows")
    line, part, orders = (table(spark, sf_dir, n) for n in ("lineitem", "part", "orders"))
    inventory = tables.union_by_name(
        count("lineitem", "bronze", line), count("lineitem", "silver", line.select(*LINE_KEY).distinct()), count("part", "silver", part),
        count("orders", "bronze", orders), count("orders", "silver", orders), count("events", "bronze", table(spark, sf_dir, "events")),
    )
    declared = spark.createDataFrame([("lineitem",), ("part",), ("orders",), ("returns",)], "table string")
    return tables.integrity(inventory, declared)


@R.add("lake_overview", """SELECT 'bronze_customer' AS "table", CAST(1 AS BIGINT) AS version, CAST(COUNT(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS held FROM customer
UNION ALL SELECT 'silver_customer', 1, COUNT(*) FILTER (c_acctbal >= 0), COUNT(*) FILTER (c_acctbal < 0) FROM customer""")
def lake_overview(spark, sf_dir) -> DataFrame:
    """The newest publication of a synced table with its held findings."""
    from .medallion import sync

    lake = _lake(spark)
    sync(lake, "customer", table(spark, sf_dir, "customer"), "c_custkey", {"c_custkey": "integer", "c_name": "string", "c_acctbal": "number"}, RULES[:1])
    held = lake.appended("quarantine").groupBy("table").agg(F.count(F.lit(1)).alias("held"))
    return tables.recent_snapshots(lake.log()).filter("current").join(held.withColumn("table", F.concat(F.lit("silver_"), "table")), "table", "left").select("table", "version", "rows", F.coalesce("held", F.lit(0)).alias("held"))


@R.add("bulk_rows", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'owner-a' ELSE 'owner-b' END AS owner, o_orderkey + 10 AS amount, 'bulk-' || (o_orderkey % 5) AS category FROM orders")
def bulk_rows(spark, sf_dir) -> DataFrame:
    """A transaction for each order."""
    return tables.bulk_rows(table(spark, sf_dir, "orders"), "o_orderkey")
