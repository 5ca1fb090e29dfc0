"""Gold tables built in one sync: resolved from two sources, with conflicts, and with their links audited."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Field, ObjectType
from ..sources.tables import Lake
from . import medallion
from .bindings import ONTOLOGY, SOURCES_SQL, customer_sources, table
from .data import _lake
from .registry import Registry

R = Registry()
CLIENT = ObjectType("Client", "erp", "client_id", (Field("client_id", "id", required=True), Field("c_name"), Field("c_nationkey", data_type="integer"), Field("c_acctbal", data_type="number")))
SOURCES = {"erp": ("erp", "id"), "crm": ("crm", "id")}
ORDER = {"c_acctbal": ["crm", "erp"]}
DECLARED = {"id": "string", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "number"}


def _clients(spark, sf_dir, approved: DataFrame | None = None, security: str | None = None) -> Lake:
    """A lake with both customer sources synced and their gold table built."""
    lake = _lake(spark)
    for name, (rows, key) in customer_sources(spark, sf_dir).items():
        medallion.sync(lake, name, rows, key, DECLARED, [])
    rule = medallion.Identity(SOURCES, ["c_name"], ORDER, security)
    medallion.build_gold(lake, [CLIENT], identities={"Client": rule}, approved={"Client": approved} if approved is not None else None)
    return lake


@R.add("gold_fused", """SELECT CAST(c_custkey AS VARCHAR) AS client_id, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
CASE WHEN c_custkey % 3 <> 0 THEN 'crm,erp' ELSE 'erp' END AS _fused_from FROM customer""")
def gold_fused(spark, sf_dir) -> DataFrame:
    return _clients(spark, sf_dir).read("gold_Client")


@R.add("gold_conflicts", """WITH c AS (SELECT *, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 3 <> 0)
SELECT id AS entity_id, 'property' AS kind, 'c_nationkey' AS field, CAST(c_nationkey AS VARCHAR) AS chosen, 'erp' AS chosen_source, CAST((c_nationkey + 1) % 25 AS VARCHAR) AS losing, 'crm' AS losing_source FROM c WHERE c_custkey % 50 = 0
UNION ALL SELECT id, 'property', 'c_acctbal', NULL, 'crm', NULL, 'erp' FROM c WHERE c_custkey % 10 = 0""")
def gold_conflicts(spark, sf_dir) -> DataFrame:
    """What lost when the gold table was built; balances are left out, as engines print floats unlike."""
    found = _clients(spark, sf_dir).appended("gold_conflicts_Client")
    shown = lambda c: F.when(F.col("field") != "c_acctbal", F.col(c)).alias(c)
    return found.select("entity_id", "kind", "field", shown("chosen"), "chosen_source", shown("losing"), "losing_source")


#: Every ninth customer is approved as the one after it; a group whose members differ in their nation is refused.
GROUPED_SQL = f"""WITH {SOURCES_SQL}, k AS (SELECT *, CAST(replace(source_id, 'crm-', '') AS BIGINT) AS k FROM both_sources),
g AS (SELECT *, CASE WHEN k % 9 = 1 AND k - 1 IN (SELECT c_custkey FROM customer) THEN k - 1 ELSE k END AS g FROM k),
s AS (SELECT g, MIN(c_nationkey) <> MAX(c_nationkey) AS refused, arg_min(source_id, (rank, source_id)) AS named_by FROM g GROUP BY 1),
e AS (SELECT g.*, CASE WHEN NOT refused THEN named_by WHEN rank = 0 THEN source_id ELSE source || ':' || source_id END AS entity_id, refused FROM g JOIN s USING (g))"""


@R.add("gold_resolved", f"""{GROUPED_SQL} SELECT entity_id AS client_id, arg_min(c_name, (rank, source_id)) AS c_name, CAST(arg_min(c_nationkey, (rank, source_id)) AS BIGINT) AS c_nationkey,
arg_min(c_acctbal, (-rank, source_id)) AS c_acctbal, string_agg(DISTINCT source, ',' ORDER BY source) AS _fused_from FROM e GROUP BY 1""")
def gold_resolved(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    pairs = table(spark, sf_dir, "customer").filter(k % 9 == 1).select(F.concat(F.lit("erp:"), k - 1).alias("left"), F.concat(F.lit("erp:"), k).alias("right"))
    return _clients(spark, sf_dir, pairs, "c_nationkey").read("gold_Client")


@R.add("gold_links", """SELECT 'Customer' AS type, CAST(COUNT(*) AS BIGINT) AS objects, false AS refused FROM customer UNION ALL SELECT 'Nation', COUNT(*), false FROM nation
UNION ALL SELECT 'Order', NULL, true FROM orders WHERE o_orderkey % 31 = 0 GROUP BY 1""")
def gold_links(spark, sf_dir) -> DataFrame:
    """Types that link to each other; orders of which some name no customer are not published."""
    lake = _lake(spark)
    types = [ONTOLOGY.types[n] for n in ("Order", "Customer", "Nation")]
    orders = table(spark, sf_dir, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 31 == 0, F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey")))
    for t in types:
        rows = orders if t.name == "Order" else table(spark, sf_dir, t.table)
        medallion.sync(lake, t.table, rows, t.id_field, {f.source: f.data_type for f in t.fields}, [])
    refused: dict[str, str] = {}
    built = medallion.build_gold(lake, types, refused=refused)
    log = lake.log().filter(F.col("table").startswith("gold_")).select(F.substring("table", 6, 99).alias("type"), F.col("rows").alias("objects"), F.lit(False).alias("refused"))
    assert set(built) | set(refused) == {t.name for t in types}
    failed = spark.createDataFrame([(n,) for n in refused], "type string")
    return log.unionByName(failed.select("type", F.lit(None).cast("long").alias("objects"), F.lit(True).alias("refused")))
