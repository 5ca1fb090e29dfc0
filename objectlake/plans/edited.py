"""Object sets as they read with edits, checks of proposed changes, join tables, and short forms of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edits, objects
from ..operators.filters import Condition, equality
from .bindings import ASIA, LOG_SQL, ONTOLOGY, loader, table, write_log
from .log import R as LOG
from .log import SINCE
from .registry import Registry
from .sets import ASIA_ORDERS, CHAIN

R = Registry()
#: What customers in ASIA read as, edits over the lake's values.
EDITED = f"({LOG.sql['overlay']}) o JOIN customer ON CAST(c_custkey AS VARCHAR) = o.object_id {CHAIN} WHERE r_name = 'ASIA'"


def _edited(spark, sf_dir) -> objects.ObjectSet:
    load = edits.edited_load(ONTOLOGY, loader(spark, sf_dir), write_log(spark, sf_dir), F.expr(SINCE))
    return objects.ObjectSet.of(ONTOLOGY, "Customer", load, ASIA)


@R.add("overlay_aggregate", f'SELECT o.c_mktsegment AS "group", COUNT(*) AS value FROM {EDITED} AND o.c_mktsegment IS NOT NULL GROUP BY 1')
def overlay_aggregate(spark, sf_dir) -> DataFrame:
    return _edited(spark, sf_dir).aggregate("count", by="c_mktsegment").filter(F.col("group").isNotNull())


@R.add("overlay_filter", f"SELECT c_custkey, o.c_acctbal AS c_acctbal FROM {EDITED} AND o.c_acctbal BETWEEN 0 AND 100")
def overlay_filter(spark, sf_dir) -> DataFrame:
    return _edited(spark, sf_dir).where(Condition("c_acctbal", "range", {"min": 0, "max": 100})).rows.select("c_custkey", "c_acctbal")


@R.add("overlay_search_around", f"SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM {EDITED} AND o.c_acctbal BETWEEN 0 AND 100)")
def overlay_search_around(spark, sf_dir) -> DataFrame:
    some = _edited(spark, sf_dir).where(Condition("c_acctbal", "range", {"min": 0, "max": 100}))
    return some.search_around("orders").rows.select("o_orderkey")


CONSTRAINTS = [
    edits.Constraint("c_acctbal", "number"), edits.Constraint("c_acctbal", "min", 20), edits.Constraint("c_acctbal", "max", 90),
    edits.Constraint("c_mktsegment", "max_length", 4), edits.Constraint("c_mktsegment", "required"), edits.Constraint("c_phone", "one_of", ("1.0", "2.0")),
]


@R.add("constraint_violations", f"""WITH {LOG_SQL}, p AS (SELECT * FROM log WHERE field IS NOT NULL AND status <> 'abandoned' AND operation <> 'delete'),
r(field, rule) AS (VALUES ('c_acctbal', 'number'), ('c_acctbal', 'min'), ('c_acctbal', 'max'), ('c_mktsegment', 'max_length'), ('c_mktsegment', 'required'), ('c_phone', 'one_of'))
SELECT id, object_id, field, field_value AS value, rule FROM p JOIN r USING (field) WHERE CASE rule
WHEN 'number' THEN field_value IS NOT NULL AND TRY_CAST(field_value AS DOUBLE) IS NULL WHEN 'min' THEN TRY_CAST(field_value AS DOUBLE) < 20 WHEN 'max' THEN TRY_CAST(field_value AS DOUBLE) > 90
WHEN 'max_length' THEN LENGTH(field_value) > 4 WHEN 'required' THEN field_value IS NULL OR TRIM(field_value) = '' ELSE field_value NOT IN ('1.0', '2.0') END""")
def constraint_violations(spark, sf_dir) -> DataFrame:
    return edits.violations(write_log(spark, sf_dir), "Customer", CONSTRAINTS)


@R.add("join_table", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0) AND l_suppkey IN (SELECT s_suppkey FROM supplier)")
def join_table(spark, sf_dir) -> DataFrame:
    """Parts and suppliers by line items; pairs whose part is withheld dangle."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    return objects.join_table(pairs, table(spark, sf_dir, "part").filter("p_partkey % 7 <> 0").select("p_partkey"), table(spark, sf_dir, "supplier").select("s_suppkey"))


@R.add("equality_shorthand", f"SELECT o_orderkey FROM {ASIA_ORDERS} AND o_orderstatus = 'F' AND o_custkey = 7")
def equality_shorthand(spark, sf_dir) -> DataFrame:
    orders = objects.ObjectSet.of(ONTOLOGY, "Order", loader(spark, sf_dir), ASIA)
    return orders.where(*equality({"o_orderstatus": "F", "o_custkey": 7})).rows.select("o_orderkey")


@R.add("truncated", f"SELECT o_orderkey, (SELECT COUNT(*) > 100 FROM {ASIA_ORDERS}) AS more FROM {ASIA_ORDERS} ORDER BY o_orderkey LIMIT 100")
def truncated(spark, sf_dir) -> DataFrame:
    rows, more = objects.ObjectSet.of(ONTOLOGY, "Order", loader(spark, sf_dir), ASIA).truncated(100)
    return rows.select("o_orderkey", F.lit(more).alias("more"))
