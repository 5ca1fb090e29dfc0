"""Queries over sources as they are ingested: formats, targets, audit lines, verdicts and integrity."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import drift
from ..operators import changes
from ..session import shared_folder
from ..sources import tables
from . import medallion
from .bindings import ONTOLOGY, table
from .data import RAW_SQL, _lake, _raw_events
from .registry import Registry

R = Registry()


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"


@R.add("source_read", "SELECT o_orderkey, o_custkey, o_orderstatus, CASE o_orderkey % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' ELSE 'orc' END AS kind FROM orders")
def source_read(spark, sf_dir) -> DataFrame:
    """Orders lie in three formats; named columns of each are read."""
    orders, root = table(spark, sf_dir, "orders"), _folder(spark)
    kinds, wanted = ("csv", "json", "orc"), ["o_orderkey", "o_custkey", "o_orderstatus"]
    schema = ", ".join(f"{c} {t}" for c, t in orders.dtypes)
    for k, kind in enumerate(kinds):
        orders.filter(F.col("o_orderkey") % 3 == k).write.format(kind).save(f"{root}/{kind}")
    return reduce(DataFrame.unionByName, [tables.read(spark, kind, f"{root}/{kind}", wanted, schema).withColumn("kind", F.lit(kind)) for kind in kinds])


#: The tables that types and links need, and one column that a source lacks.
TARGETS = medallion.targets(list(ONTOLOGY.types.values()), {"lineitem": ["l_partkey", "l_suppkey", "l_gone"]})


_TARGET_SQL = [f'SELECT \'{t}\' AS "table", \'{c}\' AS "column", ' + ("CAST(NULL AS BIGINT) AS filled" if c == "l_gone" else f"CAST(COUNT({c}) AS BIGINT) AS filled FROM {t}") for t, columns in TARGETS.items() for c in columns]


@R.add("sync_targets", " UNION ALL ".join(_TARGET_SQL))
def sync_targets(spark, sf_dir) -> DataFrame:
    """Every column that a sync reads, with how many rows fill it; NULL for one that its source doesn't have."""
    found = []
    for name, columns in TARGETS.items():
        there = [c for c in columns if c in tables.columns_present(table(spark, sf_dir, name))]
        counts = tables.read(spark, "parquet", f"{sf_dir}/{name}.parquet", there).agg(*[F.count(c).alias(c) for c in there])
        each = [F.struct(F.lit(c).alias("column"), (F.col(c) if c in there else F.lit(None).cast("long")).alias("filled")) for c in columns]
        found.append(counts.select(F.lit(name).alias("table"), F.explode(F.array(*each)).alias("c")).select("table", "c.*"))
    return reduce(DataFrame.unionByName, found)


@R.add("audit_trail", "SELECT event_type, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users FROM events WHERE event_id % 50 <> 0 GROUP BY 1")
def audit_trail(spark, sf_dir) -> DataFrame:
    """The events as JSON lines, every fiftieth of which is torn."""
    line, path = F.to_json(F.struct("event_id", "event_type", "user_id")), _folder(spark)
    torn = F.when(F.col("event_id") % 50 == 0, F.expr("substring(line, 1, 18)")).otherwise(F.col("line"))
    table(spark, sf_dir, "events").withColumn("line", line).select(torn.alias("value")).write.text(path)
    entries = tables.audit_entries(spark, path, "event_id long, event_type string, user_id long")
    return entries.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@R.add("type_change_verdicts", f"""WITH {RAW_SQL} SELECT 'value' AS "column", 'number' AS data_type, CASE WHEN COUNT(*) FILTER (value IS NOT NULL AND TRY_CAST(value AS DOUBLE) IS NULL) > 0 THEN 'refused' ELSE 'absorbed' END AS verdict FROM raw
UNION ALL SELECT 'day', 'date', CASE WHEN COUNT(*) FILTER (NOT regexp_matches(day, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')) > 0 THEN 'refused' ELSE 'absorbed' END FROM raw
UNION ALL SELECT 'event_id', 'integer', CASE WHEN COUNT(*) FILTER (event_id IS NULL) < 0 THEN 'refused' ELSE 'absorbed' END FROM raw""")
def type_change_verdicts(spark, sf_dir) -> DataFrame:
    raw = _raw_events(spark, sf_dir).withColumn("event_id", F.col("event_id").cast("string"))
    return changes.type_change_verdicts(drift(raw, {"value": "number", "day": "date", "event_id": "integer"}))


@R.add("integrity_footers", """SELECT 'orders' AS "table", 'missing column o_gone' AS finding, CAST(COUNT(*) AS BIGINT) AS rows FROM orders UNION ALL SELECT 'returns', 'declared but missing', NULL""")
def integrity_footers(spark, sf_dir) -> DataFrame:
    """Tables, columns and rows of a lake held against what is declared, without a scan."""
    lake = _lake(spark)
    with lake.together() as now:
        for name in ("orders", "customer"):
            now.publish(name, table(spark, sf_dir, name))
    declared = {"orders": ["o_orderkey", "o_gone"], "customer": ["c_custkey"], "returns": ["r_id"]}
    return spark.createDataFrame(tables.lake_findings(lake.generation(), declared), "table string, finding string, rows long")
