"""Reading sources; fingerprints, audits, integrity, health, freshness and retention of tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lake import AuditFailed, Generation, Lake

__all__ = ["AuditFailed", "Lake"]


def read(spark: SparkSession, kind: str, path: str, columns: list[str] | None = None, schema: str | None = None, key: str | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A source by format (parquet, csv, json, orc, jdbc, ...), named columns only.

    For jdbc, path is the URL and the option dbtable the table; with a key, a number column, its least and
    greatest values are asked first and the table is read in parts by ranges of it.
    """
    reader = spark.read.format(kind).options(**options)
    if schema:
        reader = reader.schema(schema)
    if kind != "jdbc":
        rows = reader.load(path)
    else:
        if key:
            asked = {k: v for k, v in options.items() if k != "dbtable"} | {"url": path, "query": f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {options['dbtable']}"}
            low, high = spark.read.format("jdbc").options(**asked).load().first()
            if low is not None:
                reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts))
        rows = reader.option("url", path).load()
    return rows.select(*columns) if columns else rows


def columns_present(rows: DataFrame) -> set[str]:
    return set(rows.columns)


def source_types(rows: DataFrame) -> dict[str, str]:
    return dict(rows.dtypes)


def audit_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; torn lines are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def as_bronze(rows: DataFrame) -> DataFrame:
    """Every column as text."""
    return rows.select([F.col(c).cast("string").alias(c) for c in rows.columns])


def union_by_name(*parts: DataFrame) -> DataFrame:
    """Additive schema evolution: what a part lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def fingerprint(rows: DataFrame) -> DataFrame:
    """n and a sum of row hashes, alike for alike rows in any order."""
    columns = sorted(rows.columns)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("content"))


def unchanged(a: DataFrame, b: DataFrame) -> bool:
    """Same columns and same rows. The fingerprints tell most differences; equality is then confirmed."""
    if set(a.columns) != set(b.columns) or fingerprint(a).first() != fingerprint(b).first():
        return False
    n = "_objectlake_n"
    both = a.withColumn(n, F.lit(1)).unionByName(b.withColumn(n, F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum(n).alias(n)).filter(f"{n} <> 0").isEmpty()


def bulk_rows(rows: DataFrame, id_column: str) -> DataFrame:
    """A transaction for each row, for scale tests: two owners, amounts 10 + id, five categories."""
    i = F.col(id_column)
    return rows.select(
        i.alias("id"), F.when(i % 2 == 0, "owner-a").otherwise("owner-b").alias("owner"), (i + 10).alias("amount"), F.concat(F.lit("bulk-"), i % 5).alias("category")
    )


def recent_snapshots(log: DataFrame, keep: int = 5) -> DataFrame:
    """Each table's newest publications, and which one is current. log: table, version, published_at, rows, operation."""
    w = Window.partitionBy("table").orderBy(F.desc("version"))
    return log.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep).withColumn("current", F.col("place") == 1)


def forgotten(log: DataFrame, keep: int = 30) -> DataFrame:
    """Publications beyond the newest keep of a table."""
    w = Window.partitionBy("table").orderBy(F.desc("version"))
    return log.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") > keep).drop("_place")


def audit(rows: DataFrame, key: str, required: list[str], links: dict[str, tuple[DataFrame, str]], previous_rows: int | None = None) -> DataFrame:
    """problem, n: missing ids, duplicate ids, missing required fields, dangling links, a shrink below half.

    links: field to (target rows, target id). Only problems that occur have a row.
    """
    wide = rows.agg(F.count_if(F.col(key).isNull()).alias("missing id"), *[F.count_if(F.col(f).isNull()).alias(f"missing {f}") for f in required], F.count(F.lit(1)).alias("_n"))
    names = ["missing id", *[f"missing {f}" for f in required]]
    found = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("problem"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")
    doubled = rows.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate id").alias("problem"), "n")
    found = found.unionByName(doubled)
    for f, (target, target_id) in links.items():
        loose = rows.filter(F.col(f).isNotNull()).join(target.select(F.col(target_id).alias(f)), f, "left_anti").agg(F.count(F.lit(1)).alias("n"))
        found = found.unionByName(loose.select(F.lit(f"dangling {f}").alias("problem"), "n"))
    if previous_rows is not None:
        found = found.unionByName(wide.select(F.lit("shrunk").alias("problem"), F.when(F.col("_n") < 0.5 * previous_rows, F.lit(previous_rows) - F.col("_n")).otherwise(0).alias("n")))
    return found.filter("n > 0")


@contextmanager
def from_footers(spark: SparkSession) -> Iterator[None]:
    """Counts of Parquet tables that are read and counted inside come from file footers; no data page is read."""
    wanted = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def footer_count(rows: DataFrame) -> DataFrame:
    """n, by the footers alone; to be built and collected inside from_footers."""
    return rows.groupBy().count().withColumnRenamed("count", "n")


def lake_findings(now: Generation, declared: dict[str, list[str]]) -> list[tuple[str, str, int | None]]:
    """(table, finding, rows) of declared tables and their columns, from manifests and file footers.

    A table that isn't there, a file that can't be read, a declared column that no file has, and other
    rows than were published each give a finding. One row for each table comes to the driver.
    """
    out: list[tuple[str, str, int | None]] = []
    with from_footers(now.lake.spark):
        for name, columns in declared.items():
            if now.entry(name) is None:
                out.append((name, "declared but missing", None))
                continue
            try:
                rows = now.read(name)
                n = footer_count(rows).first()["n"]
            except Exception as e:
                if not re.search("not a Parquet file|CANNOT_READ|FAILED_READ_FILE|PATH_NOT_FOUND|does not exist|UNABLE_TO_INFER_SCHEMA|FileNotFound", str(e)):
                    raise
                out.append((name, "unreadable", None))
                continue
            out += [(name, f"missing column {c}", n) for c in columns if c not in columns_present(rows)]
            if n != now.entry(name)["rows"]:
                out.append((name, "other rows than published", n))
    return out


def integrity(inventory: DataFrame, declared: DataFrame) -> DataFrame:
    """table, finding. inventory: table, layer, rows; declared: table.

    Silver without bronze, silver with other than bronze's rows, declared tables missing, tables nobody declared.
    """
    by = inventory.groupBy("table").agg(F.max(F.when(F.col("layer") == "bronze", F.col("rows"))).alias("bronze"), F.max(F.when(F.col("layer") == "silver", F.col("rows"))).alias("silver"))
    both = by.withColumn("_there", F.lit(True)).join(declared.select("table").withColumn("_wanted", F.lit(True)), "table", "full")
    finding = (
        F.when(F.col("_there").isNull(), "declared but missing").when(F.col("_wanted").isNull(), "not declared")
        .when(F.col("silver").isNotNull() & F.col("bronze").isNull(), "silver without bronze")
        .when(F.col("silver") > F.col("bronze"), "silver has more rows").when(F.col("silver") < F.col("bronze"), "silver has fewer rows")
    )
    return both.select("table", finding.alias("finding")).filter("finding is not null")


def last_attempts(attempts: DataFrame) -> DataFrame:
    """Each table's last sync attempt. attempts: table, at, attempt_id, outcome."""
    return attempts.groupBy("table").agg(F.max_by("outcome", F.struct("at", "attempt_id")).alias("outcome"), F.max("at").alias("at"))


def health(last: DataFrame, now, stale_hours: int = 25) -> DataFrame:
    """One row: tables whose last attempt was refused, tables stale, and the first three names of either."""
    stale = F.col("at") < now - F.expr(f"interval {stale_hours} hours")
    bad = (F.col("outcome") == "refused") | stale
    return last.agg(
        F.count_if(F.col("outcome") == "refused").alias("refused"), F.count_if(stale).alias("stale"),
        F.array_join(F.slice(F.array_sort(F.collect_list(F.when(bad, F.col("table")))), 1, 3), ",").alias("names"),
    )


def freshness(log: DataFrame) -> DataFrame:
    """table and when it was last published."""
    return log.groupBy("table").agg(F.max("published_at").alias("published_at"))
