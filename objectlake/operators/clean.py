"""Constraints, expectations, duplicates and lineage."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import coerce

POLICIES = ("warn", "quarantine", "fail")


@dataclass(frozen=True)
class Constraint:
    """min, max, min_length, max_length, pattern (of the whole value), one_of or required, in the declared type."""

    field: str
    kind: str
    value: Any = None
    data_type: str = "string"
    policy: str = "warn"

    def broken(self) -> Column:
        """True where a value breaks it. NULL breaks required alone."""
        c = F.col(self.field)
        literal = lambda v: coerce(F.lit(str(v)), self.data_type)
        bad = {
            "required": lambda: c.isNull(),
            "min": lambda: c < literal(self.value),
            "max": lambda: c > literal(self.value),
            "min_length": lambda: F.length(c.cast("string")) < self.value,
            "max_length": lambda: F.length(c.cast("string")) > self.value,
            "pattern": lambda: ~c.cast("string").rlike(rf"\A(?:{self.value})\z"),
            "one_of": lambda: ~c.isin([literal(v) for v in self.value]),
        }[self.kind]()
        return F.coalesce(bad, F.lit(False))


BROKEN = "array<struct<field string, reason string, policy string>>"


def violations(constraints: list[Constraint]) -> Column:
    """An array of struct(field, reason, policy), one for each constraint that a row breaks; empty without constraints."""
    if not constraints:
        return F.from_json(F.lit("[]"), BROKEN)
    return F.array_compact(F.array(*[
        F.when(k.broken(), F.struct(F.lit(k.field).alias("field"), F.lit(k.kind).alias("reason"), F.lit(k.policy).alias("policy"))) for k in constraints
    ]))


class ExpectationFailed(ValueError):
    """A rule of policy fail is broken."""


def expectations(rows: DataFrame, constraints: list[Constraint]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept rows, quarantined rows (one for each quarantine rule broken), and counts by rule.

    Warnings on quarantined rows are not counted. A broken fail rule raises before anything else runs.
    """
    judged = rows.withColumn("_broken", violations(constraints))
    if any(k.policy == "fail" for k in constraints):
        worst = judged.filter(F.exists("_broken", lambda v: v["policy"] == "fail")).limit(1).collect()
        if worst:
            raise ExpectationFailed(str(worst[0]["_broken"]))
    held = F.exists("_broken", lambda v: v["policy"] == "quarantine")
    quarantined = judged.filter(held).withColumn("_rule", F.explode(F.filter("_broken", lambda v: v["policy"] == "quarantine")))
    warned = judged.filter(~held).select(F.explode("_broken").alias("_rule"))
    counts = quarantined.select("_rule").unionByName(warned).groupBy("_rule.field", "_rule.reason", "_rule.policy").agg(F.count(F.lit(1)).alias("n"))
    return judged.filter(~held).drop("_broken"), quarantined.drop("_broken"), counts


def split_duplicates(rows: DataFrame, key: list[str], keep_last_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is theirs alone, and the others. NULL keys are a group as well.

    With keep_last_by, the row with the greatest value of it is kept, provided that the group's values
    are all there and all different; a group of which that is not so goes to the others as a whole.

    Keys are counted before they are joined back, so that no group, NULL's neither, gathers in one task.
    """
    names = {c: f"_key_{i}" for i, c in enumerate(key)}
    renamed = [F.col(c).alias(name) for c, name in names.items()]
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(name)) for c, name in names.items()])
    if keep_last_by is None:
        counts = rows.groupBy(*renamed).agg(F.count(F.lit(1)).alias("_n"))
        counted = rows.join(counts, same).drop(*names.values())
        return counted.filter("_n = 1").drop("_n"), counted.filter("_n > 1").drop("_n")
    c = F.col(keep_last_by)
    # Nearly every row has a key and value of its own: counting before the shuffle would hold a task's whole input.
    dealt = rows.select(*renamed, c.alias("_value")).repartition(*names.values(), "_value")
    values = dealt.groupBy(*names.values(), "_value").agg(F.count(F.lit(1)).alias("_times"))
    groups = values.groupBy(*names.values()).agg(
        F.sum("_times").alias("_n"), F.max("_value").alias("_last"), ((F.max("_times") == 1) & (F.count("_value") == F.count(F.lit(1)))).alias("_clear")
    )
    kept = (F.col("_n") == 1) | (F.col("_clear") & F.coalesce(c == F.col("_last"), F.lit(False)))
    marks = [*names.values(), "_n", "_last", "_clear"]
    ranked = rows.join(groups, same)
    return ranked.filter(kept).drop(*marks), ranked.filter(~kept).drop(*marks)


def join_surrogate(*columns: str) -> Column:
    """A join table's row id: its values joined by the unit separator, NULL as nothing."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def with_lineage(rows: DataFrame, silo: str, table: str) -> DataFrame:
    """_silo, _source_table and _row_hash: 32 hex digits over the sorted columns, their names and values."""
    values = F.concat_ws("\x1e", *[
        F.concat(F.lit(f"{c}\x1f"), F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))) for c in sorted(rows.columns)
    ])
    return rows.withColumns({"_silo": F.lit(silo), "_source_table": F.lit(table), "_row_hash": F.substring(F.sha2(values, 256), 1, 32)})


def quarantine_report(held: DataFrame, table: str) -> DataFrame:
    """One row for a table: distinct objects held, findings, worst reason (most findings, then by name), last detected.

    held: object_id, reason, detected_at.
    """
    by = held.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.max("detected_at").alias("last"))
    worst = by.agg(F.sum("n").alias("findings"), F.max_by("reason", F.struct("n", F.col("reason"))).alias("worst"), F.max("last").alias("last_detected"))
    objects = held.agg(F.countDistinct("object_id").alias("objects"))
    return objects.crossJoin(worst).select(F.lit(table).alias("table"), "objects", "findings", "worst", "last_detected")  # one row by one row
