"""Watches, request metrics, notifications and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_watch(before: DataFrame, now: DataFrame, threshold: int | None = None) -> DataFrame:
    """condition, user_id, verdict of changed counts; both: condition, user_id, n.

    Without an earlier count nothing is said. With a threshold: above when it is passed, still above
    when the count then changes; else gained or fell. Where both have a definition of the condition, a
    count taken under another definition is no earlier count, so that a changed condition says nothing.
    """
    keys = ["condition", "user_id", *(c for c in ("definition",) if c in before.columns and c in now.columns)]
    both = now.join(before.withColumnRenamed("n", "was"), keys, "left").filter("was is not null and n <> was")
    verdict = F.when(F.col("n") > F.col("was"), F.concat(F.lit("gained "), F.col("n") - F.col("was"))).otherwise(F.concat(F.lit("fell "), F.col("was") - F.col("n")))
    if threshold is not None:
        above = F.col("n") > threshold
        verdict = F.when(above & (F.col("was") <= threshold), "above").when(above, "still above")
    return both.withColumn("verdict", verdict).filter("verdict is not null").select("condition", "user_id", "n", "verdict")


def baseline(before: DataFrame, now: DataFrame) -> DataFrame:
    """The counts that the next run compares with: this run's, and earlier ones of conditions not counted in it.

    Both: condition, user_id, definition, n. A condition counted under a new definition starts anew.
    """
    counted = now.select("condition").distinct()
    columns = ["condition", "user_id", "definition", "n"]
    return now.select(columns).unionByName(before.select(columns).join(counted, "condition", "left_anti"))


def unrepeated(fired: DataFrame, notified: DataFrame) -> DataFrame:
    """Those whose (condition, user_id, verdict) has not been sent."""
    return fired.join(notified, ["condition", "user_id", "verdict"], "left_anti")


def red(requests: DataFrame, by: list[str]) -> DataFrame:
    """n, errors (status 400 or more), error_ratio, p50 and p99 of successes; requests: status, duration_ms and by.

    A percentile is a request's own duration, the one at rank min(int(n f), n - 1).
    """
    ok = requests.filter("status < 400 and duration_ms is not null")
    # Equal durations are counted before they are put in order, so a busy group is ordered by its distinct durations.
    counted = ok.groupBy(*by, "duration_ms").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by)
    upto = F.sum("_c").over(w.orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(w))
    at = lambda f: F.least(F.floor(F.col("_n") * f), F.col("_n") - 1)
    tails = placed.groupBy(*by).agg(*[F.min(F.when(F.col("_upto") > at(f), F.col("duration_ms"))).alias(name) for f, name in ((0.5, "p50"), (0.99, "p99"))])
    all_ = requests.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 400).alias("errors"))
    return all_.join(tails, by, "left").withColumn("error_ratio", F.col("errors") / F.col("n"))


def slowest(requests: DataFrame, route: str = "route", top: int = 5) -> DataFrame:
    return red(requests, [route]).orderBy(F.desc_nulls_last("p99"), route).limit(top)


def retained(rows: DataFrame, at: str, now: Column, days: int = 30) -> DataFrame:
    """Rows no older than so many days."""
    return rows.filter(F.col(at) >= now - F.expr(f"interval {days} days"))


def notifications(rows: DataFrame, top: int = 50) -> DataFrame:
    """The newest of each user, with the user's unseen count over all of them. rows: notification_id, user_id, created_at, seen."""
    w = Window.partitionBy("user_id")
    placed = rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("created_at"), F.desc("notification_id"))))
    unseen = rows.groupBy("user_id").agg(F.count_if(~F.col("seen")).alias("unseen"))
    return placed.filter(F.col("place") <= top).join(unseen, "user_id").select("user_id", "notification_id", "place", "unseen")


def request_trace(entries: DataFrame, user_id, request_id) -> DataFrame:
    """A user's own access entries for a request, in order."""
    return entries.filter((F.col("user_id") == user_id) & (F.col("request_id") == request_id)).orderBy("at", "entry_id")
