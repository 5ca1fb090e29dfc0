"""Queries over watches, metrics, notifications, freshness, and their streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edits, watch
from ..session import shared_folder
from ..sources import tables
from ..streaming import incremental, watching
from .bindings import LOG_SQL, REQUESTS_SQL, request_log, table, write_log
from .registry import Registry

R = Registry()
NOW = "timestamp '2024-01-28 00:00:00'"

COUNTS_SQL = """b AS (SELECT event_type AS condition, 'user_' || (user_id % 10) AS user_id, CAST(COUNT(*) AS BIGINT) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
a AS (SELECT event_type AS condition, 'user_' || (user_id % 10) AS user_id, CAST(COUNT(*) AS BIGINT) AS n FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 1 GROUP BY 1, 2),
w AS (SELECT a.condition, a.user_id, a.n, CASE WHEN a.n > 130 AND b.n <= 130 THEN 'above' WHEN a.n > 130 THEN 'still above' END AS verdict FROM a JOIN b USING (condition, user_id) WHERE a.n <> b.n)"""


def _watched(spark, sf_dir, threshold: int | None) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("condition", F.col("event_type")).withColumn("user_id", F.concat(F.lit("user_"), F.col("user_id") % 10))
    count = lambda rows: rows.groupBy("condition", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return watch.count_watch(count(e.filter("event_id % 2 = 0")), count(e.filter("event_id % 3 <> 0 or event_id % 2 = 1")), threshold)


@R.add("count_watch", f"WITH {COUNTS_SQL} SELECT condition, user_id, n, verdict FROM w WHERE verdict IS NOT NULL")
def count_watch(spark, sf_dir) -> DataFrame:
    return _watched(spark, sf_dir, 130)


@R.add("count_watch_changes", f"WITH {COUNTS_SQL} SELECT a.condition, a.user_id, a.n, CASE WHEN a.n > b.n THEN 'gained ' || (a.n - b.n) ELSE 'fell ' || (b.n - a.n) END AS verdict FROM a JOIN b USING (condition, user_id) WHERE a.n <> b.n AND NOT (a.condition = 'click' AND a.n > b.n)")
def count_watch_changes(spark, sf_dir) -> DataFrame:
    """Gains and falls that have not been sent yet; those of clicks that gained have."""
    fired = _watched(spark, sf_dir, None)
    return watch.unrepeated(fired, fired.filter("condition = 'click' and verdict like 'gained%'").select("condition", "user_id", "verdict"))


REDEFINED_SQL = """b AS (SELECT event_type AS condition, CAST(user_id AS VARCHAR) AS user_id, 'v1' AS definition, CAST(COUNT(*) AS BIGINT) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2),
a AS (SELECT event_type AS condition, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_type = 'error' THEN 'v2' ELSE 'v1' END AS definition, CAST(COUNT(*) AS BIGINT) AS n FROM events WHERE event_type <> 'click' GROUP BY 1, 2)"""


def _redefined(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Counts up to a day and up to now; by then errors are counted under a new definition and clicks no longer."""
    e = table(spark, sf_dir, "events").withColumn("condition", F.col("event_type")).withColumn("user_id", F.col("user_id").cast("string"))
    count = lambda rows: rows.groupBy("condition", "user_id", "definition").agg(F.count(F.lit(1)).alias("n"))
    before = count(e.filter("ts < timestamp '2024-01-20 00:00:00'").withColumn("definition", F.lit("v1")))
    return before, count(e.filter("event_type <> 'click'").withColumn("definition", F.when(F.col("condition") == "error", "v2").otherwise("v1")))


@R.add("watch_redefined", f"WITH {REDEFINED_SQL} SELECT condition, user_id, a.n, CASE WHEN a.n > b.n THEN 'gained ' || (a.n - b.n) ELSE 'fell ' || (b.n - a.n) END AS verdict FROM a JOIN b USING (condition, user_id) WHERE a.n <> b.n AND a.definition = b.definition")
def watch_redefined(spark, sf_dir) -> DataFrame:
    return watch.count_watch(*_redefined(spark, sf_dir))


@R.add("watch_baseline", f"WITH {REDEFINED_SQL} SELECT condition, user_id, definition, n FROM a UNION ALL SELECT condition, user_id, definition, n FROM b WHERE condition NOT IN (SELECT condition FROM a)")
def watch_baseline(spark, sf_dir) -> DataFrame:
    return watch.baseline(*_redefined(spark, sf_dir))


@R.add("trigger_proposals", "WITH n AS (SELECT user_id, COUNT(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS request_id, event_id AS object_id FROM events JOIN n USING (user_id) WHERE event_type = 'error' AND n > 12")
def trigger_proposals(spark, sf_dir) -> DataFrame:
    """Users with more than twelve errors fire; each error becomes a sub-write of a proposed action."""
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'")
    fired = errors.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 12").select("user_id")
    requests = errors.join(fired, "user_id").groupBy(F.col("user_id").cast("string").alias("request_id")).agg(F.collect_list("event_id").alias("object_ids"))
    found = edits.propose(requests.withColumn("parameters", F.create_map(F.lit("reason"), F.lit("errors"))), ["reason"], 1_000_000)
    return found.filter("problem is null").select("request_id", "object_id")


RED_SQL = f"""{REQUESTS_SQL}, ok AS (SELECT {{by}} AS k, duration_ms, ROW_NUMBER() OVER (PARTITION BY {{by}} ORDER BY duration_ms) - 1 AS r, COUNT(*) OVER (PARTITION BY {{by}}) AS n FROM requests WHERE status < 400 AND duration_ms IS NOT NULL),
p AS (SELECT k, MIN(duration_ms) FILTER (r = LEAST(CAST(floor(n * 0.5) AS BIGINT), n - 1)) AS p50, MIN(duration_ms) FILTER (r = LEAST(CAST(floor(n * 0.99) AS BIGINT), n - 1)) AS p99 FROM ok GROUP BY 1),
a AS (SELECT {{by}} AS k, COUNT(*) AS n, COUNT(*) FILTER (status >= 400) AS errors FROM requests GROUP BY 1)"""


@R.add("red_summary", "WITH " + RED_SQL.format(by="route") + " SELECT k AS route, CAST(n AS BIGINT) AS n, CAST(errors AS BIGINT) AS errors, CAST(errors AS DOUBLE) / n AS error_ratio, p50, p99 FROM a LEFT JOIN p USING (k)")
def red_summary(spark, sf_dir) -> DataFrame:
    return watch.red(request_log(spark, sf_dir), ["route"])


@R.add("red_by_day", "WITH " + RED_SQL.format(by="strftime(at_, '%Y-%m-%d')") + " SELECT k AS day, CAST(n AS BIGINT) AS n, CAST(errors AS BIGINT) AS errors, CAST(errors AS DOUBLE) / n AS error_ratio, p50, p99 FROM a LEFT JOIN p USING (k)")
def red_by_day(spark, sf_dir) -> DataFrame:
    return watch.red(request_log(spark, sf_dir).withColumn("day", F.date_format(F.window("at", "1 day")["start"], "yyyy-MM-dd")), ["day"])


@R.add("slowest_routes", "WITH " + RED_SQL.format(by="route") + " SELECT k AS route, p99 FROM a LEFT JOIN p USING (k) ORDER BY p99 DESC NULLS LAST, k LIMIT 5")
def slowest_routes(spark, sf_dir) -> DataFrame:
    return watch.slowest(request_log(spark, sf_dir)).select("route", "p99")


@R.add("metrics_retention", f"WITH {REQUESTS_SQL} SELECT request_id FROM requests WHERE at_ >= TIMESTAMP '2024-01-28' - INTERVAL 10 DAY")
def metrics_retention(spark, sf_dir) -> DataFrame:
    return watch.retained(request_log(spark, sf_dir), "at", F.expr(NOW), 10).select("request_id")


@R.add("notifications_top", "SELECT user_id, event_id AS notification_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place, CAST(COUNT(*) FILTER (event_id % 4 <> 0) OVER (PARTITION BY user_id) AS BIGINT) AS unseen FROM events QUALIFY place <= 50")
def notifications_top(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("notification_id"), "user_id", F.col("ts").alias("created_at"), (F.col("event_id") % 4 == 0).alias("seen"))
    return watch.notifications(rows)


@R.add("request_trace", "SELECT event_id AS entry_id FROM events WHERE user_id = 7 AND event_type = 'view'")
def request_trace(spark, sf_dir) -> DataFrame:
    entries = table(spark, sf_dir, "events").select(F.col("event_id").alias("entry_id"), F.col("ts").alias("at"), "user_id", F.col("event_type").alias("request_id"))
    return watch.request_trace(entries, 7, "view").select("entry_id")


def _attempts(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("t"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")).alias("table"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("attempt_id"),
        F.when(F.col("event_type") == "error", "refused").otherwise("synced").alias("outcome"),
    )


ATTEMPTS_SQL = "l AS (SELECT 't' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS \"table\", arg_max(CASE WHEN event_type = 'error' THEN 'refused' ELSE 'synced' END, (ts, event_id)) AS outcome, MAX(ts) AS at_ FROM events GROUP BY 1)"


@R.add("last_attempts", f"WITH {ATTEMPTS_SQL} SELECT \"table\", outcome FROM l")
def last_attempts(spark, sf_dir) -> DataFrame:
    return tables.last_attempts(_attempts(spark, sf_dir)).select("table", "outcome")


@R.add("health", f"WITH {ATTEMPTS_SQL}, x AS (SELECT *, at_ < TIMESTAMP '2024-02-01' - INTERVAL 49 HOUR AS stale FROM l) SELECT CAST(COUNT(*) FILTER (outcome = 'refused') AS BIGINT) AS refused, CAST(COUNT(*) FILTER (stale) AS BIGINT) AS stale, array_to_string(list_sort(list(\"table\") FILTER (outcome = 'refused' OR stale))[1:3], ',') AS names FROM x")
def health(spark, sf_dir) -> DataFrame:
    return tables.health(tables.last_attempts(_attempts(spark, sf_dir)), F.lit("2024-02-01 00:00:00").cast("timestamp"), 49)


def _publications(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("t"), F.col("o_orderkey") % 30).alias("table"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("published_at"))


@R.add("freshness", "SELECT 't' || (o_orderkey % 30) AS \"table\", strftime(MAX(o_orderdate), '%Y-%m-%d') AS published FROM orders GROUP BY 1")
def freshness(spark, sf_dir) -> DataFrame:
    return tables.freshness(_publications(spark, sf_dir)).select("table", F.date_format("published_at", "yyyy-MM-dd").alias("published"))


@R.add("publication_retention", "SELECT 't' || (o_orderkey % 30) AS \"table\", o_orderkey AS version FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderkey % 30 ORDER BY o_orderkey DESC) > 30")
def publication_retention(spark, sf_dir) -> DataFrame:
    return tables.forgotten(_publications(spark, sf_dir)).select("table", "version")


def _replayed(spark, rows: DataFrame, files: int) -> tuple[str, str]:
    """rows written as files for a stream to read, and a place for its checkpoint and results."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.repartition(files).write.parquet(f"{root}/in")
    return f"{root}/in", root


@R.add("tombstones_stream", f"WITH {LOG_SQL} SELECT object_id FROM log WHERE status = 'applied' GROUP BY 1 HAVING arg_max(operation, (created_at, id)) = 'delete'")
def tombstones_stream(spark, sf_dir) -> DataFrame:
    log = write_log(spark, sf_dir).drop("batch_id")
    source, root = _replayed(spark, log, 4)
    index = incremental.tombstone_index(spark, f"{root}/index")
    incremental.index_applied(incremental.stream(spark, source, log._jdf.schema().toDDL(), 2), index, f"{root}/checkpoint")
    return index.read().filter("operation = 'delete'").select("object_id")


@R.add("red_stream", f"WITH {REQUESTS_SQL} SELECT strftime(at_, '%Y-%m-%d') AS day, route, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(*) FILTER (status >= 400) AS BIGINT) AS errors FROM requests GROUP BY 1, 2")
def red_stream(spark, sf_dir) -> DataFrame:
    requests = request_log(spark, sf_dir)
    source, root = _replayed(spark, requests, 4)
    index = incremental.red_index(spark, f"{root}/index")
    incremental.index_red(incremental.stream(spark, source, requests._jdf.schema().toDDL(), 2), index, f"{root}/checkpoint", late="60 days")  # the log covers a month, in no order
    return index.read().select(F.date_format("start", "yyyy-MM-dd").alias("day"), "route", "n", "errors")


DAILY_SQL = """c AS (SELECT event_type AS condition, 'user_' || (user_id % 10) AS user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS at_, CASE WHEN event_type = 'error' AND ts >= TIMESTAMP '2024-01-20' THEN 'v2' ELSE 'v1' END AS definition, CAST(COUNT(*) AS BIGINT) AS n FROM events GROUP BY 1, 2, 3, 4),
w AS (SELECT *, LAG(n) OVER (PARTITION BY condition, user_id, definition ORDER BY at_) AS was FROM c),
f AS (SELECT condition, user_id, at_, n, CASE WHEN n > was THEN 'gained ' || (n - was) ELSE 'fell ' || (was - n) END AS verdict FROM w WHERE n <> was)"""


@R.add("watch_stream", f"WITH {DAILY_SQL} SELECT condition, user_id, strftime(at_, '%Y-%m-%d') AS day, n, verdict FROM f QUALIFY verdict IS DISTINCT FROM LAG(verdict) OVER (PARTITION BY condition, user_id ORDER BY at_)")
def watch_stream(spark, sf_dir) -> DataFrame:
    """The events' counts by day as they come in, in three stretches of time with a restart between them; errors are counted under a new definition from a day on."""
    e = table(spark, sf_dir, "events").withColumn("condition", F.col("event_type")).withColumn("user_id", F.concat(F.lit("user_"), F.col("user_id") % 10))
    day = F.date_trunc("day", "ts")
    counts = e.groupBy("condition", "user_id", day.alias("at")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "definition", F.when((F.col("condition") == "error") & (F.col("at") >= F.expr("timestamp '2024-01-20'")), "v2").otherwise("v1")
    ).select("condition", "user_id", "definition", "at", "n")
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    days = ["2024-01-10", "2024-01-20", "9999-01-01"]
    before = "0001-01-01"
    watching.keeps_state(spark)
    for until in days:
        counts.filter((F.col("at") >= F.lit(before).cast("timestamp")) & (F.col("at") < F.lit(until).cast("timestamp"))).write.mode("append").parquet(f"{root}/in")
        fired = watching.watch_stream(incremental.stream(spark, f"{root}/in", counts._jdf.schema().toDDL()))
        incremental.run_to_end(fired, f"{root}/checkpoint", lambda rows, batch: rows.write.mode("overwrite").parquet(f"{root}/out/batch={batch}"))
        before = until
    found = spark.read.schema(watching.FIRED).parquet(f"{root}/out")
    return found.select("condition", "user_id", F.date_format("at", "yyyy-MM-dd").alias("day"), "n", "verdict")
