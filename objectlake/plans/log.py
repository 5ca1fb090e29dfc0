"""Queries over the write log: overlay, history, proposals, approvals, applying."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import actions, changes, edits, secure
from .bindings import LOG_SQL, ONTOLOGY, loader, table, users, write_log
from .registry import Registry

R = Registry()
SINCE = "timestamp '2024-01-20 00:00:00'"
FIELD_ROWS = f"WITH {LOG_SQL}, f AS (SELECT * FROM log WHERE field IS NOT NULL)"
LAST = "SELECT object_id, field, arg_max(field_value, (created_at, id)) AS value FROM f WHERE {} AND operation <> 'delete' GROUP BY 1, 2"


def _fields(rows: DataFrame) -> DataFrame:
    return rows.select("object_id", F.explode("changes").alias("field", "value"))


@R.add("pending", f"{FIELD_ROWS} {LAST.format(chr(39).join(['status = ', 'pending', '']))}")
def pending(spark, sf_dir) -> DataFrame:
    return _fields(edits.pending(write_log(spark, sf_dir)))


@R.add("applied_since", f"{FIELD_ROWS} {LAST.format(chr(39).join(['status = ', 'applied', ' AND created_at >= TIMESTAMP ', '2024-01-20', '']))}")
def applied_since(spark, sf_dir) -> DataFrame:
    return _fields(edits.applied_since(write_log(spark, sf_dir), F.expr(SINCE)))


@R.add("all_pending", f"WITH {LOG_SQL}, own AS (SELECT object_id FROM log WHERE status = 'pending' AND id % 20 = 0), flat AS (SELECT CAST(event_id AS VARCHAR) AS object_id FROM events WHERE event_id // 3 IN (SELECT id FROM log WHERE status = 'pending' AND id % 20 = 10)) SELECT object_id, false AS batched, CAST(COUNT(*) AS BIGINT) AS n FROM own GROUP BY 1 UNION ALL SELECT object_id, true, COUNT(*) FROM flat WHERE object_id NOT IN (SELECT object_id FROM own) GROUP BY 1")
def all_pending(spark, sf_dir) -> DataFrame:
    """Every second pending entry stands for a batch; each event is a sub-write of the batch of a third of its id."""
    log = write_log(spark, sf_dir).withColumn("batch_id", F.when(F.col("id") % 20 == 10, F.concat(F.lit("b"), "id")))
    sub = table(spark, sf_dir, "events").select(
        F.concat(F.lit("b"), F.floor(F.col("event_id") / 3)).alias("batch_id"), F.lit("Customer").alias("object_type"), F.col("event_id").cast("string").alias("object_id"), F.lit("{}").alias("changes"),
    )
    return edits.all_pending(log, sub).groupBy("object_id", "batched").agg(F.count(F.lit(1)).alias("n"))


TOMBS = "t AS (SELECT object_id FROM log WHERE status = 'applied' GROUP BY 1 HAVING arg_max(operation, (created_at, id)) = 'delete')"


@R.add("tombstones", f"WITH {LOG_SQL}, {TOMBS} SELECT object_id FROM t")
def tombstones(spark, sf_dir) -> DataFrame:
    return edits.tombstones(write_log(spark, sf_dir)).select("object_id")


@R.add("overlay", f"""{FIELD_ROWS}, {TOMBS}, p AS ({LAST.format("status = 'pending'")}), a AS ({LAST.format("status = 'applied' AND created_at >= TIMESTAMP '2024-01-20'")}),
ids AS (SELECT CAST(c_custkey AS VARCHAR) AS object_id FROM customer UNION SELECT object_id FROM log WHERE operation = 'create' AND status IN ('pending', 'applied'))
SELECT i.object_id, COALESCE(pb.value, ab.value, CAST(c.c_mktsegment AS VARCHAR)) AS c_mktsegment, COALESCE(TRY_CAST(pa.value AS DOUBLE), TRY_CAST(aa.value AS DOUBLE), c.c_acctbal) AS c_acctbal
FROM ids i LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = i.object_id
LEFT JOIN p pa ON pa.object_id = i.object_id AND pa.field = 'c_acctbal' LEFT JOIN p pb ON pb.object_id = i.object_id AND pb.field = 'c_mktsegment'
LEFT JOIN a aa ON aa.object_id = i.object_id AND aa.field = 'c_acctbal' LEFT JOIN a ab ON ab.object_id = i.object_id AND ab.field = 'c_mktsegment'
WHERE i.object_id NOT IN (SELECT object_id FROM t)""")
def overlay(spark, sf_dir) -> DataFrame:
    return edits.overlay(table(spark, sf_dir, "customer"), "c_custkey", "Customer", write_log(spark, sf_dir), F.expr(SINCE), ["c_mktsegment", "c_acctbal"])


@R.add("overlay_search", f"""{FIELD_ROWS}, {TOMBS}, p AS ({LAST.format("status = 'pending'")}), a AS ({LAST.format("status = 'applied' AND created_at >= TIMESTAMP '2024-01-20'")}),
ids AS (SELECT CAST(c_custkey AS VARCHAR) AS object_id FROM customer UNION SELECT object_id FROM log WHERE operation = 'create' AND status IN ('pending', 'applied'))
SELECT i.object_id FROM ids i LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = i.object_id LEFT JOIN p ON p.object_id = i.object_id AND p.field = 'c_acctbal' LEFT JOIN a ON a.object_id = i.object_id AND a.field = 'c_acctbal'
WHERE i.object_id NOT IN (SELECT object_id FROM t) AND COALESCE(TRY_CAST(p.value AS DOUBLE), TRY_CAST(a.value AS DOUBLE), c.c_acctbal) < 20""")
def overlay_search(spark, sf_dir) -> DataFrame:
    """A search over the overlaid rows: edits bring objects in and take them out."""
    return overlay(spark, sf_dir).filter("c_acctbal < 20").select("object_id")


@R.add("edit_history", f"WITH {LOG_SQL} SELECT object_id, id, ROW_NUMBER() OVER (PARTITION BY object_id ORDER BY created_at DESC, id DESC) AS place, CAST(COUNT(*) OVER (PARTITION BY object_id) AS BIGINT) AS total, CASE WHEN field = 'c_acctbal' THEN 1 ELSE 0 END AS readable FROM log")
def edit_history(spark, sf_dir) -> DataFrame:
    found = edits.edit_history(write_log(spark, sf_dir), ["c_acctbal"])
    return found.select("object_id", "id", F.col("place").cast("long").alias("place"), "total", F.size("changes").alias("readable"))


@R.add("superseded", f"WITH {LOG_SQL}, l AS (SELECT object_id, MAX((created_at, id)) AS last FROM log WHERE status = 'applied' GROUP BY 1) SELECT log.id, COALESCE((created_at, id) < last, false) AS superseded FROM log LEFT JOIN l USING (object_id)")
def superseded(spark, sf_dir) -> DataFrame:
    return edits.superseded(write_log(spark, sf_dir))


@R.add("edits_by_field", f"{FIELD_ROWS} SELECT field, status, CAST(COUNT(*) AS BIGINT) AS n FROM f WHERE status IN ('applied', 'pending') GROUP BY 1, 2")
def edits_by_field(spark, sf_dir) -> DataFrame:
    return edits.edits_by_field(write_log(spark, sf_dir))


@R.add("drift_removed_column", f"{FIELD_ROWS} SELECT m.field, CASE WHEN m.field IN (SELECT field FROM f WHERE status IN ('applied', 'pending')) THEN 'refused' ELSE 'absorbed' END AS verdict FROM (VALUES ('c_acctbal'), ('c_comment')) m(field)")
def drift_removed_column(spark, sf_dir) -> DataFrame:
    missing = spark.createDataFrame([("c_acctbal",), ("c_comment",)], "field string")
    return changes.removed_column_verdicts(missing, edits.edits_by_field(write_log(spark, sf_dir)))


@R.add("fabricated_creates", f"WITH {LOG_SQL} SELECT id, object_id FROM log WHERE operation = 'create' AND status = 'applied' AND field IS NULL")
def fabricated_creates(spark, sf_dir) -> DataFrame:
    log = write_log(spark, sf_dir)
    return edits.fabricated_creates(log)


@R.add("undeclared_fields", f"{FIELD_ROWS} SELECT id, 'Customer' AS object_type, field FROM f WHERE field = 'c_phone'")
def undeclared_fields(spark, sf_dir) -> DataFrame:
    declared = spark.createDataFrame([("Customer", c) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")], "object_type string, field string")
    return edits.undeclared_fields(write_log(spark, sf_dir), declared)


@R.add("out_of_reach", """SELECT event_id AS write_id, CAST(user_id AS VARCHAR) AS object_id FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
JOIN region u ON u.r_regionkey = event_id % 5 WHERE region.r_name IS NULL OR region.r_name <> u.r_name""")
def out_of_reach(spark, sf_dir) -> DataFrame:
    own = users(spark, sf_dir).withColumnRenamed("security_value", "user_boundary")
    writes = write_log(spark, sf_dir).select(F.col("id").alias("write_id"), "object_id", "user_id").join(own, "user_id")
    here = secure.with_boundary(ONTOLOGY, "Customer", loader(spark, sf_dir)).select(F.col("c_custkey").cast("string").alias("object_id"), F.col(secure.BOUNDARY).alias("boundary"))
    return edits.out_of_reach(writes, here)


@R.add("proposals", """SELECT o_custkey AS request_id, CASE WHEN COUNT(*) > 18 THEN 'too many objects' WHEN o_custkey % 7 = 0 THEN 'missing amount' WHEN o_custkey % 11 = 0 THEN 'unknown note' END AS problem, CAST(COUNT(*) AS BIGINT) AS writes FROM orders GROUP BY 1""")
def proposals(spark, sf_dir) -> DataFrame:
    k = F.col("o_custkey")
    requests = table(spark, sf_dir, "orders").groupBy(k.alias("request_id")).agg(F.collect_list("o_orderkey").alias("object_ids"))
    r = F.col("request_id")
    parameters = F.when(r % 7 == 0, F.create_map(F.lit("reason"), F.lit("x"))).when(
        r % 11 == 0, F.create_map(F.lit("reason"), F.lit("x"), F.lit("amount"), F.lit("1"), F.lit("note"), F.lit("n"))
    ).otherwise(F.create_map(F.lit("reason"), F.lit("x"), F.lit("amount"), F.lit("1")))
    found = edits.propose(requests.withColumn("parameters", parameters), ["amount", "reason"], 18)
    return found.groupBy("request_id", "problem").agg(F.count(F.lit(1)).alias("writes"))


#: A customer asks for their orders to be moved to a status, and for a note; priorities may be listed.
MOVE = actions.Action(
    ("orders", "status"),
    (
        actions.Step("update", "lists.orders", {"o_orderstatus": "parameter.status", "region": "user.region"}, (
            actions.Criterion("current.o_orderstatus", "not_equals", "F", "the order is closed"),
            actions.Criterion("current.o_totalprice", "less_than_or_equal", "parameter.limit", "too large", number=True),
            actions.Criterion("current.o_orderpriority", "in", "lists.priorities", "not of these priorities"),
            actions.Criterion("user.region", "in", ("ASIA", "EUROPE", "AFRICA", "AMERICA"), "no such region"),
        )),
        actions.Step("create", "parameter.note", {"id": "parameter.note", "by": "user.name"}),
    ),
    ("note", "limit", "priorities"), "id",
)
MOVE_SQL = f"""r AS (SELECT c_custkey, r_name, CASE WHEN c_custkey % 7 = 0 THEN 'missing status' WHEN c_custkey % 11 = 0 THEN 'unknown colour' WHEN c_custkey % 17 = 0 THEN 'no object'
WHEN CASE WHEN c_custkey % 13 = 0 THEN 2 ELSE 1 END * n > 1000 THEN 'too many objects' WHEN c_custkey % 13 = 0 THEN 'duplicate object' END AS problem
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey),
u AS (SELECT c_custkey AS request_id, CAST(o_orderkey AS VARCHAR) AS object_id, 'update' AS operation, CASE WHEN c_custkey % 7 <> 0 THEN 'P' END AS value, o_orderstatus AS expected, problem,
CASE WHEN o_orderstatus = 'F' THEN 'the order is closed' WHEN c_custkey % 2 = 0 AND o_totalprice > 200000 THEN 'too large' WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND c_custkey % 3 = 0 THEN 'not of these priorities'
WHEN r_name = 'MIDDLE EAST' THEN 'no such region' END AS failure, UNNEST(range(CASE WHEN c_custkey % 13 = 0 THEN 2 ELSE 1 END)) AS _ FROM r JOIN orders ON o_custkey = c_custkey)"""


@R.add("action_proposals", f"""WITH {MOVE_SQL} SELECT request_id, object_id, operation, value, expected, problem, failure FROM u
UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 17 <> 0 THEN 'note-' || c_custkey END, 'create', CASE WHEN c_custkey % 17 <> 0 THEN 'note-' || c_custkey END, NULL, problem, NULL FROM r""")
def action_proposals(spark, sf_dir) -> DataFrame:
    """Every customer with orders makes one request; the values they ask for, what they expect to replace, and what refuses them."""
    orders, c = table(spark, sf_dir, "orders"), F.col("c_custkey")
    text = lambda *names: F.map_from_arrays(F.lit(list(names)).cast("array<string>"), F.array(*[F.col(n).cast("string") for n in names]))
    state = orders.select(F.col("o_orderkey").cast("string").alias("object_id"), text("o_orderstatus", "o_totalprice", "o_orderpriority").alias("fields"))
    own = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("ids"))
    people = secure.with_boundary(ONTOLOGY, "Customer", loader(spark, sf_dir)).select("c_custkey", "c_name", F.col(secure.BOUNDARY).alias("region")).join(own, "c_custkey")
    entry = lambda when, name, value: F.when(when, F.struct(F.lit(name).alias("k"), value.alias("v")))
    parameters = F.map_from_entries(F.array_compact(F.array(
        entry(c % 7 != 0, "status", F.lit("P")), entry(c % 17 != 0, "note", F.concat(F.lit("note-"), c)), entry(c % 2 == 0, "limit", F.lit("200000")), entry((c % 11 == 0) & (c % 7 != 0), "colour", F.lit("red")),
    )))
    ids = F.when(c % 13 == 0, F.concat("ids", "ids")).otherwise(F.col("ids"))
    lists = F.map_from_entries(F.array_compact(F.array(entry(F.lit(True), "orders", ids), entry(c % 3 == 0, "priorities", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))))))
    requests = people.select(c.alias("request_id"), F.create_map(F.lit("region"), "region", F.lit("name"), "c_name").alias("user"), parameters.alias("parameters"), lists.alias("lists"))
    found = actions.propose(requests, state, MOVE)
    return found.select("request_id", "object_id", "operation", F.coalesce(F.col("changes")["o_orderstatus"], F.col("changes")["id"]).alias("value"), F.col("expected")["o_orderstatus"].alias("expected"), "problem", "failure")


@R.add("criteria", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'the order is closed' WHEN o_totalprice > 400000 THEN 'too large' WHEN o_orderpriority <> '1-URGENT' THEN 'not urgent' END AS failure FROM orders""")
def criteria(spark, sf_dir) -> DataFrame:
    rules = [
        (F.col("o_orderstatus"), "not_equals", F.lit("F"), "the order is closed"), (F.col("o_totalprice"), "at_most", F.lit(400000.0), "too large"),
        (F.col("o_orderpriority"), "equals", F.lit("1-URGENT"), "not urgent"),
    ]
    return edits.criteria(table(spark, sf_dir, "orders"), rules).select("o_orderkey", "failure")


@R.add("eligible_tasks", """SELECT 'user_' || r_regionkey AS user_id, o_orderkey AS write_id, 0 AS task FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> o_orderkey % 5""")
def eligible_tasks(spark, sf_dir) -> DataFrame:
    orders = secure.with_boundary(ONTOLOGY, "Order", loader(spark, sf_dir))
    tasks = orders.select(F.col("o_orderkey").alias("write_id"), F.lit(0).alias("task"), F.col(secure.BOUNDARY).alias("boundary"), F.concat(F.lit("user_"), F.col("o_orderkey") % 5).alias("proposed_by"))
    return edits.eligible_tasks(tasks, users(spark, sf_dir).filter("security_value is not null"))


@R.add("duplicates_of", "SELECT event_id AS write_id, COUNT(*) OVER (PARTITION BY user_id, event_type) - 1 AS others FROM events")
def duplicates_of(spark, sf_dir) -> DataFrame:
    return edits.duplicates_of(table(spark, sf_dir, "events").withColumnRenamed("event_id", "write_id"), ["user_id", "event_type"])


@R.add("awaiting", f"WITH {LOG_SQL} SELECT id, created_at + INTERVAL 15 MINUTE <= TIMESTAMP '2024-01-25' AS expired FROM log WHERE status = 'pending'")
def awaiting(spark, sf_dir) -> DataFrame:
    return edits.awaiting(write_log(spark, sf_dir), F.lit("2024-01-25 00:00:00").cast("timestamp")).select("id", "expired")


@R.add("current_status", "SELECT user_id AS write_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def current_status(spark, sf_dir) -> DataFrame:
    return edits.current_status(table(spark, sf_dir, "events").select(F.col("user_id").alias("write_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq")))


STATUS_OF = {"view": "pending", "purchase": "applied", "signup": "applied"}


@R.add("settled_status", """WITH e AS (SELECT user_id AS write_id, event_id AS seq, CASE WHEN event_type = 'view' THEN 'pending' WHEN event_type IN ('purchase', 'signup') THEN 'applied' ELSE 'abandoned' END AS status FROM events),
o AS (SELECT write_id, MIN(seq) AS opened FROM e WHERE status = 'pending' GROUP BY 1)
SELECT write_id, COALESCE(arg_min(status, seq) FILTER (status <> 'pending' AND seq > opened), 'pending') AS status,
  CAST(COUNT(*) FILTER (status <> 'pending') - CASE WHEN COUNT(*) FILTER (status <> 'pending' AND seq > opened) > 0 THEN 1 ELSE 0 END AS BIGINT) AS refused FROM e JOIN o USING (write_id) GROUP BY 1""")
def settled_status(spark, sf_dir) -> DataFrame:
    """The events as a log of statuses that users' writes ask for: the first after pending settles a write."""
    status = F.coalesce(*[F.when(F.col("event_type") == event, F.lit(s)) for event, s in STATUS_OF.items()], F.lit("abandoned"))
    return edits.settled(table(spark, sf_dir, "events").select(F.col("user_id").alias("write_id"), status.alias("status"), F.col("event_id").alias("seq")))


WRITES_SQL = """s AS (SELECT o_orderkey AS object_id, o_orderstatus AS value FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 5 = 0),
w AS (SELECT o_orderkey // 4 AS batch_id, CASE WHEN o_orderkey % 7 = 0 THEN 'create' WHEN o_orderkey % 8 = 5 THEN 'delete' ELSE 'update' END AS operation, o_orderkey AS object_id,
  CASE WHEN o_orderkey % 50 = 11 THEN 'stale' ELSE o_orderstatus END AS expected, 'N' AS value FROM orders),
ok AS (SELECT batch_id, bool_and(CASE WHEN operation = 'create' THEN s.object_id IS NULL ELSE s.object_id IS NOT NULL AND s.value IS NOT DISTINCT FROM expected END) AS ok FROM w LEFT JOIN s USING (object_id) GROUP BY 1)"""


def _apply(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every order is written; every seventh is created, and of those each fifth is there already."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    state = o.filter((k % 7 != 0) | (k % 5 == 0)).select(k.alias("object_id"), F.col("o_orderstatus").alias("value"))
    writes = o.select(
        F.floor(k / 4).alias("batch_id"), F.when(k % 7 == 0, "create").when(k % 8 == 5, "delete").otherwise("update").alias("operation"), k.alias("object_id"),
        F.when(k % 50 == 11, "stale").otherwise(F.col("o_orderstatus")).alias("expected"), F.lit("N").alias("value"),
    )
    return edits.apply_batch(state, writes)


@R.add("apply_batch_state", f"WITH {WRITES_SQL}, d AS (SELECT object_id, w.value, operation FROM w JOIN ok USING (batch_id) WHERE ok) SELECT COALESCE(s.object_id, d.object_id) AS object_id, COALESCE(d.value, s.value) AS value FROM s FULL JOIN d ON s.object_id = d.object_id WHERE d.operation IS NULL OR d.operation <> 'delete'")
def apply_batch_state(spark, sf_dir) -> DataFrame:
    return _apply(spark, sf_dir)[0]


@R.add("apply_batch_status", f"WITH {WRITES_SQL} SELECT batch_id, CASE WHEN ok THEN 'applied' ELSE 'abandoned' END AS status FROM ok")
def apply_batch_status(spark, sf_dir) -> DataFrame:
    return _apply(spark, sf_dir)[1]


#: Three waves of batches over all orders, of 4, 6 and 10 orders each, so that batches of one wave wait for several of the wave before.
WAVES_SQL = """k AS (SELECT o_orderkey AS k, o_orderstatus AS own FROM orders),
s0 AS (SELECT k, own AS v FROM k WHERE k % 7 <> 0 OR k % 5 = 0),
b1 AS (SELECT k // 4 AS b, bool_and(CASE WHEN k.k % 7 = 0 THEN s0.k IS NULL ELSE s0.k IS NOT NULL AND k.k % 50 <> 11 END) AS ok FROM k LEFT JOIN s0 USING (k) GROUP BY 1),
s1 AS (SELECT k, CASE WHEN ok THEN 'N' ELSE v END AS v FROM k JOIN b1 ON b = k // 4 LEFT JOIN s0 USING (k) WHERE ok OR s0.k IS NOT NULL),
b2 AS (SELECT k // 6 AS b, bool_and(COALESCE(s1.v = CASE WHEN k // 6 % 3 = 0 THEN own ELSE 'N' END, false)) AS ok FROM k LEFT JOIN s1 USING (k) GROUP BY 1),
s2 AS (SELECT k, CASE WHEN ok THEN 'W' ELSE v END AS v FROM s1 JOIN b2 ON b = k // 6),
b3 AS (SELECT k // 10 AS b, bool_and(COALESCE(s2.v = 'W', false)) AS ok FROM k LEFT JOIN s2 USING (k) GROUP BY 1),
s3 AS (SELECT k, CASE WHEN ok THEN 'X' ELSE v END AS v FROM s2 JOIN b3 ON b = k // 10 WHERE NOT (ok AND k % 10 = 3))"""
WAVE = 1_000_000_000_000


def _waves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Batches that overlap: the first wave creates and then updates, or updates, and in part expects stale values; the second
    builds on its values or on what stands where it was abandoned; the third builds on the second, and deletes."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    state = o.filter((k % 7 != 0) | (k % 5 == 0)).select(k.alias("object_id"), F.create_map(F.lit("value"), "o_orderstatus").alias("fields"))
    value = lambda v: F.create_map(F.lit("value"), v)
    none = F.lit(None).cast("map<string,string>")

    def wave(n, size, seq, operation, expected, changes, where=None):
        return (o.filter(where) if where is not None else o).select((F.floor(k / size) + n * WAVE).alias("batch_id"), F.lit(seq).alias("seq"), k.alias("object_id"), operation.alias("operation"), expected.alias("expected"), changes.alias("changes"))

    made, own = k % 7 == 0, F.col("o_orderstatus")
    second = F.when(F.floor(k / 6) % 3 == 0, own).otherwise("N")
    writes = wave(0, 4, 0, F.lit("create"), none, value(F.lit("C")), made)
    writes = writes.unionByName(wave(0, 4, 1, F.lit("update"), value(F.when(made, "C").when(k % 50 == 11, "stale").otherwise(own)), value(F.lit("N"))))
    writes = writes.unionByName(wave(1, 6, 0, F.lit("update"), value(second), value(F.lit("W"))))
    writes = writes.unionByName(wave(2, 10, 0, F.when(k % 10 == 3, "delete").otherwise("update"), value(F.lit("W")), value(F.lit("X"))))
    return edits.apply_in_order(state, writes)


@R.add("ordered_batches_state", f"WITH {WAVES_SQL} SELECT k AS object_id, v AS value FROM s3")
def ordered_batches_state(spark, sf_dir) -> DataFrame:
    return _waves(spark, sf_dir)[0].select("object_id", F.col("fields")["value"].alias("value"))


@R.add("ordered_batches_status", f"WITH {WAVES_SQL}, b AS (SELECT b AS batch_id, ok FROM b1 UNION ALL SELECT b + {WAVE}, ok FROM b2 UNION ALL SELECT b + {2 * WAVE}, ok FROM b3) SELECT batch_id, CASE WHEN ok THEN 'applied' ELSE 'abandoned' END AS status FROM b")
def ordered_batches_status(spark, sf_dir) -> DataFrame:
    return _waves(spark, sf_dir)[1]


@R.add("approvals", """WITH t AS (SELECT o_orderkey AS write_id, k AS task FROM orders, (VALUES (0), (1)) v(k)),
e AS (SELECT event_id // 2 AS write_id, * FROM events UNION ALL SELECT user_id AS write_id, * FROM events),
d AS (SELECT write_id, event_id % 2 AS task, arg_max(CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'approved' END, (ts, event_id)) AS decision FROM e GROUP BY 1, 2)
SELECT write_id, CASE WHEN bool_and(COALESCE(decision = 'approved', false)) THEN 'approved' WHEN bool_or(COALESCE(decision = 'rejected', false)) THEN 'rejected' ELSE 'undecided' END AS state FROM t LEFT JOIN d USING (write_id, task) GROUP BY 1""")
def approvals(spark, sf_dir) -> DataFrame:
    """Two tasks for each order; an event decides one of a write of its own and one of its user's."""
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("write_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("task"))
    decisions = table(spark, sf_dir, "events").select(
        F.explode(F.array(F.floor(F.col("event_id") / 2), F.col("user_id").cast("long"))).alias("write_id"), (F.col("event_id") % 2).cast("int").alias("task"),
        F.when(F.col("event_type") == "error", "rejected").otherwise("approved").alias("decision"), F.col("ts").alias("decided_at"), F.col("event_id").alias("decision_id"),
    )
    return edits.approvals(tasks, decisions)
