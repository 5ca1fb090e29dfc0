"""The write log: views of it, the overlay on lake rows, proposals, criteria, approvals and applying.

Log rows: id, object_type, object_id, operation (create, update, delete), changes (JSON of text values),
status (pending, applied, abandoned), user_id, created_at, batch_id. Later means greater (created_at, id).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Ontology
from ..session import discard, materialise
from .secure import Load

AT = "struct(created_at, id)"
OBJECT = ["object_type", "object_id"]


def with_map(log: DataFrame) -> DataFrame:
    """changes as map<string,string>; values are JSON strings, so that 1.50 stays 1.50."""
    return log.withColumn("changes", F.from_json("changes", "map<string,string>"))


def exploded(log: DataFrame) -> DataFrame:
    """A row for each field that an entry changes: field, value. An explicit NULL is a value."""
    return with_map(log).select("*", F.explode("changes").alias("field", "value")).drop("changes")


def latest_by_field(log: DataFrame, status: str) -> DataFrame:
    """object_type, object_id, field, value: the last entry of a status for each field."""
    some = exploded(log.filter((F.col("status") == status) & (F.col("operation") != "delete")))
    return some.groupBy(*OBJECT, "field").agg(F.max_by(F.struct("value"), F.expr(AT)).alias("_v")).select(*OBJECT, "field", F.col("_v.value").alias("value"))


def pending(log: DataFrame) -> DataFrame:
    """object_type, object_id, changes (map): pending entries merged by field, last wins."""
    return _merged(latest_by_field(log, "pending"))


def applied_since(log: DataFrame, instant: Column) -> DataFrame:
    """Applied changes at or after an instant, merged by field, last wins."""
    return _merged(latest_by_field(log.filter(F.col("created_at") >= instant), "applied"))


def _merged(fields: DataFrame) -> DataFrame:
    return fields.groupBy(*OBJECT).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("changes"))


def all_pending(log: DataFrame, subwrites: DataFrame) -> DataFrame:
    """Pending entries, those of batches flattened; an object's own entry wins over a batch's.

    subwrites: batch_id, object_type, object_id, changes.
    """
    own = log.filter((F.col("status") == "pending") & F.col("batch_id").isNull()).select(*OBJECT, "changes", F.lit(False).alias("batched"))
    batches = log.filter((F.col("status") == "pending") & F.col("batch_id").isNotNull()).select("batch_id").distinct()
    flat = subwrites.join(batches, "batch_id", "left_semi").select(*OBJECT, "changes", F.lit(True).alias("batched"))
    return own.unionByName(flat.join(own, OBJECT, "left_anti"))


def tombstones(log: DataFrame) -> DataFrame:
    """Objects whose last applied entry is a delete."""
    last = log.filter(F.col("status") == "applied").groupBy(*OBJECT).agg(F.max_by("operation", F.expr(AT)).alias("_last"))
    return last.filter("_last = 'delete'").select(*OBJECT)


def overlay(rows: DataFrame, key: str, type_name: str, log: DataFrame, instant: Column, fields: list[str]) -> DataFrame:
    """Lake rows as they read now: deleted ones gone, then pending over applied-since over lake values.

    Objects that only the log has created are added. An explicit NULL edit wins over the lake's value.
    """
    own = log.filter(F.col("object_type") == type_name)
    edits = pending(own).select("object_id", F.col("changes").alias("_p")).join(
        applied_since(own, instant).select("object_id", F.col("changes").alias("_a")), "object_id", "full"
    )
    created = own.filter((F.col("operation") == "create") & F.col("status").isin("pending", "applied")).select("object_id").distinct().withColumn("_made", F.lit(True))
    lake = rows.withColumn("object_id", F.col(key).cast("string")).withColumn("_here", F.lit(True))
    joined = lake.join(edits, "object_id", "full").join(created, "object_id", "left").join(tombstones(own).select("object_id"), "object_id", "left_anti")
    seen = joined.filter("_here or _made")

    def read(field: str) -> Column:
        kind = rows.schema[field].dataType
        over = lambda m: F.coalesce(F.map_contains_key(F.col(m), F.lit(field)), F.lit(False))
        return (
            F.when(over("_p"), F.col("_p")[field].try_cast(kind)).when(over("_a"), F.col("_a")[field].try_cast(kind)).otherwise(F.col(field)).alias(field)
        )

    return seen.select("object_id", *[read(f) for f in fields])


def edited_load(ontology: Ontology, load: Load, log: DataFrame, instant: Column) -> Load:
    """A load whose object types read as they now are, so that the filters, links, aggregates and security of object sets see edits.

    Tables that are no object type, such as join tables, stay as they are.
    """

    def read(name: str) -> DataFrame:
        rows, t = load(name), ontology.types.get(name)
        if t is None:
            return rows
        others = [c for c in rows.columns if c != t.id_field]
        now = overlay(rows, t.id_field, name, log, instant, others)
        return now.select(F.col("object_id").try_cast(rows.schema[t.id_field].dataType).alias(t.id_field), *others)

    return read


@dataclass(frozen=True)
class Constraint:
    """What a field's new value must fulfil: required, number, min, max, max_length or one_of, with its limit."""

    field: str
    rule: str
    limit: Any = None

    def broken(self, value: Column) -> Column:
        number = value.try_cast("double")
        checks = {
            "required": lambda: value.isNull() | (F.trim(value) == ""), "number": lambda: value.isNotNull() & number.isNull(),
            "min": lambda: number < self.limit, "max": lambda: number > self.limit,
            "max_length": lambda: F.length(value) > self.limit, "one_of": lambda: ~value.isin(*self.limit),
        }
        return F.coalesce(checks[self.rule](), F.lit(False))


def violations(log: DataFrame, type_name: str, constraints: list[Constraint]) -> DataFrame:
    """id, object_id, field, value, rule: each constraint that a proposed change of a type would break.

    Changes are exploded once; a field has one row for each of its constraints that is broken. Abandoned
    entries and deletes propose nothing.
    """
    proposed = exploded(log.filter((F.col("object_type") == type_name) & (F.col("status") != "abandoned") & (F.col("operation") != "delete")))
    rules = F.array(*[F.when((F.col("field") == c.field) & c.broken(F.col("value")), F.lit(c.rule)) for c in constraints])
    return proposed.select("id", "object_id", "field", "value", F.explode(F.array_compact(rules)).alias("rule"))


def edit_history(log: DataFrame, readable: list[str]) -> DataFrame:
    """Every entry with the changes that may be read, its place (newest first) and the object's total."""
    w = Window.partitionBy(*OBJECT)
    return with_map(log).select(
        *OBJECT, "id", "operation", "status", F.map_filter("changes", lambda k, _: k.isin(readable)).alias("changes"),
        F.row_number().over(w.orderBy(F.desc("created_at"), F.desc("id"))).alias("place"), F.count(F.lit(1)).over(w).alias("total"),
    )


def superseded(log: DataFrame) -> DataFrame:
    """id, superseded: whether an object has a later applied entry."""
    last = log.filter("status = 'applied'").groupBy(*OBJECT).agg(F.max(F.expr(AT)).alias("_last"))
    return log.join(last, OBJECT, "left").select("id", F.coalesce(F.expr(AT) < F.col("_last"), F.lit(False)).alias("superseded"))


def edits_by_field(log: DataFrame) -> DataFrame:
    return exploded(log).filter(F.col("status").isin("applied", "pending")).groupBy("field", "status").agg(F.count(F.lit(1)).alias("n"))


def fabricated_creates(log: DataFrame) -> DataFrame:
    """Applied creates that set nothing."""
    return with_map(log).filter("operation = 'create' and status = 'applied'").filter(F.coalesce(F.size("changes"), F.lit(0)) <= 0).select("id", "object_id")


def undeclared_fields(log: DataFrame, declared: DataFrame) -> DataFrame:
    """Entries that name fields no longer declared; declared: object_type, field."""
    return exploded(log).join(declared, ["object_type", "field"], "left_anti").select("id", "object_type", "field")


def out_of_reach(writes: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Writes whose proposer's boundary isn't the object's current one, or which has none.

    writes: write_id, object_id, user_boundary; boundaries: object_id, boundary.
    """
    return writes.join(boundaries, "object_id", "left").filter(~F.col("user_boundary").eqNullSafe(F.col("boundary")) | F.col("boundary").isNull()).select("write_id", "object_id")


def propose(requests: DataFrame, required: list[str], ceiling: int) -> DataFrame:
    """Bulk requests as sub-writes with a verdict.

    requests: request_id, object_ids (array), parameters (map). problem is NULL for what stands; an id
    named twice, a missing or unknown parameter, or more than ceiling objects refuses the whole request.
    """
    names = F.map_keys("parameters")
    lacking = F.array_except(F.array(*[F.lit(r) for r in required]), names)
    unknown = F.array_except(names, F.array(*[F.lit(r) for r in required]))
    problem = (
        F.when(F.size("object_ids") > ceiling, F.lit("too many objects"))
        .when(F.size(F.array_distinct("object_ids")) < F.size("object_ids"), F.lit("duplicate object"))
        .when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(lacking), ",")))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown "), F.array_join(F.array_sort(unknown), ",")))
    )
    return requests.withColumn("problem", problem).select("request_id", "problem", F.explode("object_ids").alias("object_id"), "parameters")


OPERATORS = {
    "equals": lambda a, b: a == b, "not_equals": lambda a, b: a != b, "greater_than": lambda a, b: a > b, "less_than": lambda a, b: a < b,
    "at_least": lambda a, b: a >= b, "at_most": lambda a, b: a <= b,
}


def criteria(proposals: DataFrame, rules: list[tuple[Column, str, Column, str]]) -> DataFrame:
    """failure: the description of the first rule (left, operator, right, description) that doesn't hold.

    A rule is skipped where either side is absent.
    """
    failed = [F.when(~OPERATORS[op](left, right), F.lit(text)) for left, op, right, text in rules]
    return proposals.withColumn("failure", F.coalesce(*failed, F.lit(None).cast("string")))


def approvals(tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """write_id, state: approved if the latest decision of every task is, rejected if one is, else undecided.

    tasks: write_id, task; decisions: write_id, task, decision, decided_at, decision_id.
    """
    latest = decisions.groupBy("write_id", "task").agg(F.max_by("decision", F.struct("decided_at", "decision_id")).alias("decision"))
    each = tasks.join(latest, ["write_id", "task"], "left").groupBy("write_id").agg(
        F.bool_and(F.coalesce(F.col("decision") == "approved", F.lit(False))).alias("all"), F.max(F.coalesce(F.col("decision") == "rejected", F.lit(False))).alias("no"),
    )
    return each.select("write_id", F.when(F.col("all"), "approved").when(F.col("no"), "rejected").otherwise("undecided").alias("state"))


def eligible_tasks(tasks: DataFrame, approvers: DataFrame) -> DataFrame:
    """user_id, write_id, task an approver may decide: the task's boundary is theirs and the write is not their own.

    tasks: write_id, task, boundary, proposed_by; approvers: user_id, security_value.
    """
    return tasks.join(approvers, F.col("boundary") == F.col("security_value")).filter("user_id <> proposed_by").select("user_id", "write_id", "task")


def duplicates_of(writes: DataFrame, fingerprint: list[str]) -> DataFrame:
    """write_id, others: how many other writes carry the same fingerprint. A join with counts, not a window over a hot one."""
    print_ = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in fingerprint]), 256)
    own = writes.withColumn("_print", print_)
    counts = own.groupBy("_print").agg((F.count(F.lit(1)) - 1).alias("others"))
    return own.join(counts, "_print").select("write_id", "others")


def awaiting(writes: DataFrame, now: Column, ttl_minutes: int = 15) -> DataFrame:
    """Pending writes with expires_at and whether they have expired."""
    expires = F.col("created_at") + F.expr(f"interval {ttl_minutes} minutes")
    return writes.filter("status = 'pending'").withColumn("expires_at", expires).withColumn("expired", expires <= now)


def current_status(events: DataFrame) -> DataFrame:
    """write_id and its last status. events: write_id, status, seq, appended and never changed."""
    return events.groupBy("write_id").agg(F.max_by("status", "seq").alias("status"))


def settled(events: DataFrame) -> DataFrame:
    """write_id, status, refused: a pending write becomes applied or abandoned once, and stays so.

    events: as for current_status. What comes before the write is pending, or after it is settled, is
    refused and counted; a write that was never pending has no row.
    """
    opened = events.filter("status = 'pending'").groupBy("write_id").agg(F.min("seq").alias("_opened"))
    later = (F.col("status") != "pending") & (F.col("seq") > F.col("_opened"))
    each = events.join(opened, "write_id").groupBy("write_id").agg(
        F.min_by(F.when(later, F.col("status")), F.when(later, F.col("seq"))).alias("_end"), F.count_if(F.col("status") != "pending").alias("_asked"),
    )
    ended = F.col("_end").isNotNull()
    return each.select("write_id", F.coalesce("_end", F.lit("pending")).alias("status"), (F.col("_asked") - ended.cast("long")).alias("refused"))


#: Batches of one object that a round decides one after the other, where they touch nothing else.
RUN = 256

_NOW = "struct<here:boolean,fields:map<string,string>>"


def _after(now: Column, write: Column) -> Column:
    """(fits, here, fields) once a sub-write has been tried on an object's state (here, fields)."""
    here, old, new = now["here"], now["fields"], write["changes"]
    as_expected = here & F.forall(F.map_keys(write["expected"]), lambda k: old[k].eqNullSafe(write["expected"][k]))
    fits = F.when(write["operation"] == "create", ~here).otherwise(as_expected)
    merged = F.map_zip_with(old, new, lambda k, a, b: F.when(F.map_contains_key(new, k), b).otherwise(a))
    kept = F.when(write["operation"] == "create", new).when(write["operation"] == "delete", F.map_filter(new, lambda k, v: F.lit(False))).otherwise(merged)
    return F.struct(fits.alias("fits"), (write["operation"] != "delete").alias("here"), kept.alias("fields"))


def _tried(now: Column, writes: Column) -> Column:
    """(ok, here, fields): a batch's sub-writes on one object in their order; ok if each fits what the ones before left."""
    start = F.struct(F.lit(True).alias("ok"), now["here"].alias("here"), now["fields"].alias("fields"))

    def step(acc: Column, write: Column) -> Column:
        after = _after(acc, write)
        return F.struct((acc["ok"] & after["fits"]).alias("ok"), after["here"].alias("here"), after["fields"].alias("fields"))

    return F.aggregate(writes, start, step)


def _rounds(touches: DataFrame, run: int) -> list[DataFrame]:
    """For each round, the rows that it decides: batch_id, object_id, width (objects of the batch), place (on the object), round.

    touches: batch_id and object_id, each pair once. Which round decides a batch hangs on who waits for whom
    alone, not on values, so no sub-write takes part.
    """
    width = touches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("width"))
    left, due = materialise(touches.join(width, "batch_id"), "undecided"), []
    order = Window.partitionBy("object_id").orderBy("batch_id")
    several_before = F.max(F.col("width") > 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    while not left.isEmpty():
        placed = left.withColumns({"place": F.row_number().over(order), "_several": several_before}).filter(F.col("place") <= run)
        front = materialise(placed.filter("not _several or width > 1 and place = 1").drop("_several"), "front")
        several = front.filter("width > 1")
        ready = several.groupBy("batch_id", "width").agg(F.count(F.lit(1)).alias("n")).filter("n = width").select("batch_id")
        now_due = several.join(ready, "batch_id", "left_semi").unionByName(front.filter("width = 1")).withColumn("round", F.lit(len(due)))
        due.append(materialise(now_due, "due"))
        rest = materialise(left.join(due[-1], "batch_id", "left_anti"), "undecided")
        discard(front, left)
        left = rest
    discard(left)
    return due


def apply_in_order(state: DataFrame, writes: DataFrame, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """The new state, and (batch_id, status) of every batch: applied as a whole or abandoned, in the order of batch_id.

    state: object_id, fields (map<string,string>). writes: batch_id, seq, object_id, operation (create,
    update, delete), expected and changes (maps of the same kind). A batch's sub-writes come in the order of
    seq, and each sees what the ones before it left: an update or a delete needs the object and, for every
    expected field, its value (NULL equal to NULL), a create needs that there is no such object. One that
    doesn't fit abandons its batch, which then changes nothing; the next batch is judged by what is there.

    A fixpoint over the graph of batches and objects: in each round the batches that are the first
    undecided one on all their objects are decided, together with up to run batches of each object that
    touch it alone and come before the next that touches others. Rounds are as many as the longest chain of
    batches that wait for each other, at most. They are found first, over ids alone; then the sub-writes are
    written out in the order of rounds, so that a round reads its own. Each round's state is written out, and
    only objects that are written to take part. Null maps are empty ones. Writes without a batch_id or an
    object_id are left out.
    """
    none = F.create_map().cast("map<string,string>")
    held = lambda c: F.coalesce(c, none)
    writes = writes.filter("batch_id is not null and object_id is not null")
    due = _rounds(writes.select("batch_id", "object_id").distinct(), run)
    here = state.select("object_id", F.struct(F.lit(True).alias("here"), held("fields").alias("fields")).cast(_NOW).alias("now"))
    if not due:
        return state.select("object_id", held("fields").alias("fields")), writes.select("batch_id", F.lit("applied").alias("status"))
    decided = reduce(DataFrame.unionByName, due)
    # Maps have no order, their entries have.
    steps = writes.groupBy("batch_id", "object_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "operation", F.map_entries(held("expected")).alias("expected"), F.map_entries(held("changes")).alias("changes")))).alias("steps")
    )
    as_map = F.map_from_entries
    steps = steps.withColumn("steps", F.transform("steps", lambda w: F.struct(w["operation"].alias("operation"), as_map(w["expected"]).alias("expected"), as_map(w["changes"]).alias("changes"))))
    steps = materialise(steps.join(decided, ["batch_id", "object_id"]).sortWithinPartitions("round"), "steps")
    kinds = {r["round"]: r for r in decided.groupBy("round").agg(F.max(F.col("width") > 1).alias("wide"), F.max(F.col("width") == 1).alias("alone")).collect()}  # a row for each round
    absent = F.struct(F.lit(False).alias("here"), none.alias("fields")).cast(_NOW)
    touched = decided.select("object_id").distinct()
    now = materialise(touched.join(here, "object_id", "left").select("object_id", F.coalesce("now", absent).alias("now")), "objects")
    batch_id = dict(steps.dtypes)["batch_id"]
    as_now = lambda t: F.struct(t["here"].alias("here"), t["fields"].alias("fields")).cast(_NOW)
    found: list[DataFrame] = []
    for n in range(len(due)):
        own = steps.filter(F.col("round") == n)
        still, changed, verdicts, scratch = now, [], [], [now]
        if kinds[n]["wide"]:
            first = own.filter("width > 1").select("object_id", "batch_id", "steps")
            tried = now.join(first, "object_id", "left").select("object_id", "batch_id", "now", F.when(F.col("batch_id").isNotNull(), _tried(F.col("now"), F.col("steps"))).alias("t"))
            tried = materialise(tried, "tried")
            still, wide = tried.filter("batch_id is null").select("object_id", "now"), tried.filter("batch_id is not null")
            verdict = materialise(wide.groupBy("batch_id").agg(F.bool_and("t.ok").alias("ok")), "verdicts")
            verdicts.append(verdict)
            changed.append(wide.join(verdict, "batch_id").select("object_id", F.when(F.col("ok"), as_now(F.col("t"))).otherwise(F.col("now")).alias("now")))
            scratch.append(tried)
        if kinds[n]["alone"]:
            runs = own.filter("width = 1").groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("place", "batch_id"))).alias("order"), F.map_from_entries(F.collect_list(F.struct("place", "steps"))).alias("steps"))

            def one(acc: Column, batch: Column) -> Column:
                t = _tried(acc, F.col("steps")[batch["place"]])
                return F.struct(
                    F.when(t["ok"], t["here"]).otherwise(acc["here"]).alias("here"), F.when(t["ok"], t["fields"]).otherwise(acc["fields"]).alias("fields"),
                    F.concat(acc["verdicts"], F.array(F.struct(batch["batch_id"].alias("batch_id"), t["ok"].alias("ok")))).alias("verdicts"),
                )

            kind = f"array<struct<batch_id:{batch_id},ok:boolean>>"
            start = F.struct(F.col("now.here").alias("here"), F.col("now.fields").alias("fields"), F.array().cast(kind).alias("verdicts"))
            folded = materialise(runs.join(now, "object_id").select("object_id", F.aggregate("order", start, one).alias("t")), "folded")
            verdicts.append(materialise(folded.select(F.explode("t.verdicts").alias("v")).select("v.batch_id", "v.ok"), "verdicts"))
            after = folded.select("object_id", as_now(F.col("t")).alias("_after"))
            still = still.join(after, "object_id", "left").select("object_id", F.coalesce("_after", "now").alias("now"))
            scratch.append(folded)
        now = materialise(reduce(DataFrame.unionByName, [still, *changed]), "objects")
        discard(*scratch)
        found += verdicts
    discard(steps, *due)
    status = reduce(DataFrame.unionByName, found).select("batch_id", F.when(F.col("ok"), "applied").otherwise("abandoned").alias("status"))
    untouched = state.select("object_id", held("fields").alias("fields")).join(now.select("object_id"), "object_id", "left_anti")
    return untouched.unionByName(now.filter("now.here").select("object_id", F.col("now.fields").alias("fields"))), status


def apply_batch(state: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """apply_in_order for objects of one value. state: object_id, value; writes: batch_id, object_id, operation, expected, value.

    A batch's sub-writes on one object come in the order of seq, where writes have that column, else as equals.
    """
    one = lambda c: F.create_map(F.lit("value"), F.col(c).cast("string"))
    seq = F.col("seq") if "seq" in writes.columns else F.lit(0)
    steps = writes.select(
        "batch_id", seq.alias("seq"), "object_id", "operation", one("expected").alias("expected"), F.when(F.col("operation") != "delete", one("value")).alias("changes"),
    )
    new, status = apply_in_order(state.select("object_id", one("value").alias("fields")), steps)
    return new.select("object_id", F.col("fields")["value"].cast(state.schema["value"].dataType).alias("value")), status
