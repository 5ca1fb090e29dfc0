"""Declared actions as templates of sub-writes, compiled to columns over whole tables of requests.

An operand is a literal, or text that starts with parameter., user. or current. and names a parameter of
the request, an attribute of the acting user, or a field of the object as it is now.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIXES = ("parameter", "user", "current")


@dataclass(frozen=True)
class Criterion:
    """What must hold before a sub-write is proposed; number compares as numbers. Skipped where a side is absent."""

    left: Any
    operator: str
    right: Any
    description: str
    number: bool = False


@dataclass(frozen=True)
class Step:
    """Sub-writes of one operation: object_id is an operand, or names a list of ids as lists.<name>; changes, operands by field."""

    operation: str
    object_id: Any
    changes: dict[str, Any]
    criteria: tuple[Criterion, ...] = ()


@dataclass(frozen=True)
class Action:
    required: tuple[str, ...]
    steps: tuple[Step, ...]
    optional: tuple[str, ...] = ()
    id_field: str | None = None


COMPARED: dict[str, Callable[[Column, Column], Column]] = {
    "equals": lambda a, b: a == b, "not_equals": lambda a, b: a != b, "greater_than": lambda a, b: a > b, "less_than": lambda a, b: a < b,
    "greater_than_or_equal": lambda a, b: a >= b, "less_than_or_equal": lambda a, b: a <= b,
}


def _reference(operand: Any) -> tuple[str, str] | None:
    if isinstance(operand, str) and operand.partition(".")[0] in (*PREFIXES, "lists"):
        kind, _, name = operand.partition(".")
        return kind, name
    return None


def value_of(operand: Any) -> Column:
    """The operand as text; NULL where what it names isn't there."""
    named = _reference(operand)
    if named is None:
        return F.lit(operand).cast("string")
    kind, name = named
    return F.col({"parameter": "parameters", "user": "user", "current": "current"}[kind])[name]


def holds(c: Criterion) -> Column:
    """TRUE, FALSE, or NULL where a side is absent."""
    kind = "double" if c.number else "string"
    left = value_of(c.left).try_cast(kind)
    if c.operator != "in":
        return COMPARED[c.operator](left, value_of(c.right).try_cast(kind))
    named = _reference(c.right)
    if named and named[0] == "lists":
        return F.array_contains(F.transform(F.col("lists")[named[1]], lambda x: x.try_cast(kind)), left)
    return left.isin([F.lit(x).cast(kind) for x in c.right])


def _unresolved(action: Action) -> Column:
    """The first user attribute that an operand names and the user lacks; a rule that quietly compares with nothing is worse than none."""
    operands = [x for s in action.steps for x in (s.object_id, *s.changes.values(), *(y for c in s.criteria for y in (c.left, c.right)))]
    names = sorted({r[1] for x in operands if (r := _reference(x)) and r[0] == "user"})
    return F.coalesce(*[F.when(~F.coalesce(F.map_contains_key("user", F.lit(n)), F.lit(False)), F.lit(f"no user attribute {n}")) for n in names], F.lit(None).cast("string"))


def propose(requests: DataFrame, state: DataFrame, action: Action, ceiling: int = 1_000) -> DataFrame:
    """request_id, step, object_id, operation, changes, expected, problem, failure: the sub-writes of every request.

    requests: request_id, user and parameters (map<string,string>), lists (map<string,array<string>>); state:
    object_id, fields (map<string,string>). changes holds the new values; expected, for updates, the
    values that the changed fields have now, for the check when the write is applied. problem refuses a
    request as a whole, on all its rows: a missing or unknown parameter, a user attribute that an operand
    needs, more than ceiling objects in a step, an object named twice, no id, an update or delete of an
    object that isn't there, a create of one that is or whose id field says otherwise. failure is the
    description of the sub-write's first criterion that doesn't hold. Of several problems of a request the
    alphabetically first is named, a duplicate only where there is no other. Parameters that are lists count as
    parameters. Requests are exploded by their own ids and meet the state in one join.
    """
    given = F.array_union(F.coalesce(F.map_keys("parameters"), F.array().cast("array<string>")), F.coalesce(F.map_keys("lists"), F.array().cast("array<string>")))
    known = sorted({*action.required, *action.optional})
    missing, unknown = F.array_except(F.lit(list(action.required)).cast("array<string>"), given), F.array_sort(F.array_except(given, F.lit(known).cast("array<string>")))
    whole = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(missing), ","))).when(F.size(unknown) > 0, F.concat(F.lit("unknown "), F.array_join(unknown, ",")))
    own = requests.select("request_id", "user", "parameters", "lists", F.coalesce(whole, _unresolved(action)).alias("_whole"))
    parts = []
    for k, step in enumerate(action.steps):
        named = _reference(step.object_id)
        ids = F.coalesce(F.col("lists")[named[1]], F.array(F.lit(None).cast("string"))) if named and named[0] == "lists" else F.array(value_of(step.object_id))
        too_many = F.when(F.size(ids) > ceiling, F.lit("too many objects"))
        parts.append(own.select("request_id", "user", "parameters", "lists", F.coalesce("_whole", too_many).alias("_whole"), F.lit(k).alias("step"), F.lit(step.operation).alias("operation"), F.explode(ids).alias("object_id")))
    rows = reduce(DataFrame.unionByName, parts).join(state.select("object_id", F.col("fields").alias("current"), F.lit(True).alias("_here")), "object_id", "left")

    per_step = lambda make: F.coalesce(*[F.when(F.col("step") == k, make(s)) for k, s in enumerate(action.steps)])
    changes = per_step(lambda s: F.map_from_arrays(F.lit(list(s.changes)).cast("array<string>"), F.array(*[value_of(x) for x in s.changes.values()]).cast("array<string>")))
    wrong_id = F.lit(False) if action.id_field is None else F.coalesce(F.col("changes")[action.id_field] != F.col("object_id"), F.lit(False))
    here = F.coalesce("_here", F.lit(False))
    rows = rows.withColumn("changes", changes)
    expected = F.when(F.col("operation") == "update", F.map_from_arrays(F.map_keys("changes"), F.transform(F.map_keys("changes"), lambda f: F.col("current")[f])))
    problem = (
        F.when(F.col("_whole").isNotNull(), F.col("_whole")).when(F.col("object_id").isNull(), "no object")
        .when((F.col("operation") == "create") & here, "object exists").when((F.col("operation") != "create") & ~here, "no such object")
        .when((F.col("operation") == "create") & wrong_id, "id differs")
    )
    failure = per_step(lambda s: F.coalesce(*[F.when(~holds(c), F.lit(c.description)) for c in s.criteria], F.lit(None).cast("string")))
    made = rows.select("request_id", "step", "object_id", "operation", "changes", expected.alias("expected"), problem.alias("_problem"), failure.alias("failure"))
    twice = made.groupBy("request_id", "object_id").agg(F.count(F.lit(1)).alias("n"), F.min("_problem").alias("any"))
    refused = twice.groupBy("request_id").agg(F.coalesce(F.min("any"), F.max(F.when((F.col("n") > 1) & F.col("object_id").isNotNull(), "duplicate object"))).alias("problem"))
    return made.drop("_problem").join(refused, "request_id")
