"""Conditions on fields as Columns. Conditions are joined by AND."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import STORED, ObjectType

RANGED = {"integer", "number", "decimal"}
TEMPORAL = {"date", "timestamp", "timestamptz"}


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: Any


def _literal(value: Any, data_type: str) -> Column:
    """The literal in the column's stored type, so that the column itself is never cast and is pushed down."""
    return F.lit(None if value is None else str(value)).cast(STORED[data_type])


def equality(values: dict[str, Any]) -> list[Condition]:
    """Shorthand: a dict of field to value."""
    return [Condition(f, "equals", v) for f, v in values.items()]


def resolve(condition: Condition, now: datetime | None = None) -> Condition:
    """A relative date (since or until so many days ago, in UTC) as a date range; others as they are."""
    if condition.operator != "relative_date":
        return condition
    today = (now or datetime.now(UTC)).date()
    ends = {"start" if k == "since_days" else "end": (today - timedelta(days=int(v))).isoformat() for k, v in condition.value.items()}
    return Condition(condition.field, "date_range", ends)


def predicate(condition: Condition, data_type: str = "string", now: datetime | None = None) -> Column:
    """The Column of a condition.

    NULL: equals NULL matches NULL, not_in keeps NULL, ranges and contains drop it. A date-only bound
    against a timestamp is midnight.
    """
    condition = resolve(condition, now)
    c, op, v = F.col(condition.field), condition.operator, condition.value
    if op == "equals":
        return c.isNull() if v is None else c == _literal(v, data_type)
    if op in ("in", "not_in"):
        if not v:
            raise ValueError(f"{op} needs at least one value")
        some = c.isin([_literal(x, data_type) for x in v])
        return some if op == "in" else ~F.coalesce(some, F.lit(False))
    if op in ("range", "date_range"):
        low, high = (v.get("min"), v.get("max")) if op == "range" else (v.get("start"), v.get("end"))
        if low is None and high is None:
            raise ValueError(f"{op} needs a bound")
        if op == "range" and data_type not in RANGED or op == "date_range" and data_type not in TEMPORAL | {"string"}:
            raise ValueError(f"{op} does not apply to {data_type}")
        if low is not None and high is not None and (float(low) > float(high) if op == "range" else str(low) > str(high)):
            raise ValueError("the bounds are inverted")
        parts = [c >= _literal(low, data_type)] * (low is not None) + [c <= _literal(high, data_type)] * (high is not None)
        return reduce(Column.__and__, parts)
    if op == "contains":
        if not v:
            raise ValueError("contains needs text")
        return F.contains(c, F.lit(v))
    raise ValueError(f"unknown operator {op}")


def where(conditions: list[Condition], object_type: ObjectType, now: datetime | None = None) -> Column:
    """All conditions; true if there are none."""
    parts = [predicate(c, object_type.field(c.field).data_type, now) for c in conditions]
    return reduce(Column.__and__, parts, F.lit(True))


def free_text(object_type: ObjectType, needle: str, fields: list[str] | None = None) -> Column:
    """Any searchable field holds the needle, upper and lower case alike; a blank needle matches all."""
    if not needle.strip():
        return F.lit(True)
    names = fields if fields is not None else [f.name for f in object_type.fields if f.searchable]
    hits = [F.coalesce(F.contains(F.lower(F.col(n).cast("string")), F.lit(needle.lower())), F.lit(False)) for n in names]
    return reduce(Column.__or__, hits, F.lit(False))
