"""Coercion to declared types that refuses what plain casts would bend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import STORED

TRUE = ("true", "t", "yes", "y", "on", "1")
FALSE = ("false", "f", "no", "n", "off", "0")


def coerce(value: Column, data_type: str, zone: str | None = None) -> Column:
    """A text column in a declared type, NULL where it does not fit.

    Integers take surrounding blanks but no fraction; decimals are refused beyond 29 integer digits or
    9 decimals, never rounded; dates are ISO without a time; timestamps are refused with an offset;
    timestamptz needs an offset, or a declared zone that a naive text is then read in.
    """
    text = F.trim(value.cast("string"))
    if data_type == "string":
        return value.cast("string")
    if data_type == "integer":
        return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))
    if data_type == "number":
        return text.try_cast("double")
    if data_type == "boolean":
        low = F.lower(text)
        return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False).when(low.rlike(r"\A[+-]?[0-9]+\z"), True)
    if data_type == "decimal":
        return F.when(text.rlike(r"\A[+-]?0*[0-9]{0,29}(\.[0-9]{0,9}0*)?\z") & text.rlike("[0-9]"), text.try_cast(STORED["decimal"]))
    if data_type == "date":
        return F.when(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), text.try_cast("date"))
    naive = text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?\z")
    if data_type == "timestamp":
        return F.when(naive, text.try_cast("timestamp_ntz"))
    if data_type == "timestamptz":
        offset = text.rlike(r"([+-][0-9]{2}:?[0-9]{2}|Z)\z")
        read = F.when(offset, text.try_cast("timestamp"))
        return read if zone is None else F.coalesce(read, F.when(naive, F.to_utc_timestamp(text.try_cast("timestamp"), zone)))
    raise ValueError(f"unknown data type {data_type}")


def drift(rows: DataFrame, declared: dict[str, str]) -> DataFrame:
    """column, data_type, misfits, example for each declared column, in one pass over the rows."""
    made = []
    for c, t in declared.items():
        misfit = F.col(c).isNotNull() & coerce(F.col(c), t).isNull()
        made += [F.count_if(misfit).alias(f"{c}#n"), F.min(F.when(misfit, F.col(c).cast("string"))).alias(f"{c}#x")]
    wide = rows.agg(*made)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("data_type"), F.col(f"{c}#n").alias("misfits"), F.col(f"{c}#x").alias("example"))
        for c, t in declared.items()
    ])).alias("x")).select("x.*")


def lenient(rows: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Typed columns, NULL on a misfit, each with the text as it was in a column named <column>_raw."""
    typed = {c: coerce(F.col(c), t) for c, t in declared.items()}
    return rows.withColumns({f"{c}_raw": F.col(c).cast("string") for c in declared}).withColumns(typed)
