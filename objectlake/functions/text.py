"""Standardising strings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _normalised(form: str):
    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return apply


def standardise(value: Column, form: str | None = "NFC", collapse: bool = True, null_if: tuple[str, ...] = ()) -> Column:
    """Runs of blanks on a line become one, line breaks stay, blank edges go; sentinels become NULL.

    Spark has no Unicode normalisation, so that step alone is a vectorised Python function. Spark sends it
    the column of every row; ``standardised`` keeps rows of plain ASCII away from it.
    """
    if form:
        value = F.when(value.rlike(r"[^\x00-\x7F]"), _normalised(form)(value)).otherwise(value)
    if collapse:
        value = F.regexp_replace(value, r"\r\n?", "\n")
        value = F.regexp_replace(value, r"(?U)[\s\x1c-\x1f&&[^\n]]+", " ")
        value = F.regexp_replace(value, r" ?\n ?", "\n")
        value = F.regexp_replace(value, r"\A[ \n]+|[ \n]+\z", "")
    else:
        value = F.trim(value)
    return F.when(~value.isin(*null_if), value) if null_if else value


def standardised(rows: DataFrame, columns: list[str], form: str | None = "NFC", collapse: bool = True, null_if: tuple[str, ...] = ()) -> DataFrame:
    """rows with some columns standardised. Only rows with a text beyond ASCII in them pass through Python; the source is read twice for that, with a filter."""
    if not columns:
        return rows
    tidy = lambda part, own: part.withColumns({c: standardise(F.col(c), own, collapse, null_if) for c in columns})
    if form is None:
        return tidy(rows, None)
    beyond = F.coalesce(F.greatest(*[F.col(c).rlike(r"[^\x00-\x7F]") for c in columns], F.lit(False)), F.lit(False))
    return tidy(rows.filter(~beyond), None).unionByName(tidy(rows.filter(beyond), form))
