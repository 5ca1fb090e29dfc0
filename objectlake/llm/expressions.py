"""Small Column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that separate words: blank and \t to \r.
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, although body names it many times."""
    return F.transform(F.array(value), body)[0]


def call(name: str, *args: Column) -> Column:
    return F.call_function(name, *args)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def count_of(text: Column, characters: str) -> Column:
    """How many code points of text are among characters."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def unused(rows: DataFrame, name: str) -> str:
    """A column name like this one that rows do not have, upper and lower case alike."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def thinned(rows: DataFrame, by: Column, total: int, wanted: int) -> DataFrame:
    """About 1.5 times the wanted rows of total, those with the smallest hashes by; all if there are few.

    So that a bounded sample by order of hash is drawn from little more than itself, and not from the
    first rows of every task.
    """
    share = 1.5 * wanted / max(total, 1)
    return rows if share >= 1 else rows.filter(F.shiftrightunsigned(by, 12) < int(share * (1 << 52)))
