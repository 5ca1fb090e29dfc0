"""Change capture between snapshots, histories and drift verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ..sources.lake import Generation

#: Missing ids, or net rows, beyond which a read is taken for a partial one.
SUSPECT = 0.5
WIDENED = {("int", "bigint"), ("float", "double"), ("date", "timestamp"), ("smallint", "int")}


class PartialRead(ValueError):
    """A snapshot that lost too much to be believed."""


def _as_text(rows: DataFrame, key: str, columns: list[str], side: str) -> DataFrame:
    values = F.struct(*[F.col(c).cast("string").alias(c) for c in columns])
    return rows.select(F.col(key).cast("string").alias("id"), values.alias(side))


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """id, change (INSERT, UPDATE, DELETE) and the row's values as text; a delete has the last ones.

    Ids and values compare as text, NULL equal to NULL. One full outer join on the id.
    """
    columns = sorted(set(old.columns) | set(new.columns))
    missing = lambda df: df.withColumns({c: F.lit(None).cast("string") for c in columns if c not in df.columns})
    both = _as_text(missing(old), key, columns, "before").join(_as_text(missing(new), key, columns, "after"), "id", "full")
    change = (
        F.when(F.col("before").isNull(), "INSERT").when(F.col("after").isNull(), "DELETE")
        .when(~F.col("before").eqNullSafe(F.col("after")), "UPDATE")
    )
    return both.withColumn("change", change).filter("change is not null").select("id", "change", F.coalesce("after", "before").alias("values"))


def generation_diff(old: Generation, new: Generation, table: str) -> DataFrame:
    """diff of a table that both generations publish by buckets of ids: only buckets that differ are read and joined."""
    changed = new.differing(table, old)
    return diff(old.read(table, changed), new.read(table, changed), new.entry(table)["key"])


def checked_diff(old: DataFrame, new: DataFrame, key: str, accept: bool = False) -> DataFrame:
    """diff, unless more than half of the old ids are missing and that has not been accepted. The join runs once; its result is written out."""
    return checked(diff(old, new, key), lambda: old.select(key).distinct().count(), accept)


def checked(found: DataFrame, all_ids: Callable[[], int], accept: bool = False) -> DataFrame:
    """Changes written out, unless they take away more than half of all ids and that has not been accepted."""
    found = materialise(found, "changes")
    if not accept:
        gone, all_ = found.filter("change = 'DELETE'").count(), all_ids()
        if all_ and gone > SUSPECT * all_:
            raise PartialRead(f"{gone} of {all_} ids are missing")
    return found


def partial_read(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: rows before and after, and whether less than half is left."""
    n, m = old.agg(F.count(F.lit(1)).alias("before")), new.agg(F.count(F.lit(1)).alias("after"))
    return n.crossJoin(m).withColumn("refused", F.col("after") < SUSPECT * F.col("before"))  # one row by one row


def as_history(changes: DataFrame, publication: int) -> DataFrame:
    """Changes as history rows: object_id, change, values (sorted JSON), publication."""
    return changes.select(
        F.col("id").alias("object_id"), "change", F.to_json("values", {"ignoreNullFields": "false"}).alias("values"), F.lit(publication).alias("publication")
    )


def history_of(history: DataFrame, object_id: str) -> DataFrame:
    return history.filter(F.col("object_id") == object_id).orderBy("publication")


def removed_column_verdicts(missing: DataFrame, edits: DataFrame) -> DataFrame:
    """field, verdict: absorbed if no applied or pending edit touches the field, else refused.

    missing: field. edits: field, status, n, or field with NULL n where the log could not be read.
    """
    touched = edits.filter(F.col("status").isin("applied", "pending")).groupBy("field").agg(
        F.sum("n").alias("touches"), F.max(F.col("n").isNull()).alias("unknown")
    )
    refused = F.coalesce(F.col("unknown"), F.lit(False)) | (F.coalesce("touches", F.lit(0)) > 0)
    return missing.join(touched, "field", "left").select("field", F.when(refused, "refused").otherwise("absorbed").alias("verdict"))


def type_change_verdicts(misfits: DataFrame) -> DataFrame:
    """column, data_type, verdict: refused wherever a value no longer fits its declared type; misfits: column, data_type, misfits."""
    return misfits.select("column", "data_type", F.when(F.col("misfits") > 0, "refused").otherwise("absorbed").alias("verdict"))


def misfits_of_old_types(drifted: DataFrame, rows: DataFrame) -> DataFrame:
    """drifted (of type_drift) with misfits: how many values of the new rows can't be read under the old type."""
    changed = drifted.select("column", "was").collect()  # a row for each column at most
    counts = rows.agg(F.lit(0).alias("_"), *[F.count_if(F.col(r["column"]).isNotNull() & F.col(r["column"]).cast("string").try_cast(r["was"]).isNull()).alias(r["column"]) for r in changed])
    each = counts.select(F.explode(F.array(*[F.struct(F.lit(r["column"]).alias("column"), F.col(r["column"]).alias("misfits")) for r in changed])).alias("c")).select("c.*") if changed else counts.select(F.lit("").alias("column"), F.lit(0).cast("long").alias("misfits")).limit(0)
    return drifted.join(each, "column")


def type_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """column, was, now, verdict (widened or CHANGED) for columns whose source type changed; both: column, type."""
    both = before.select("column", F.col("type").alias("was")).join(after.select("column", F.col("type").alias("now")), "column").filter("was <> now")
    pairs = F.struct("was", "now").isin([F.struct(F.lit(a).alias("was"), F.lit(b).alias("now")) for a, b in sorted(WIDENED)])
    return both.withColumn("verdict", F.when(pairs, "widened").otherwise("CHANGED"))


def columns_changed(before: DataFrame, after: DataFrame) -> bool:
    return set(before.columns) != set(after.columns)
