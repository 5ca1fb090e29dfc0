"""Keys that name each row of a table of documents, also where doc_id is null or on several rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objectlake.session import materialise

from .expressions import unused

LOWEST = -(1 << 63)


def keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two further long columns, and their names; together they name a row and order all rows.

    The first is doc_id, for null the smallest long. The second is 0 where no other row has the
    doc_id, else a number that ascends by a hash of the text, and in no given order among equal rows.
    Rows that share a doc_id are written out once, so that their numbers stay; others are not.
    """
    doc, sub = unused(docs, "doc_key"), unused(docs, "sub_key")
    rows = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)))
    shared = materialise(rows.groupBy(doc).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(doc), "shared")
    if not shared.limit(1).count():
        return rows.withColumn(sub, F.lit(0).cast("long")), doc, sub
    at, by = unused(docs, "at_key"), unused(docs, "hash_key")
    several = (
        rows.join(shared, doc, "left_semi").withColumns({at: F.monotonically_increasing_id(), by: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
        .repartitionByRange(doc, by, at).sortWithinPartitions(doc, by, at).withColumn(sub, F.monotonically_increasing_id() + 1).drop(at, by)
    )
    alone = rows.join(shared, doc, "left_anti").withColumn(sub, F.lit(0).cast("long"))
    names = [*docs.columns, doc, sub]
    return alone.select(names).unionByName(materialise(several.select(names), "several")), doc, sub
