"""Row and column security inside the plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Ontology, User
from .filters import Condition

Load = Callable[[str], DataFrame]
BOUNDARY = "_security"


def with_boundary(ontology: Ontology, type_name: str, load: Load) -> DataFrame:
    """Objects with their boundary: their own field's value, or that of the object a link chain ends at.

    The chain is left joins on ids; which side to broadcast is left to the sizes that Spark sees.
    """
    t = ontology.types[type_name]
    rows = load(type_name)
    if t.security is None:
        return rows.withColumn(BOUNDARY, F.lit(None).cast("string"))
    if t.security.via is None:
        return rows.withColumn(BOUNDARY, F.col(t.security.field).cast("string"))
    link = t.field(t.security.via)
    target = ontology.types[link.links_to]
    up = with_boundary(ontology, target.name, load).select(F.col(target.id_field).alias("_up"), BOUNDARY)
    return rows.join(up, F.col(link.name) == F.col("_up"), "left").drop("_up")


def visible(ontology: Ontology, type_name: str, user: User, load: Load) -> DataFrame:
    """The objects a user may read. No boundary declared: all of them; a NULL boundary or clearance: none."""
    if not user.may("read", type_name):
        return load(type_name).filter(F.lit(False))
    if ontology.types[type_name].security is None:
        return load(type_name)
    return with_boundary(ontology, type_name, load).filter(F.col(BOUNDARY) == F.lit(user.security_value)).drop(BOUNDARY)


def readable(ontology: Ontology, type_name: str, user: User, rows: DataFrame) -> DataFrame:
    """The rows with fields that the user may not read set to NULL."""
    t = ontology.types[type_name]
    own = {f.name for f in t.fields}
    return rows.select([
        F.col(c) if c not in own or c == t.id_field or user.may("read", type_name, c) else F.lit(None).cast(rows.schema[c].dataType).alias(c)
        for c in rows.columns
    ])


def visible_schema(ontology: Ontology, user: User) -> dict[str, list[str]]:
    """Fields that a user may discover, by type."""
    return {
        t.name: [f.name for f in t.fields if user.may("discover", t.name, f.name)]
        for t in ontology.types.values() if user.may("discover", t.name)
    }


def reauthorise(ontology: Ontology, type_name: str, conditions: list[Condition], user: User) -> tuple[list[Condition], list[Condition]]:
    """Conditions of a saved view that still run, and those that the user may no longer use."""
    names = {f.name for f in ontology.types[type_name].fields}
    runs = [c for c in conditions if c.field in names and user.may("read", type_name, c.field)]
    return runs, [c for c in conditions if c not in runs]


def field_catalog(ontology: Ontology) -> list[tuple[str, str, str, str, int]]:
    """(type, field, table, column, position), the identifier first."""
    out = []
    for t in ontology.types.values():
        ordered = sorted(t.fields, key=lambda f: f.name != t.id_field)
        out += [(t.name, f.name, t.table, f.source, k) for k, f in enumerate(ordered)]
    return out


def partitions_touched(rows: DataFrame, security_value: str | None) -> DataFrame:
    """One row on a read before its filter: objects considered, denied, and distinct boundaries."""
    allowed = F.coalesce(F.col(BOUNDARY) == F.lit(security_value), F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("considered"), F.count_if(~allowed).alias("denied"), F.countDistinct(BOUNDARY).alias("partitions"),
    )


def visible_values(ontology: Ontology, type_name: str, user: User, load: Load) -> DataFrame:
    """field, filled: the fields that a user may discover, each with how many of the objects they may read have a value they may read."""
    rows = readable(ontology, type_name, user, visible(ontology, type_name, user, load))
    names = visible_schema(ontology, user).get(type_name, [])
    if not names:
        return rows.limit(0).select(F.lit("").alias("field"), F.lit(0).cast("long").alias("filled"))
    counts = rows.agg(F.lit(0).alias("_"), *[F.count(n).alias(n) for n in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("filled")) for n in names])).alias("f")).select("f.*")


def denied_bitmaps(rows: DataFrame, key: str, security_value: str | None) -> DataFrame:
    """Which objects a read denies: boundary, bucket, bitmap and n, a row for each boundary and 32,768 ids.

    rows carry their boundary and a number as key, from 0 up. What is kept of a read are a few rows,
    however many objects it denies; denied_ids gives the ids back.
    """
    allowed = F.coalesce(F.col(BOUNDARY) == F.lit(security_value), F.lit(False))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.col(key) + 1)).alias("bitmap")  # Spark numbers bits from 1
    made = rows.filter(~allowed).groupBy(F.col(BOUNDARY).alias("boundary"), F.bitmap_bucket_number(F.col(key) + 1).alias("bucket")).agg(bits)
    return made.withColumn("n", F.bitmap_count("bitmap"))


def denied_ids(bitmaps: DataFrame) -> DataFrame:
    """boundary and id of every object in the bitmaps."""
    byte = bitmaps.select("boundary", "bucket", F.posexplode(F.split(F.hex("bitmap"), "(?<=\\G..)")).alias("at", "hex")).filter("hex <> '' and hex <> '00'")
    bits = byte.select("boundary", "bucket", "at", F.conv("hex", 16, 10).cast("int").alias("byte"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    held = bits.filter(F.expr("(byte & shiftleft(1, bit)) <> 0"))
    return held.select("boundary", ((F.col("bucket") - 1) * 32_768 + F.col("at") * 8 + F.col("bit")).alias("id"))


def per_user_counts(rows: DataFrame, users: DataFrame) -> DataFrame:
    """How many objects each user sees, in one job; users: user_id, security_value. Users without any count 0."""
    by = rows.groupBy(F.col(BOUNDARY).alias("security_value")).agg(F.count(F.lit(1)).alias("n"))
    return users.join(by, "security_value", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("n"))


def crossings(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Actions that read one boundary and write another; both: action_id, label. NULL labels are ignored."""
    r, w = reads.select("action_id", F.col("label").alias("read_label")), writes.select("action_id", F.col("label").alias("write_label"))
    return r.join(w, "action_id").filter(F.col("read_label") != F.col("write_label")).distinct()
