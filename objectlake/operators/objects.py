"""Object sets: lazy governed queries over one object type."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import LinkType, Ontology, User
from . import filters, secure
from .secure import Load

PAGE = 50
MAX_PAGE = 500
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


class TooMany(ValueError):
    """A bulk selection is over its ceiling; it is refused, never cut."""


@dataclass(frozen=True)
class ObjectSet:
    """Objects of a type as a user sees them. Nothing runs before rows are asked for."""

    ontology: Ontology
    type_name: str
    load: Load
    user: User
    rows: DataFrame

    @classmethod
    def of(cls, ontology: Ontology, type_name: str, load: Load, user: User) -> ObjectSet:
        return cls(ontology, type_name, load, user, secure.visible(ontology, type_name, user, load))

    @property
    def type(self):
        return self.ontology.types[self.type_name]

    @property
    def id(self) -> str:
        return self.type.id_field

    def where(self, *conditions: filters.Condition, now: datetime | None = None) -> ObjectSet:
        return replace(self, rows=self.rows.filter(filters.where(list(conditions), self.type, now)))

    def text(self, needle: str) -> ObjectSet:
        return replace(self, rows=self.rows.filter(filters.free_text(self.type, needle)))

    def among(self, ids: DataFrame) -> ObjectSet:
        """Those whose id is in the first column of ids."""
        wanted = ids.select(F.col(ids.columns[0]).alias(self.id)).distinct()
        return replace(self, rows=self.rows.join(wanted, self.id, "left_semi"))

    def without(self, ids: DataFrame) -> ObjectSet:
        wanted = ids.select(F.col(ids.columns[0]).alias(self.id)).distinct()
        return replace(self, rows=self.rows.join(wanted, self.id, "left_anti"))

    def count(self) -> DataFrame:
        return self.rows.agg(F.count(F.lit(1)).alias("n"))

    def ids(self, ceiling: int | None = None) -> DataFrame:
        """Ids; with a ceiling, a larger set raises TooMany."""
        found = self.rows.select(self.id)
        if ceiling is not None and found.limit(ceiling + 1).count() > ceiling:
            raise TooMany(f"more than {ceiling} objects match")
        return found

    def truncated(self, cap: int) -> tuple[DataFrame, bool]:
        """At most cap rows in id order, and whether there are more."""
        ordered = self.rows.orderBy(self.id)
        return ordered.limit(cap), ordered.limit(cap + 1).count() > cap

    def aggregate(self, how: str, field: str | None = None, by: str | None = None) -> DataFrame:
        """group and value. NULL groups go, and NULL values where a field is named; no rows, no groups."""
        for name in (field, by):
            if name and self.type.field(name).links_to and name == field:
                raise ValueError("links cannot be aggregated")
        rows = self.rows
        for name in (by, field):
            rows = rows.filter(F.col(name).isNotNull()) if name else rows
        value = AGGREGATES[how](F.col(field) if field else F.lit(1)).alias("value")
        if by is None:
            return rows.agg(value, F.count(F.lit(1)).alias("_n")).filter("_n > 0").select(F.lit("").alias("group"), "value")
        return rows.groupBy(F.col(by).alias("group")).agg(value)

    def link_pairs(self, name: str) -> tuple[DataFrame, LinkType]:
        """(source_id, target_id) of a link from this set; ids of forward, reverse and join-table links alike."""
        link = self.ontology.link(self.type_name, name)
        source_id, target_id = F.col(self.id).alias("source_id"), self.ontology.types[link.target].id_field
        if link.via_table:
            via = self.load(link.via_table).select(F.col(link.via_source).alias("source_id"), F.col(link.via_target).alias("target_id"))
            return self.rows.select(source_id).join(via.filter("target_id is not null").distinct(), "source_id"), link
        own = {f.name for f in self.type.fields}
        if link.field in own and self.type.field(link.field).links_to == link.target:
            return self.rows.select(source_id, F.col(link.field).alias("target_id")).filter("target_id is not null"), link
        other = self.load(link.target).select(F.col(link.field).alias("source_id"), F.col(target_id).alias("target_id"))
        return self.rows.select(source_id).join(other, "source_id"), link

    def search_around(self, name: str) -> ObjectSet:
        """The distinct objects that the user sees at the other end of a link."""
        pairs, link = self.link_pairs(name)
        there = ObjectSet.of(self.ontology, link.target, self.load, self.user)
        return there.among(pairs.select("target_id"))

    def reverse_links(self, name: str) -> DataFrame:
        """(source_id, target_id), one row for each visible target; a source without any has no row."""
        pairs, link = self.link_pairs(name)
        there = ObjectSet.of(self.ontology, link.target, self.load, self.user)
        return pairs.join(there.rows.select(F.col(there.id).alias("target_id")), "target_id", "left_semi").select("source_id", "target_id").distinct()

    def link_counts(self, *names: str) -> DataFrame:
        """source_id, link, n: distinct visible targets of each link of each object, 0 among them."""
        out = None
        for name in names:
            pairs, link = self.link_pairs(name)
            there = ObjectSet.of(self.ontology, link.target, self.load, self.user)
            seen = pairs.join(there.rows.select(F.col(there.id).alias("target_id")), "target_id", "left_semi")
            n = seen.groupBy("source_id").agg(F.countDistinct("target_id").alias("n"))
            each = self.rows.select(F.col(self.id).alias("source_id")).join(n, "source_id", "left").select(
                "source_id", F.lit(name).alias("link"), F.coalesce("n", F.lit(0)).alias("n")
            )
            out = each if out is None else out.unionByName(each)
        return out

    def ordered(self, order: str | None = None) -> list[Column]:
        """field or field:desc; NULL is smallest, the id breaks ties in the same direction; unknown: by id."""
        name, _, way = (order or self.id).partition(":")
        if name not in self.rows.columns:
            name, way = self.id, ""
        if way == "desc":
            return [F.col(name).desc_nulls_last(), F.col(self.id).desc()]
        return [F.col(name).asc_nulls_first(), F.col(self.id).asc()]

    def page(self, order: str | None = None, start: int = 0, size: int = PAGE) -> DataFrame:
        """A page of readable fields. The size is held between 1 and MAX_PAGE; a start outside the set is 0."""
        size = min(MAX_PAGE, max(1, size))
        start = start if start > 0 and self.rows.select(self.id).limit(start + 1).count() > start else 0
        rows = self.rows.orderBy(*self.ordered(order)).offset(start).limit(size) if start else self.rows.orderBy(*self.ordered(order)).limit(size)
        return secure.readable(self.ontology, self.type_name, self.user, rows)

    def value_counts(self, field: str, top: int = 12) -> DataFrame:
        """value, n: the most frequent values, and the rest as Other (k)."""
        n = self.rows.filter(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        shown = n.orderBy(F.desc("n"), "value").limit(top)
        total = lambda rows, a, b: rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(a), F.count(F.lit(1)).alias(b))
        other = total(n, "all", "values").crossJoin(total(shown, "seen", "bars")).filter("values > bars").select(  # one row by one row
            F.concat(F.lit("Other ("), F.col("values") - F.col("bars"), F.lit(")")).alias("value"), (F.col("all") - F.col("seen")).alias("n")
        )
        return shown.unionByName(other)

    def histogram(self, field: str) -> DataFrame:
        return self.rows.filter(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"))

    def facets(self, conditions: dict[str, filters.Condition]) -> DataFrame:
        """facet, value, n: each field's values under the conditions on all other fields.

        One scan: a row knows which conditions it meets, and counts for a facet if it meets the rest.
        """
        meets = {f: F.coalesce(filters.where([c], self.type), F.lit(False)) for f, c in conditions.items()}
        counted = []
        for f in conditions:
            others = F.lit(True)
            for g, m in meets.items():
                others = others if g == f else others & m
            counted.append(F.when(others & F.col(f).isNotNull(), F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"))))
        each = self.rows.select(F.explode(F.array_compact(F.array(*counted))).alias("x"))
        return each.groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))


class Undeclared(ValueError):
    """A function reaches for a type that it does not declare; an authoring fault, so it is not answered with nothing."""


@dataclass(frozen=True)
class Declared:
    """The object sets that a user's function may read: of the types it declares, linked among them, as its caller sees them."""

    ontology: Ontology
    load: Load
    user: User
    types: frozenset[str]

    def __call__(self, type_name: str) -> ObjectSet:
        if type_name not in self.types:
            raise Undeclared(f"{type_name} is not among the declared {sorted(self.types)}")
        return replace(ObjectSet.of(self.ontology, type_name, self.load, self.user), ontology=self._linked())

    def _linked(self) -> Ontology:
        """All types, as boundaries may run through them, but only links that end at declared ones."""
        return Ontology(self.ontology.types, {n: x for n, x in self.ontology.links.items() if {x.source, x.target} <= self.types})


def regression(rows: DataFrame, y: str, x: str, by: str) -> DataFrame:
    """Least-squares slope, intercept and R² of y on x for each group of two rows or more and more than one x."""
    some = rows.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    return (
        some.groupBy(by)
        .agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and slope is not null")
    )


def uneven_coverage(gathered: DataFrame, group: str, item: str, field: str) -> DataFrame:
    """Groups whose items were gathered with differing sets of fields: group, shapes."""
    shapes = gathered.groupBy(group, item).agg(F.sort_array(F.collect_set(field)).alias("fields"))
    return shapes.groupBy(group).agg(F.countDistinct("fields").alias("shapes")).filter("shapes > 1")


def join_table(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """A many-to-many link's pairs as they are published: key pairs alone, each once, none null or dangling.

    pairs: source and target keys in its first two columns; source and target: ids in their first column.
    """
    left, right = pairs.columns[:2]
    found = pairs.select(left, right).filter(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct()
    return (
        found.join(source.select(F.col(source.columns[0]).alias(left)), left, "left_semi")
        .join(target.select(F.col(target.columns[0]).alias(right)), right, "left_semi").select(left, right)
    )
