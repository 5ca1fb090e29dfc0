"""Object types, links and users over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Declared data types and the Spark types they are stored in.
STORED = {
    "string": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "decimal": "decimal(38,9)",
    "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp",
}


@dataclass(frozen=True)
class Field:
    """A property: its column, its declared type, and the type it links to, if it is a forward link."""

    name: str
    column: str | None = None
    data_type: str = "string"
    links_to: str | None = None
    searchable: bool = False
    required: bool = False

    @property
    def source(self) -> str:
        return self.column or self.name


@dataclass(frozen=True)
class Security:
    """A boundary: a field of the object itself, or a link whose target's boundary holds."""

    field: str | None = None
    via: str | None = None


@dataclass(frozen=True)
class ObjectType:
    name: str
    table: str
    id_field: str
    fields: tuple[Field, ...]
    security: Security | None = None
    title_field: str | None = None

    def field(self, name: str) -> Field:
        found = next((f for f in self.fields if f.name == name), None)
        if found is None:
            raise KeyError(f"{self.name} has no field {name}")
        return found

    def conform(self, rows: DataFrame) -> DataFrame:
        """One projection from table columns to properties."""
        return rows.select([F.col(f.source).alias(f.name) for f in self.fields])


@dataclass(frozen=True)
class LinkType:
    """A link between two types: a foreign key on the source, or a join table."""

    name: str
    source: str
    target: str
    field: str | None = None
    via_table: str | None = None
    via_source: str | None = None
    via_target: str | None = None
    reverse: str | None = None

    def turned(self) -> LinkType:
        """The same link from the other side."""
        if self.reverse is None:
            raise ValueError(f"{self.name} declares no reverse")
        return replace(
            self, name=self.reverse, source=self.target, target=self.source, reverse=self.name,
            via_source=self.via_target, via_target=self.via_source,
        )


@dataclass(frozen=True)
class User:
    user_id: str
    security_value: str | None = None
    grants: frozenset[str] = frozenset()

    def may(self, action: str, type_name: str, field_name: str | None = None) -> bool:
        """action is read or discover; read implies discover; a grant on a type covers its fields."""
        wanted = {type_name, "*"} | ({f"{type_name}.{field_name}"} if field_name else set())
        actions = {action} | ({"read"} if action == "discover" else set())
        return any(f"{a}:{w}" in self.grants for a in actions for w in wanted)


@dataclass
class Ontology:
    """Types and links by name; expand() adds every link's other direction."""

    types: dict[str, ObjectType]
    links: dict[str, LinkType] = field(default_factory=dict)

    def expand(self) -> Ontology:
        both = dict(self.links)
        for link in self.links.values():
            if link.reverse:
                both[f"{link.target}.{link.reverse}"] = link.turned()
        return Ontology(self.types, both)

    def link(self, source: str, name: str) -> LinkType:
        found = next((x for x in self.links.values() if x.source == source and x.name == name), None)
        if found is None:
            raise KeyError(f"{source} has no link {name}")
        return found

    def without(self, excluded: set[str]) -> Ontology:
        """The types left when those that secure themselves through an excluded type go too, to a fixpoint."""
        gone = set(excluded)
        while True:
            more = {
                t.name for t in self.types.values()
                if t.name not in gone and any(f.links_to in gone for f in t.fields if f.links_to)
            }
            if not more:
                break
            gone |= more
        return Ontology(
            {n: t for n, t in self.types.items() if n not in gone},
            {n: x for n, x in self.links.items() if x.source not in gone and x.target not in gone},
        )
