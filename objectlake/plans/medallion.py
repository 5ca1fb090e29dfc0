"""Sync: a source through bronze and silver to gold, each layer a published version."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import coerce, drift
from ..functions.text import standardised
from ..model import ObjectType
from ..operators import changes, clean, fuse, objects
from ..session import discard, materialise
from ..sources import tables
from ..sources.lake import Generation, Lake


class Drift(ValueError):
    """A column no longer fits its declared type."""


@dataclass(frozen=True)
class Identity:
    """How rows of several synced tables become one object.

    sources: name to (synced table, its key), the naming source first; their columns are the type's.
    match_on: the fields on which rows of one object agree; order: by field, the sources to prefer;
    security: the field in which the rows of one object must not differ.
    """

    sources: dict[str, tuple[str, str]]
    match_on: list[str]
    order: dict[str, list[str]] | None = None
    security: str | None = None


def targets(types: list[ObjectType], link_tables: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """table to the columns that some type or link needs."""
    wanted: dict[str, list[str]] = {}
    for t in types:
        have = wanted.setdefault(t.table, [])
        have += [f.source for f in t.fields if f.source not in have]
    for name, columns in (link_tables or {}).items():
        have = wanted.setdefault(name, [])
        have += [c for c in columns if c not in have]
    return wanted


def sync(lake: Lake, name: str, source: DataFrame, key: str, declared: dict[str, str], rules: list[clean.Constraint]) -> int:
    """One table: bronze as text, its changes since the last time, then silver; the silver version.

    Text is standardised before it is typed; any misfit refuses the table; expectations come before
    duplicates; what they hold goes to quarantine. Bronze and its changes become visible at once, and so do
    silver and what is held, so a sync that failed anywhere may be run again. Silver isn't made again from
    the same bronze version by the same rules.
    """
    bronze, silver = f"bronze_{name}", f"silver_{name}"
    with lake.together() as now:  # the changes become visible with the version that they lead to
        rows, last = tables.as_bronze(source.select(*declared)), now.entry(bronze)
        version = now.publish_buckets(bronze, rows, key)
        if last is not None and version != last["version"]:
            if now.entry(bronze)["rows"] < changes.SUSPECT * last["rows"]:
                raise changes.PartialRead(name)
            found = changes.checked(changes.generation_diff(Generation(lake, now.number, now.tables), now, bronze), lambda: last["rows"])
            now.append("changelog", found.select(F.lit(name).alias("table"), "id", "change", F.to_json("values").alias("values"), F.current_timestamp().alias("recorded_at")))
            discard(found)
    with lake.together() as now:
        made_from = sha256(repr((now.latest(bronze), key, sorted(declared.items()), rules)).encode()).hexdigest()
        if now.about(silver) == made_from:
            return now.latest(silver)
        return _silver(now, name, now.read(bronze), key, declared, rules, made_from)


def _silver(now: Generation, name: str, rows: DataFrame, key: str, declared: dict[str, str], rules: list[clean.Constraint], made_from: str) -> int:
    tidy = standardised(rows, [c for c, t in declared.items() if t == "string"])
    misfits = drift(tidy, declared).filter("misfits > 0").collect()  # a row for each declared column at most
    if misfits:
        raise Drift(f"{name}: {[r.asDict() for r in misfits]}")
    typed = tidy.select([coerce(F.col(c), t).alias(c) for c, t in declared.items()])
    kept, held, _ = clean.expectations(typed, rules)
    kept, doubled = clean.split_duplicates(kept, [key])
    finding = lambda df, field, reason: df.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("object_id"), field.alias("field"), reason.alias("reason"), F.current_timestamp().alias("detected_at"))
    now.append("quarantine", finding(held, F.col("_rule.field"), F.col("_rule.reason")).unionByName(finding(doubled, F.lit(key), F.lit("duplicate"))))
    return now.publish(f"silver_{name}", clean.with_lineage(kept, "source", name), about=made_from)


def resolved_gold(lake: Generation, t: ObjectType, rule: Identity, approved: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One row for each object of all sources, with _fused_from; the conflicts: losing values and refused merges; and the written table behind both."""
    columns = {f.source: f.name for f in t.fields if f.name != t.id_field}
    fields = list(columns.values())
    sources = {name: (lake.read(f"silver_{table}").withColumnsRenamed(columns), key) for name, (table, key) in rule.sources.items()}
    found = materialise(fuse.resolve(fuse.sourced(sources, fields), rule.match_on, rule.security, approved), "resolved")
    chosen = fuse.survivors(found, fields, rule.order)
    losing = fuse.conflicts(found, chosen, fields).withColumn("kind", F.lit("property"))
    if rule.security:
        refused = found.filter("refused").select("entity_id", F.lit(rule.security).alias("field"), F.col(rule.security).cast("string").alias("losing"), F.col("source").alias("losing_source"), F.lit("security").alias("kind"))
        losing = losing.unionByName(refused, allowMissingColumns=True)
    return chosen.select(F.col("entity_id").alias(t.id_field), *fields, "_fused_from"), losing, found


def waves(types: list[ObjectType]) -> list[list[ObjectType]]:
    """The types in order of their links: targets before the types that link to them, cycles together."""
    out, left = [], list(types)
    while left:
        names = {t.name for t in left}
        ready = [t for t in left if not ({f.links_to for f in t.fields if f.links_to} & names - {t.name})] or left
        out.append(ready)
        left = [t for t in left if t not in ready]
    return out


def build_gold(
    lake: Lake, types: list[ObjectType], threads: int = 4, identities: dict[str, Identity] | None = None, approved: dict[str, DataFrame] | None = None,
    refused: dict[str, str] | None = None,
) -> dict[str, int]:
    """One gold table for each type, audited before it is published, with its history and conflicts appended.

    A type with an Identity is resolved from its sources, approved pairs included; others are conformed
    from one table. The audit counts links to objects that are in no table of their type. Tables are
    submitted side by side, targets of links first, from one generation of silver tables, and all become
    visible in one generation, so that no reader joins new objects with old ones. A type whose table is not
    synced, or whose audit fails (its problems go to refused), leaves the others alone and what it has
    published as it was.
    """
    ids = {t.name: t.id_field for t in types}
    out: dict[str, int] = {}
    failed: list[tables.AuditFailed] = []

    def one(now: Generation, t: ObjectType) -> int:
        rule, losing, written, gold = (identities or {}).get(t.name), None, [], f"gold_{t.name}"
        if rule:
            rows, losing, *written = resolved_gold(now, t, rule, (approved or {}).get(t.name))
        else:
            rows = t.conform(now.read(f"silver_{t.table}"))
        rows = rows.withColumns({t.id_field: F.col(t.id_field).cast("string"), **{f.name: F.col(f.name).cast("string") for f in t.fields if f.links_to}})
        there = {f.name: (now.read(f"gold_{f.links_to}"), ids[f.links_to]) for f in t.fields if f.links_to in ids and f.links_to != t.name and now.latest(f"gold_{f.links_to}")}
        audit = lambda new, old: tables.audit(new, t.id_field, [f.name for f in t.fields if f.required], there, old.count() if old is not None else None)
        last, before = now.latest(gold), now.before(gold)
        version = now.publish(gold, rows, audit)
        if version != last:
            if before is not None:
                now.append(f"gold_history_{t.name}", changes.as_history(changes.diff(before, now.read(gold), t.id_field), version))
            if losing is not None:
                now.append(f"gold_conflicts_{t.name}", losing.select("entity_id", "kind", "field", "chosen", "chosen_source", "losing", "losing_source", F.lit(version).alias("version")))
        discard(*written)
        return version

    with lake.together() as now, ThreadPoolExecutor(threads) as pool:
        for wave in waves(types):
            for t, done in [(t, pool.submit(one, now, t)) for t in wave]:
                try:
                    out[t.name] = done.result()
                except KeyError:  # its table has not been synced
                    continue
                except tables.AuditFailed as e:
                    failed.append(e)
                    if refused is not None:
                        refused[t.name] = str(e)
    if failed and refused is None:
        raise failed[0]
    return out


def publish_join_tables(lake: Lake, links: dict[str, tuple[str, str, str, str, str]]) -> dict[str, int]:
    """The version of each join table published beside the gold tables.

    links: by table, its two key columns, the two object types they name and the silver table to read.
    Ids of gold tables are strings, so keys are too.
    """
    out = {}
    for name, (left, right, source, target, silver) in links.items():
        pairs = lake.read(f"silver_{silver}").select(F.col(left).cast("string").alias(left), F.col(right).cast("string").alias(right))
        out[name] = lake.publish(f"gold_link_{name}", objects.join_table(pairs, lake.read(f"gold_{source}"), lake.read(f"gold_{target}")))
    return out
