"""Fusion of storages, identity resolution and survivorship."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import connected_components

#: Fellegi-Sunter: agreement given a match and given none, and the share of pairs that match.
M, U, PRIOR = 0.9, 0.01, 0.001
REVIEW, PROPOSE = 0.8, 0.95


def fuse(storages: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """object_id, every storage's other columns, _fused_from. storages: name to (rows, id column).

    Ids compare as text; NULL ids are dropped; of rows that share an id the one with the greatest values stands.
    """
    sides = []
    for name, (rows, key) in storages.items():
        others = sorted(c for c in rows.columns if c != key)
        one = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("object_id")).agg(F.max(F.struct(*others)).alias("_r"))
        sides.append(one.select("object_id", *[F.col(f"_r.{c}").alias(c) for c in others], F.lit(name).alias(f"_in_{name}")))
    both = reduce(lambda a, b: a.join(b, "object_id", "full"), sides)
    marks = [f"_in_{n}" for n in storages]
    return both.withColumn("_fused_from", F.array_join(F.array_sort(F.array_compact(F.array(*marks))), ",")).drop(*marks)


def sourced(sources: dict[str, tuple[DataFrame, str]], columns: list[str]) -> DataFrame:
    """Rows of all sources under one shape: source, rank (its place), source_id, columns."""
    parts = [
        rows.select(F.lit(name).alias("source"), F.lit(k).alias("rank"), F.col(key).cast("string").alias("source_id"), *columns)
        for k, (name, (rows, key)) in enumerate(sources.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def _key(columns: list[str]) -> Column:
    """A digest of the match key, NULL if a part is NULL or blank; keys may be long texts, which are not shuffled."""
    parts = [F.trim(F.col(c).cast("string")) for c in columns]
    whole = reduce(Column.__and__, [p.isNotNull() & (p != "") for p in parts])
    return F.when(whole, F.sha2(F.to_json(F.struct(*[p.alias(c) for p, c in zip(parts, columns, strict=True)])), 256))


def entity_id(source: str = "source", rank: str = "rank", source_id: str = "source_id") -> Column:
    """The first source's id as it is, other sources' with the source's name."""
    return F.when(F.col(rank) == 0, F.col(source_id)).otherwise(F.concat_ws(":", source, source_id))


def join_groups(rows: DataFrame, approved: DataFrame) -> DataFrame:
    """rows with the groups (_group) that approved pairs connect made one, transitively.

    approved: left, right, each <source>:<source_id>; a pair that names an unknown row counts for nothing.
    """
    named = rows.select(F.concat_ws(":", "source", "source_id").alias("_name"), "_group").distinct()
    end = lambda side, to: named.select(F.col("_name").alias(side), F.col("_group").alias(to))
    pairs = approved.select("left", "right").distinct().join(end("left", "a"), "left").join(end("right", "b"), "right").select("a", "b")
    joined = connected_components(pairs, kind="string").select(F.col("id").alias("_group"), "component")
    return rows.join(joined, "_group", "left").withColumn("_group", F.coalesce("component", "_group")).drop("component")


def resolve(rows: DataFrame, match_on: list[str], security: str | None = None, approved: DataFrame | None = None) -> DataFrame:
    """rows (of sourced) with entity_id and refused.

    Rows that agree on the key are one entity, named by the member of the first source, smallest id
    first. A row without a whole key stands alone. Approved pairs (see join_groups) join groups that the
    key left apart. With security, a group whose members differ in it is
    refused: its rows stand alone. Groups are aggregated and joined back, so a hot key is not gathered.
    """
    alone = F.concat_ws(":", F.lit("row"), "source", "source_id")
    own = rows.withColumn("_group", F.coalesce(_key(match_on), alone)).withColumn("_own", entity_id())
    if approved is not None:
        own = join_groups(own, approved)
    disagree = (F.min(security) != F.max(security)) if security else F.lit(False)
    groups = own.groupBy("_group").agg(
        F.min_by("_own", F.struct("rank", "source_id")).alias("_entity"), F.coalesce(disagree, F.lit(False)).alias("_refused"),
    )
    return own.join(groups, "_group").withColumn("entity_id", F.when(F.col("_refused"), F.col("_own")).otherwise(F.col("_entity"))).withColumn(
        "refused", F.col("_refused")
    ).drop("_group", "_own", "_entity", "_refused")


def merge_approved(pairs: DataFrame) -> DataFrame:
    """(id, component) of long ids that approved pairs (a, b) join, transitively."""
    return connected_components(pairs)


def merged_count(resolved: DataFrame) -> DataFrame:
    """n: entities with rows of more than one source."""
    return resolved.groupBy("entity_id").agg(F.countDistinct("source").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n"))


def survivors(resolved: DataFrame, fields: list[str], order: dict[str, list[str]] | None = None) -> DataFrame:
    """entity_id, each field's first non-NULL value in the declared order of sources, else by rank, its source, _fused_from."""
    place = {}
    for f in fields:
        declared = (order or {}).get(f)
        rank = F.col("rank") if not declared else F.coalesce(*[F.when(F.col("source") == s, F.lit(k)) for k, s in enumerate(declared)], F.lit(len(declared)) + F.col("rank"))
        place[f] = F.min(F.when(F.col(f).isNotNull(), F.struct(rank.alias("k"), F.col("source_id").alias("i"), F.col(f).alias("v"), F.col("source").alias("s")))).alias(f"_{f}")
    chosen = resolved.groupBy("entity_id").agg(*place.values(), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("_fused_from"))
    return chosen.select("entity_id", *[F.col(f"_{f}.v").alias(f) for f in fields], *[F.col(f"_{f}.s").alias(f"{f}_source") for f in fields], "_fused_from")


def conflicts(resolved: DataFrame, chosen: DataFrame, fields: list[str]) -> DataFrame:
    """entity_id, field, chosen, chosen_source, losing, losing_source: values that differ from the surviving one."""
    renamed = chosen.select("entity_id", *[F.col(f).cast("string").alias(f"_{f}") for f in fields], *[F.col(f"{f}_source").alias(f"_{f}_source") for f in fields])
    joined = resolved.join(renamed, "entity_id")
    each = F.array_compact(F.array(*[
        F.when(
            F.col(f).cast("string") != F.col(f"_{f}"),
            F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("chosen"), F.col(f"_{f}_source").alias("chosen_source"), F.col(f).cast("string").alias("losing")),
        ) for f in fields
    ]))
    return joined.select("entity_id", F.col("source").alias("losing_source"), F.explode(each).alias("c")).select("entity_id", "c.*", "losing_source")


def candidates(left: DataFrame, right: DataFrame, compared: list[str], blocks: list[list[str]] | None = None, review: float = REVIEW, propose: float = PROPOSE) -> DataFrame:
    """left_id, right_id, probability, agreeing, disposition of likely matches; both: id and the compared fields.

    Pairs share a block (a list of fields, equal and not NULL). Agreement adds ln(m/u), disagreement
    ln((1-m)/(1-u)), a NULL on either side nothing.
    """
    l = left.select(F.col("id").alias("left_id"), *[F.col(c).alias(f"l_{c}") for c in compared])
    r = right.select(F.col("id").alias("right_id"), *[F.col(c).alias(f"r_{c}") for c in compared])
    pairs = reduce(DataFrame.unionByName, [
        l.join(r, reduce(Column.__and__, [F.col(f"l_{c}") == F.col(f"r_{c}") for c in block])) for block in (blocks or [[compared[0]]])
    ]).dropDuplicates(["left_id", "right_id"])
    agree = {c: F.col(f"l_{c}") == F.col(f"r_{c}") for c in compared}
    weight = reduce(Column.__add__, [
        F.coalesce(F.when(a, F.lit(math.log(M / U))).when(~a, F.lit(math.log((1 - M) / (1 - U)))), F.lit(0.0)) for a in agree.values()
    ]) + F.lit(math.log(PRIOR / (1 - PRIOR)))
    p = 1 / (1 + F.exp(-weight))
    return pairs.select(
        "left_id", "right_id", p.alias("probability"), F.array_join(F.array_compact(F.array(*[F.when(a, c) for c, a in agree.items()])), ",").alias("agreeing"),
    ).filter(F.col("probability") >= review).withColumn("disposition", F.when(F.col("probability") >= propose, "propose").otherwise("review"))


#: Rows of a block that are compared in one group; a larger block is cut into slices, and pairs of slices are groups.
BLOCK_ROWS = 2_000


def refined(compared: list[str], blocks: list[list[str]], review: float) -> list[tuple[str, ...]]:
    """Finer blocks that hold every likely pair of the given ones: each with as many further fields as a pair needs to reach review."""
    found: list[tuple[str, ...]] = []
    for block in blocks:
        rest = [c for c in compared if c not in block]
        agreeing = sum(c in compared for c in block)
        more = next((k for k in range(len(rest) + 1) if _probability((agreeing + k) * math.log(M / U)) >= review), None)
        if more is not None:
            found += [tuple(sorted({*block, *some})) for some in combinations(rest, more)]
    return list(dict.fromkeys(found))


def _probability(weight: float) -> float:
    return 1 / (1 + math.exp(-(weight + math.log(PRIOR / (1 - PRIOR)))))


def _weight(agree: dict[str, Column]) -> Column:
    each = [F.coalesce(F.when(a, F.lit(math.log(M / U))).when(~a, F.lit(math.log((1 - M) / (1 - U)))), F.lit(0.0)) for a in agree.values()]
    return reduce(Column.__add__, each) + F.lit(math.log(PRIOR / (1 - PRIOR)))


def _disposition(propose: float) -> Column:
    return F.when(F.col("probability") >= propose, "propose").otherwise("review")


def dedupe(
    records: DataFrame, compared: list[str], blocks: list[list[str]] | None = None, review: float = REVIEW, propose: float = PROPOSE, block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Likely matches among all records of all storages: pairs, and the classes of equal records that they stand for.

    records: id (unique text) and the compared fields, and those of blocks. Records equal in all these
    are one class, named by its smallest id. The first result has left_id, right_id, probability, agreeing
    and disposition of classes that reach review, left_id < right_id; the second id, class_id, and the
    probability and disposition that records of the class have with each other (NULL where they stay below
    review or the class has one record). Weights are those of candidates.

    A pair needs a block of which all fields agree. Each block is refined by the further fields that a
    likely pair must agree on at least, so blocks hold few pairs that fail. A pair belongs to the first
    refined block on which it agrees and is produced there alone, with its weight tested in the same
    stage. Blocks are counted first; those of more than block_rows classes are cut into slices.
    """
    named = list(dict.fromkeys([*compared, *(c for b in blocks or [] for c in b)]))
    at = {c: f"f{k}" for k, c in enumerate(named)}  # names that clash with no other column here
    records = records.select("id", *[F.col(c).alias(f) for c, f in at.items()])
    shown, fields, compared, blocks = dict(zip(at.values(), named, strict=True)), list(at.values()), [at[c] for c in compared], [[at[c] for c in b] for b in blocks or [[compared[0]]]]
    values = F.struct(*[F.col(c).cast("string").alias(c) for c in fields])
    own = records.select(F.col("id").cast("string").alias("id"), F.sha2(F.to_json(values, {"ignoreNullFields": "false"}), 256).alias("_key"), *fields)
    classes = materialise(own.groupBy("_key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in fields]), "classes")
    within = 1 / (1 + F.exp(-_weight({c: F.when(F.col(c).isNotNull(), F.lit(True)) for c in compared})))
    blocked = reduce(Column.__or__, [reduce(Column.__and__, [F.col(c).isNotNull() for c in b]) for b in blocks])
    likely = F.when((F.col("n") > 1) & blocked & (within >= review), within)
    members = own.select("id", "_key").join(classes.select("_key", "class_id", likely.alias("probability")), "_key").select(
        "id", "class_id", "probability", F.when(F.col("probability").isNotNull(), _disposition(propose)).alias("disposition")
    )

    rules = refined(compared, blocks, review)
    if not rules:
        none = classes.limit(0).select(F.col("class_id").alias("left_id"), F.col("class_id").alias("right_id"), F.lit(0.0).alias("probability"), F.lit("").alias("agreeing"))
        return none.withColumn("disposition", _disposition(propose)), members
    whole = lambda rule: reduce(Column.__and__, [F.col(c).isNotNull() for c in rule])
    keys = F.array_compact(F.array(*[F.when(whole(rule), F.struct(F.lit(k).alias("rule"), F.xxhash64(*rule).alias("block"))) for k, rule in enumerate(rules)]))
    in_blocks = classes.select("class_id", *fields, F.explode(keys).alias("b")).select("class_id", *fields, "b.*")
    sizes = in_blocks.groupBy("rule", "block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("slices", F.ceil(F.col("n") / block_rows).cast("int")).drop("n")
    sliced = materialise(in_blocks.join(sizes, ["rule", "block"]).withColumn("slice", F.pmod(F.xxhash64("class_id"), F.col("slices")).cast("int")), "blocks")
    side = lambda name, low, high: sliced.select(
        "rule", "block", F.col("class_id").alias(f"{name}_id"), *[F.col(c).alias(f"{name}_{c}") for c in fields], F.col("slice").alias(f"{name}_slice"), F.explode(F.sequence(low, high)).alias(f"{name}_other")
    )
    last = F.col("slices") - 1
    a = side("l", F.col("slice"), last).withColumnsRenamed({"l_slice": "low", "l_other": "high"})
    b = side("r", F.lit(0), F.col("slice")).withColumnsRenamed({"r_other": "low", "r_slice": "high"})
    agree = {c: F.col(f"l_{c}") == F.col(f"r_{c}") for c in fields}
    all_of = lambda rule: F.coalesce(reduce(Column.__and__, [agree[c] for c in rule]), F.lit(False))
    mine = reduce(Column.__or__, [(F.col("rule") == k) & all_of(rule) & reduce(Column.__and__, [~all_of(r) for r in rules[:k]], F.lit(True)) for k, rule in enumerate(rules)])
    once = (F.col("low") < F.col("high")) | (F.col("l_id") < F.col("r_id"))
    p = 1 / (1 + F.exp(-_weight({c: agree[c] for c in compared})))
    found = a.join(b, ["rule", "block", "low", "high"]).filter(once & mine & (p >= review))
    pairs = found.select(
        F.least("l_id", "r_id").alias("left_id"), F.greatest("l_id", "r_id").alias("right_id"), p.alias("probability"),
        F.array_join(F.array_compact(F.array(*[F.when(agree[c], shown[c]) for c in compared])), ",").alias("agreeing"),
    )
    return pairs.withColumn("disposition", _disposition(propose)), members


def propose(found: DataFrame, existing: DataFrame) -> DataFrame:
    """New proposals (left_id, right_id in order) that do not exist yet; both: left_id, right_id."""
    ordered = lambda df: df.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).distinct()
    return ordered(found).join(ordered(existing), ["left_id", "right_id"], "left_anti")


def standing(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """proposal_id and its newest decision, pending without one. decisions: proposal_id, decision, decided_at, decision_id."""
    newest = decisions.groupBy("proposal_id").agg(F.max_by("decision", F.struct("decided_at", "decision_id")).alias("decision"))
    return proposals.join(newest, "proposal_id", "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))
