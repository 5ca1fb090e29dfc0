"""Sharding by a hierarchical weighted hash tree.

A tree has regions, a region racks, a rack shards; every shard has a weight and a node's weight is
the sum below it. A row descends the tree: at each level every child draws ``-ln(u) / weight`` with u
hashed from the row's key and the child's id, and the smallest draw wins. So a child gets rows in
proportion to its weight, and a change of weight moves rows only into or out of the child that
changed: other siblings' draws stay as they were, and subtrees whose weights are unchanged keep
their rows apart from those that a changed sibling takes or gives up. ``grow`` adds a shard as a
region of its own, so that rows move into the new shard and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objectlake.session import materialise

from .expressions import text_or_empty

#: Rows that one bucket of a shard is meant to hold while slots are numbered.
SLOT_ROWS = 20_000


@dataclass(frozen=True)
class Shard:
    """A leaf: its number and its weight."""

    number: int
    weight: float = 1.0


@dataclass(frozen=True)
class Node:
    """A region or a rack. Children keep their ids when others are added or removed."""

    id: int
    children: tuple

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children)


def base_tree(n_shards: int = 24, rack_size: int = 4, region_racks: int = 3) -> tuple[Node, ...]:
    """Regions of region_racks racks of rack_size shards of equal weight, filled in order."""
    racks = [
        Node(100_000 + first, tuple(Shard(k) for k in range(first, min(first + rack_size, n_shards))))
        for first in range(0, n_shards, rack_size)
    ]
    return tuple(
        Node(200_000 + racks[first].children[0].number, tuple(racks[first : first + region_racks]))
        for first in range(0, len(racks), region_racks)
    )


def grow(tree: tuple[Node, ...], weight: float = 1.0) -> tuple[Node, ...]:
    """The tree with one more shard, in a new region; rows move only into that shard."""
    number = 1 + max(s.number for region in tree for rack in region.children for s in rack.children)
    return (*tree, Node(200_000 + number, (Node(100_000 + number, (Shard(number, weight),)),)))


def _draw(key: Column, node: int, weight: float) -> Column:
    """Exponential with rate weight; 52 hash bits, so that every u is a double in (0, 1)."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / F.lit(float(weight))


def _descend(key: Column, children: tuple) -> Column:
    """The shard number that a key reaches below these siblings."""
    if isinstance(children[0], Shard):
        drawn = [F.struct(_draw(key, s.number, s.weight), F.lit(s.number).alias("n")) for s in children]
        return F.least(*drawn)["n"] if len(drawn) > 1 else F.lit(children[0].number)
    if len(children) == 1:
        return _descend(key, children[0].children)
    drawn = [F.struct(_draw(key, c.id, c.weight), F.lit(c.id).alias("n")) for c in children]
    won = F.least(*drawn)["n"]
    return F.transform(
        F.array(won),
        lambda w: F.coalesce(*[F.when(w == c.id, _descend(key, c.children)) for c in children]),
    )[0]


def shard_of(key: Column, tree: tuple[Node, ...]) -> Column:
    """The shard (int) of a key column of any type; a null key counts as one key of its own."""
    return _descend(F.coalesce(key.cast("string"), F.lit("\0null")), tree).cast("int")


def assign(docs: DataFrame, tree: tuple[Node, ...] | None = None) -> DataFrame:
    """docs with size (UTF-8 bytes + 8), text_crc32, shard and grown_shard in place of their text.

    Null text counts as empty; a null doc_id is a key like any other; repeated rows share a shard.
    """
    tree = base_tree() if tree is None else tree
    text = text_or_empty()
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), tree).alias("shard"),
        shard_of(F.col("doc_id"), grow(tree)).alias("grown_shard"),
    )


def number_slots(assigned: DataFrame) -> DataFrame:
    """assigned with slot: 0, 1, ... within each shard, without gathering a shard in one task.

    Rows of a shard are dealt into buckets by the hash of that number; a bucket's first slot is the
    number of rows in the shard's buckets before it. Only one short row per bucket is summed up.
    The rows are written down with a number of their own first and are dealt by it, so that a row
    repeated very often doesn't gather in one task.
    Rows that are alike in every column may swap slots.
    """
    numbered = materialise(assigned.withColumn("_row", F.monotonically_increasing_id()), "assigned")
    n_buckets = max(1, numbered.count() // SLOT_ROWS)
    dealt = numbered.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(n_buckets)))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        dealt.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    own = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "size", "text_crc32")
    return (
        dealt.withColumn("_own", F.row_number().over(own) - 1)
        .join(first, ["shard", "_bucket"])
        .withColumn("slot", (F.col("_first") + F.col("_own")).cast("long"))
        .drop("_bucket", "_own", "_first", "_row")
    )


def shard_documents(docs: DataFrame, tree: tuple[Node, ...] | None = None) -> DataFrame:
    """Where each document goes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    An empty table gives no rows; further columns of docs, whatever their names, are not read.
    """
    return number_slots(assign(docs.select("doc_id", "text"), tree)).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, tree: tuple[Node, ...] | None = None) -> None:
    """The documents themselves as Parquet, one folder shard=N each.

    Files are split by a hash beside the shard, so that a heavy shard is written by many tasks.
    """
    tree = base_tree() if tree is None else tree
    placed = docs.withColumn("shard", shard_of(F.col("doc_id"), tree))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)
