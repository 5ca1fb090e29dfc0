"""Harmonic packing of documents into sequences of a fixed number of tokens.

A piece of length l is of class k = capacity // l: k pieces of a class fill a sequence, whichever
they are. So workers fill the sequences of a class without knowing each other's pieces; a piece only
needs its rank in the class. Documents may be cut, and are, so that pieces end up at the top of their
class (a half, a third, a seventh of the capacity, ...): a document longer than the capacity gives
full pieces, and what is left gives at most four more, the last of them shorter than capacity / 42.
Each class leaves one sequence unfinished, k - 1 pieces at most; those, bounded by the capacity
alone (about 21,000 pieces for 4096), are packed first-fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from objectlake.session import materialise

from .memory import released
from .tokens import checksum, id_lists, tokenizer_path, word_tokenizer

CAPACITY = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: A piece that fills its share of a sequence up to one part in so many is not cut.
TIGHT = 64
#: Pieces shorter than capacity / SMALL are not cut.
SMALL = 42
RANK_ROWS = 20_000


def cut(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    pieces = [capacity] * (length // capacity)
    left = length % capacity
    while left:
        k = capacity // left
        if k >= SMALL or (capacity - k * left) * TIGHT <= capacity:
            pieces.append(left)
            break
        pieces.append(capacity // (k + 1))
        left -= pieces[-1]
    return pieces


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document; with_ids adds the piece's ids as array<int>.

    tokenizer: a public tokenizer's name, looked up on each executor, or a path that all of them have.
    """

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = word_tokenizer(tokenizer_path(tokenizer)), END_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), known.ids(texts), strict=True):
                ids += end
                at, total = 0, len(ids) // 4
                for n in cut(total, capacity):
                    own = ids[4 * at : 4 * (at + n)]
                    for column, value in zip(out, (doc_id, at, n, checksum(own), total, own), strict=True):
                        column.append(value)
                    at += n
            arrays = [pa.array(c, pa.int64()) for c in out[:5]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays, names = [*arrays, id_lists(out[5])], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(lambda b: released(tokenize(b), "words"), PIECES + ", ids array<int>" * with_ids)


def first_fit(rest: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """sequence and offset for the few pieces that no class could place; longest first."""
    rest = rest.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
    free, sequence, offset = np.zeros(0, np.int64), [], []
    for n in rest["length"]:
        fits = np.flatnonzero(free >= n)
        if not len(fits):
            free = np.append(free, capacity)
            fits = [len(free) - 1]
        sequence.append(int(fits[0]))
        offset.append(int(capacity - free[fits[0]]))
        free[fits[0]] -= n
    return rest.assign(sequence_id=np.array(sequence, np.int64), offset=np.array(offset, np.int64))


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset. Offsets are gapless from 0; no sequence exceeds the capacity.

    Null text is an empty document, which is its end id alone. Repeated rows are packed as often as
    they occur and dealt out by a number of their own, so that no row repeated very often gathers in
    one task. A document longer than the capacity gives full pieces. An empty table gives no rows;
    further columns are not read.
    """
    cut_up = materialise(pieces(docs, tokenizer, capacity, with_ids).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    k = F.floor(F.lit(capacity) / F.col("length"))
    n_buckets = max(1, cut_up.count() // RANK_ROWS)
    dealt = cut_up.withColumn("_k", k.cast("int")).withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(n_buckets)))
    of_class = Window.partitionBy("_k")
    before = of_class.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        dealt.groupBy("_k", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select("_k", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(of_class).alias("_total"))
    )
    base, at = [], 0
    for c, n in sorted((r["_k"], r["n"]) for r in dealt.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each class
        base.append((c, at))
        at += n // c
    classes = docs.sparkSession.createDataFrame(base, "_k int, _base long")
    in_bucket = Window.partitionBy("_k", "_bucket").orderBy("doc_id", "start", "length", "ids_crc32")
    ranked = (
        dealt.withColumn("_own", F.row_number().over(in_bucket) - 1)
        .join(buckets, ["_k", "_bucket"])
        .withColumn("_rank", F.col("_first") + F.col("_own"))
        .join(F.broadcast(classes), "_k")
    )
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    ranked = materialise(ranked.select(
        *names, "_rank", (F.col("_rank") >= F.floor(F.col("_total") / F.col("_k")) * F.col("_k")).alias("_left"),
        (F.col("_base") + F.floor(F.col("_rank") / F.col("_k"))).cast("long").alias("sequence_id"),
    ), "ranked")
    earlier = Window.partitionBy("sequence_id").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    full = ranked.filter(~F.col("_left")).withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long"))
    schema = PIECES + ", ids array<int>" * with_ids + ", sequence_id long, offset long"

    def place(rest: pd.DataFrame) -> pd.DataFrame:
        placed = first_fit(rest[names], capacity)
        return placed.assign(sequence_id=placed["sequence_id"] + at)

    rest = ranked.filter("_left").withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(place, schema)
    columns = [*names, "sequence_id", "offset"]
    return full.select(columns).unionByName(rest.select(columns))
