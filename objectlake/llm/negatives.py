"""Hard negatives by exact integer inner products in a residue number system.

A component x becomes floor(256 * x). Scores are inner products of those integers. Component matrices
are multiplied modulo several small primes in float32: residues lie around zero, and the primes are so
small that every sum of products is below 2^24, where float32 is exact. Symmetric mixed-radix digits
(Chinese remaindering) give the signed score back, exactly; the primes' product exceeds twice the
largest score that any two rows can have.

Anchors and rows are dealt into blocks, and each pair of a block of anchors and a block of rows is one
bounded group of a cogroup: no row is broadcast or brought to the driver, and what leaves a group is the
best few rows of each anchor. The first pass finds every anchor's positives, the second the negatives
whose scores lie in a positive's window.

Rows with a null label, a null vector or a null, NaN or infinite component take no part, nor do rows
with a null vec_id, which can't be named. Vectors of unlike lengths are compared as if zeros followed the
shorter one; an empty vector scores 0. Rows that share a vec_id are rows of their own: each is an anchor,
and each may be the other's positive; which of two equal rows comes first is not told apart by any column.
An empty table gives no rows. Columns besides the three are left alone. Should two rows' score be able to
leave 64 bits, ValueError is raised before anything is scored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objectlake.session import materialise

#: Components that are multiplied at once; sums of longer vectors are reduced in between.
SPAN = 1024
#: Integers that a block of anchors or rows holds at most, and rows at most.
BLOCK_INTEGERS, BLOCK_ROWS = 1 << 22, 16_384
#: Rows below which a block is not cut further to occupy more tasks.
LEAST_ROWS = 256
#: Scores that are held at once in a task.
TILE = 1 << 21
EXACT = 1 << 24


@lru_cache(maxsize=64)
def primes(dimensions: int, bound: int) -> tuple[int, ...]:
    """The fewest small primes, from the largest down, whose product exceeds 2 * bound and with which sums stay exact in float32."""
    terms = max(1, min(dimensions, SPAN))
    candidate, out, product = 2 * math.isqrt(EXACT // terms - 1) + 1, [], 1
    while product <= 2 * bound:
        if candidate < 3:
            raise ValueError(f"no primes for scores up to {bound}")
        if all(candidate % k for k in range(3, math.isqrt(candidate) + 1, 2)):
            out.append(candidate)
            product *= candidate
        candidate -= 2
    return tuple(out)


def centred(values: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo p between -(p - 1) / 2 and (p - 1) / 2."""
    half = p // 2
    return (values + half) % p - half


class Residues:
    """A matrix of integers as float32 residues, one matrix for each prime."""

    def __init__(self, values: np.ndarray, moduli: tuple[int, ...]):
        self.moduli = moduli
        self.parts = [centred(values, p).astype(np.float32) for p in moduli]

    def rows(self, start: int, stop: int) -> Residues:
        some = object.__new__(Residues)
        some.moduli, some.parts = self.moduli, [x[start:stop] for x in self.parts]
        return some

    def scores(self, other: Residues) -> np.ndarray:
        """Exact inner products of all rows with all of the other's, as int64."""
        digits: list[np.ndarray] = []
        for k, p in enumerate(self.moduli):
            a, b = self.parts[k], other.parts[k]
            residue = np.zeros((len(a), len(b)), np.int64)
            for at in range(0, a.shape[1], SPAN):
                residue = centred(residue + (a[:, at : at + SPAN] @ b[:, at : at + SPAN].T).astype(np.int64), p)
            for q, digit in zip(self.moduli, digits, strict=False):  # the digits below are taken off, one radix after the other
                residue = centred((residue - digit) * pow(q, -1, p), p)
            digits.append(residue)
        total = np.zeros_like(digits[0]) if digits else np.zeros((0, 0), np.int64)
        for p, digit in zip(reversed(self.moduli), reversed(digits), strict=True):
            total = total * np.int64(p) + digit  # a partial sum may wrap; the whole one fits
        return total


def integers(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of integers as a matrix; shorter lists end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width), np.int64)
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(column)), lengths)
    out[of, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def leading(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the greatest allowed scores of each row; among equal ones the leftmost columns."""
    row, column = np.nonzero(allowed)
    if not len(row):
        return row, column
    value = scores[row, column]
    counts = np.bincount(row, minlength=len(scores))
    order = np.lexsort((column, -value, row)) if counts.max() > most else np.lexsort((column, row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row[place < most], column[place < most]


def at_least(scores: np.ndarray, allowed: np.ndarray, most: int) -> np.ndarray:
    """Allowed entries that reach their row's most-th greatest allowed score: a superset of the leading ones."""
    if scores.shape[1] <= most:
        return allowed
    lowest = np.iinfo(np.int64).min
    held = np.where(allowed, scores, lowest)
    return allowed & (held >= np.partition(held, scores.shape[1] - most, axis=1)[:, -most][:, None])


def quantised(embeddings: DataFrame, relabel: bool) -> DataFrame:
    """row, vec_id, label, v (integers) of the rows that take part; row numbers each."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    label, vec_id = F.col("label").cast("long"), F.col("vec_id").cast("long")
    if relabel:
        label = F.when(vec_id % 7 == 0, F.pmod(label + 1, F.lit(10).cast("long"))).otherwise(label)
    rows = embeddings.filter(vec_id.isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~odd)
    return rows.select(
        F.monotonically_increasing_id().alias("row"), vec_id.alias("vec_id"), label.alias("label"),
        F.transform(x, lambda c: F.floor(c * 256.0)).alias("v"), F.aggregate(x, F.lit(0.0), lambda s, c: s + F.pow(F.floor(c * 256.0).cast("double"), F.lit(2.0))).alias("norm"),
    )


def _block(row: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(blocks)).cast("int")


def _everywhere(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


class Search:
    """Anchors against all rows, block by block."""

    def __init__(self, rows: DataFrame, anchors: DataFrame):
        self.rows, self.anchors = rows, anchors
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max("norm").alias("norm")).first()
        self.n, self.width = size.n, max(size.width or 0, 1)
        # By Cauchy and Schwarz no score exceeds the largest squared norm, here with room for its rounding.
        norm = size.norm or 0.0
        self.bound = int(norm * (1 + 1e-6)) + 1 if norm < 2.0**63 else 1 << 63
        if self.bound >= 1 << 62:
            raise ValueError("scores may leave 64 bits")
        self.moduli = primes(self.width, self.bound)
        most = max(1, min(BLOCK_ROWS, BLOCK_INTEGERS // self.width))
        tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.row_blocks = max(1, math.ceil(self.n / most), min(tasks, self.n // LEAST_ROWS))
        self.anchor_blocks = max(1, math.ceil(anchors.count() / most))

    def each(self, anchors: DataFrame, work: Callable[[pa.Table, pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
        """work on every pair of blocks: it gets some anchors, rows by vec_id, and their scores."""
        width, moduli = self.width, self.moduli

        def pair(own: pa.Table, rows: pa.Table) -> pa.Table:
            if not own.num_rows or not rows.num_rows:
                return empty
            rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            a, b = Residues(integers(own["v"], width), moduli), Residues(integers(rows["v"], width), moduli)
            step, out = max(1, TILE // rows.num_rows), []
            for at in range(0, own.num_rows, step):
                some = own.slice(at, step)
                out.append(work(some, rows, a.rows(at, at + some.num_rows).scores(b)))
            return pa.concat_tables(out)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
        left = anchors.withColumn("of", _block("row", self.anchor_blocks)).withColumn("tile", _everywhere(self.row_blocks))
        right = self.rows.select(*(F.col(c).alias(c) for c in ("row", "vec_id", "label", "v")))  # columns of its own, for both sides come from one table
        right = right.withColumn("tile", _block("row", self.row_blocks)).withColumn("of", _everywhere(self.anchor_blocks))
        return left.groupBy("of", "tile").cogroup(right.groupBy("of", "tile")).applyInArrow(pair, schema)

    def positives(self, most: int) -> DataFrame:
        """row, vec_id (of the anchor), positive_id, positive_score and place: the best other rows of the same label."""

        def work(own: pa.Table, rows: pa.Table, scores: np.ndarray) -> pa.Table:
            same = own["label"].to_numpy()[:, None] == rows["label"].to_numpy()[None, :]
            same &= own["row"].to_numpy()[:, None] != rows["row"].to_numpy()[None, :]
            a, b = leading(scores, at_least(scores, same, most), most)
            return pa.table({"row": own["row"].take(a), "other": rows["row"].take(b), "positive_id": rows["vec_id"].take(b), "positive_score": scores[a, b]})

        found = self.each(self.anchors, work, "row long, other long, positive_id long, positive_score long")
        first = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id", "other")
        return found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most).drop("other")

    def negatives(self, positives: DataFrame, most: int) -> DataFrame:
        """row, place, negative_id, negative_score, rank: the best rows of other labels within each positive's window."""
        windows = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("own"))
        windows = windows.select("row", F.col("own.place").alias("places"), F.col("own.positive_score").alias("limits"))

        def work(own: pa.Table, rows: pa.Table, scores: np.ndarray) -> pa.Table:
            unlike = own["label"].to_numpy()[:, None] != rows["label"].to_numpy()[None, :]
            lengths = np.asarray(own["limits"].combine_chunks().value_lengths())
            limits, places = integers(own["limits"], max(1, lengths.max())), integers(own["places"], max(1, lengths.max()))
            out = []
            for k in range(int(lengths.max())):
                top = limits[:, k]
                low = -((-top * 4) // 5)  # the least integer with 100 * score >= 80 * top
                inside = unlike & (scores <= top[:, None]) & (scores >= low[:, None]) & (lengths > k)[:, None]
                a, b = leading(scores, at_least(scores, inside, most), most)
                out.append(pa.table({"row": own["row"].take(a), "place": places[a, k].astype(np.int32), "other": rows["row"].take(b), "negative_id": rows["vec_id"].take(b), "negative_score": scores[a, b]}))
            return pa.concat_tables(out)

        found = self.each(self.anchors.join(windows, "row"), work, "row long, place int, other long, negative_id long, negative_score long")
        first = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id", "other")
        return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most).drop("other")


def mine(embeddings: DataFrame, every: int = 100, most_positives: int = 5, most_negatives: int = 5, relabel: bool = True) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by every; their positives the first most_positives other
    rows of the same label; to each positive the first most_negatives rows of other labels whose score is
    from 80 to 100 % of the positive's. Greater scores come first, equal ones by smaller vec_id.
    relabel: where vec_id is divisible by 7, label first becomes (label + 1) % 10.
    """
    rows = materialise(quantised(embeddings, relabel), "integers")
    anchors = rows.filter(F.col("vec_id") % every == 0).drop("norm")
    search = Search(rows, anchors)
    positives = materialise(search.positives(most_positives).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row"), "positives")
    negatives = search.negatives(positives, most_negatives)
    return positives.join(negatives, ["row", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


#: The same rows in DuckDB.
SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
),
negatives AS (
  SELECT p.anchor_id, p.positive_id, n.other_id AS negative_id, p.positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 5
"""
