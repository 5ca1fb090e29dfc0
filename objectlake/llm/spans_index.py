"""Removal of repeated byte strings by a logarithmic family of sparse suffix arrays.

A byte is removed if it lies in a LENGTH-byte string that also starts earlier (in an earlier document,
or earlier in the same document). Every LENGTH-byte window has an anchor: the GRAM-byte string in it
whose hash is smallest, leftmost if several are. Equal windows have equal anchors at equal distances,
so only suffixes that start at anchors are indexed, about one in 43 bytes. A run is the stretch of
consecutive windows that share an anchor.

A suffix array holds a batch's suffixes in the order of their first GRAM bytes, which are kept as they
are (head_a, head_b: eight bytes each, in the order of the bytes), and among equal ones in the order of
a hash of all bytes of the run (context). The index is a family of levels, each such an array of the
first occurrence of every context. A new batch's array is merge-scanned with all levels: a run whose
head and context occur earlier is repeated as a whole, and runs that share the head but not the context
are compared window by window, on their bytes. The batch then becomes a level, and levels of equal size
merge, so a run is rewritten log2(batches) times at most.

Runs count as equal by GRAM bytes and a 64-bit hash of the rest; windows of different runs are held
against each other byte by byte, in blocks of whole heads. The runs to be compared are counted for every
head: one with more than a block holds is spread over tasks, and its windows meet by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from objectlake.session import discard, materialise

from .expressions import thinned, unused
from .memory import by_bytes, release, released
from .rows import keyed

LENGTH, GRAM = 100, 16
GRAMS = LENGTH - GRAM + 1
#: Bytes that are hashed at once; longer documents are read in overlapping stretches.
STRETCH = 1 << 20
PLACE = np.uint64((1 << 21) - 1)
#: Bytes of text whose runs are sorted together.
SORTED = 12 << 20
#: Batches that a whole table is dealt into, in the order of its rows.
BATCHES = 4
#: In a scan, which holds one row of a head, heads are spread over tasks if more than one of so many runs of the sampled
#: documents has them; so many documents, about, and heads at most. These bear on how evenly tasks are filled, on nothing else.
HOT_SHARE = 5_000
HOT_DOCS, HOT_HEADS = 5_000, 1_000
#: Runs whose windows are held against each other at once. Heads with more runs to compare are spread over tasks, however many such heads there are.
BLOCK_RUNS = 20_000

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
BASE = 0xD6E8FEB86659FD93


@lru_cache(maxsize=1)
def powers(n: int = STRETCH + 4096) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def gram_hashes(data: bytes) -> np.ndarray:
    """A mixed 64-bit hash of the GRAM bytes at each place."""
    n = len(data) - GRAM + 1
    word = np.ndarray((n + 8,), "<u8", data, strides=(1,))
    h = word[:n] * M1
    h ^= h >> np.uint64(32)
    h += word[8 : n + 8]
    h *= M2
    h ^= h >> np.uint64(29)
    h *= M3
    h ^= h >> np.uint64(32)
    return h


def sums(h: np.ndarray) -> np.ndarray:
    """Prefix sums of h[i] * BASE ** i; differences times BASE ** -start are hashes of stretches."""
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers()[0][: len(h)], out=out[1:])
    return out


def anchors(h: np.ndarray) -> np.ndarray:
    """The anchor's place for each window: hash first, place second, in one word, so a minimum does."""
    v = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= GRAMS:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    rest = GRAMS - step
    return ((np.minimum(v[: len(v) - rest], v[rest:]) if rest else v) & PLACE).astype(np.int64)


def heads(data: bytes) -> np.ndarray:
    """The eight bytes at each place as a long that sorts as they do."""
    word = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,)).astype(np.uint64)
    return (word ^ np.uint64(1 << 63)).view(np.int64)


RUN = 6  # columns of runs


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """head_a, head_b, context, document (place in texts), first and last window of every run (in bytes, inclusive)."""
    found: list[tuple[np.ndarray, ...]] = []

    def flush(some: list[tuple[int, int, bytes]]) -> None:
        data = b"".join(b for _, _, b in some)
        h = gram_hashes(data)
        at, total, word = anchors(h), sums(h), heads(data)
        sizes = np.array([len(b) for _, _, b in some])
        starts = np.cumsum(sizes) - sizes
        window = np.concatenate([np.arange(s, s + n - LENGTH + 1) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        p = at[window]
        first = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (window[1:] != window[:-1] + 1))))
        s, e, p = window[first], window[np.concatenate((first[1:], [len(window)])) - 1], p[first]
        context = (total[e + GRAMS] - total[s]) * powers()[1][s]
        context ^= ((p - s).astype(np.uint64) << np.uint64(8)) + (e - s).astype(np.uint64) * M3
        of = np.searchsorted(starts, s, "right") - 1
        shift = np.array([o for _, o, _ in some])[of] - starts[of]
        found.append((word[p], word[p + 8], context.view(np.int64), np.array([d for d, _, _ in some], np.int64)[of], s + shift, e + shift))

    some, n = [], 0
    for doc, data in enumerate(texts):
        for o in range(0, len(data) - LENGTH + 1, STRETCH):
            part = data[o : o + STRETCH + LENGTH - 1]
            if n + len(part) > STRETCH + LENGTH and some:
                flush(some)
                some, n = [], 0
            some.append((doc, o, part))
            n += len(part)
    if some:
        flush(some)
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(RUN))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


#: doc and sub name a row of the table; e - s is below LENGTH, so that place is s and e in one long, in the order of s.
ROW = ["head_a", "head_b", "context", "doc", "sub", "place", "state"]
ROWS = "head_a long, head_b long, context long, doc long, sub long, place long, state byte"
TYPES = [*[pa.int64()] * 6, pa.int8()]
#: state: of this batch, or settled (repeated within what one task has read), or -LEVEL * (k + 1) for level k.
#: HOT is added for hot heads.
NEW, SETTLED, HOT, LEVEL = 1, 2, 4, 8


def place_of(s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return (s << 8) | (e - s)


def span_of(place: Column) -> tuple[Column, Column]:
    """Start and end (exclusive, of the last window) of a run."""
    start = F.shiftright(place, 8)
    return start.cast("int"), (start + place.bitwiseAND(F.lit(255)) + LENGTH).cast("int")


def _batch(columns: list[np.ndarray], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Where any of some sorted columns changes."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def suffix_array(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of documents (doc, sub, text). Of a context's runs in SORTED bytes only the first is indexed;
    the others are settled, and dealt out by other numbers, so that a hot head stays small."""
    for b in by_bytes(batches, 2, SORTED):
        data = [t.encode() for t in b.column(2).to_pylist()]
        long_ = [k for k, t in enumerate(data) if len(t) >= LENGTH]
        head_a, head_b, context, of, s, e = runs([data[k] for k in long_])
        if not len(s):
            continue
        row = np.array(long_)[of]
        doc, sub, place = b.column(0).to_numpy()[row], b.column(1).to_numpy()[row], place_of(s, e)
        order = np.lexsort((place, sub, doc, context, head_b, head_a))
        head_a, head_b, context, doc, sub, place = columns = [c[order] for c in (head_a, head_b, context, doc, sub, place)]
        fresh = _fresh(head_a, head_b, context)
        lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        keep = fresh | (doc != doc[lead]) | (sub != sub[lead]) | (place >> 8 != place[lead] >> 8)
        state = np.where(fresh, NEW + HOT * np.isin(head_a ^ head_b, hot), SETTLED)
        columns[0] = np.where(fresh, head_a, (doc.view(np.uint64) * M1 + place.view(np.uint64) * M2).view(np.int64))
        yield _batch([c[keep] for c in (*columns, state)], ROW, TYPES)
        del data, head_a, head_b, context, of, s, e, row, doc, sub, place, order, columns, fresh, lead, keep, state
        release()


#: What a merge-scan gives: runs repeated as a whole, runs to be compared, and first occurrences.
WHOLE, COMPARE, FIRST = 0, 1, 2


def merge_scan(batches: Iterator[pa.RecordBatch], merged_levels: list[int] | None) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted as _sorted does. Holds one batch; of the head it is in, one row.

    First occurrences are given for the batch and the levels that are merged with it, for none if
    merged_levels is None. Runs of a hot head are spread over tasks by context, so each is compared,
    whatever others there are.
    """
    kept = [] if merged_levels is None else [NEW, *[-LEVEL * (k + 1) for k in merged_levels]]
    carried: list[np.ndarray] | None = None
    compared = False  # whether the carried row went out for comparison
    for b in batches:
        new = [b.column(k).to_numpy() for k in range(len(ROW))]
        settled = new[-1] == SETTLED
        if settled.any():
            yield _batch([c[settled] for c in new[:-1]] + [np.full(settled.sum(), WHOLE)], ROW, TYPES)
            new = [c[~settled] for c in new]
        old = 0 if carried is None else 1
        rows = new if carried is None else [np.concatenate(p) for p in zip(carried, new, strict=True)]
        head_a, head_b, context, doc, sub, place, state = rows
        if not len(state):
            continue
        hot, state = state & HOT > 0, state & ~np.int8(HOT)
        new_head = _fresh(head_a, head_b)
        first = new_head | _fresh(context)
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        group = np.cumsum(new_head) - 1
        n_contexts = np.bincount(group, first)
        n_new = np.bincount(group, first & (state == NEW))
        if old and compared:
            n_contexts[0] += 1
        n_new[0] += old
        n_new[-1] += 1  # the head may go on in the next batch
        out = np.where(first & ((n_contexts[group] > 1) & (n_new[group] > 0) | hot), COMPARE, -1)
        again = (doc != doc[lead]) | (sub != sub[lead]) | (place >> 8 != place[lead] >> 8)
        out = np.where(~first & (state == NEW) & again, WHOLE, out)
        if old and compared:
            out[0] = -1
        going = out >= 0
        yield _batch([c[going] for c in rows[:-1]] + [out[going]], ROW, TYPES)
        fresh = first & np.isin(state, kept)
        fresh[:old] = False
        yield _batch([c[fresh] for c in rows[:-1]] + [FIRST + HOT * hot[fresh]], ROW, TYPES)
        at = lead[-1]
        compared = bool(out[at] == COMPARE or (old and compared and at == 0))
        carried = [c[at : at + 1] for c in rows]


def _sorted(rows: DataFrame) -> DataFrame:
    """A suffix array's rows, dealt by head (hot ones by context too) and in the order of the suffixes."""
    own = F.when(F.col("state").bitwiseAND(F.lit(HOT)) != 0, F.col("context")).otherwise(0)  # states of levels are negative
    return rows.repartition(F.xxhash64("head_a", "head_b", own)).sortWithinPartitions("head_a", "head_b", "context", "state", "doc", "sub", "place")


def hot_heads(texts: DataFrame) -> np.ndarray:
    """Heads (their two halves in one number) of more than one in HOT_SHARE runs of a sample of documents."""
    n = texts.count()
    sample = thinned(texts, F.xxhash64("doc", "sub"), n, HOT_DOCS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = runs([t.encode() for t in b.column(0).to_pylist() if len(t) * 4 >= LENGTH])
            some, n = np.unique(found[0] ^ found[1], return_counts=True)
            yield _batch([some, n], ["head", "n"], [pa.int64(), pa.int64()])

    counted = materialise(sample.select("text").mapInArrow(each, "head long, n long").groupBy("head").agg(F.sum("n").alias("n")), "heads")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = counted.filter((F.col("n") * HOT_SHARE > total) & (F.col("n") >= 20)).orderBy(F.desc("n"), "head").limit(HOT_HEADS).collect()
    discard(counted)
    return np.array(sorted(r["head"] for r in top), np.int64)


class SuffixFamily:
    """Levels of sparse suffix arrays, largest first. Batches must come in the order of their rows.

    hot: heads whose runs are spread over tasks, chosen once for the family. merges counts the merged levels.
    """

    def __init__(self, spark: SparkSession, hot: np.ndarray | None = None):
        self.spark = spark
        self.hot = np.zeros(0, np.int64) if hot is None else hot
        self.levels: list[tuple[int, DataFrame]] = []
        self.merges = 0

    def add(self, texts: DataFrame, keep: bool = True) -> DataFrame:
        """Scan a batch (doc, sub, text) against all levels; rows with state WHOLE or COMPARE.

        With keep, the batch becomes a level of size 1, and levels of equal size are merged: the scan
        has read them in order, so it writes their first occurrences and the batch's as one array.
        """
        hot = self.hot
        batch = texts.mapInArrow(lambda b: released(suffix_array(b, hot)), ROWS)
        for k, (_, level) in enumerate(self.levels):
            batch = batch.unionByName(level.withColumn("state", (F.lit(-LEVEL * (k + 1)) + F.col("state").bitwiseAND(F.lit(HOT))).cast("byte")))
        size, gone = 1, []
        while keep and self.levels and self.levels[-1][0] == size:
            size *= 2
            self.merges += 1
            gone.append(self.levels.pop()[1])
        merged_levels = list(range(len(self.levels), len(self.levels) + len(gone))) if keep else None
        scanned = materialise(_sorted(batch).mapInArrow(lambda b: released(merge_scan(b, merged_levels)), ROWS), "scan")
        if not keep:
            return scanned
        out = materialise(scanned.filter(F.col("state").isin(WHOLE, COMPARE)), "repeated")
        level = scanned.filter(F.col("state").isin(FIRST, FIRST + HOT))
        level._scratch = scanned._scratch
        self.levels.append((size, level))
        discard(*gone)
        return out

    def close(self) -> None:
        """Remove the levels' files."""
        discard(*[level for _, level in self.levels])
        self.levels = []


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From documents (doc, sub, text) with their runs to compare: the bytes of all windows of each run."""
    for b in batches:
        out: list[list] = [[], [], [], [], [], [], [], []]
        for doc, sub, text, own in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
            data = text.encode()
            for head_a, head_b, context, place, hot in zip(*(own.values.field(k).to_pylist() for k in range(5)), strict=True):
                s = place >> 8
                for c, v in zip(out, (head_a, head_b, context, doc, sub, s, data[s : s + (place & 255) + LENGTH], hot), strict=True):
                    c.append(v)
        yield _batch(out, STRETCHES, [*[pa.int64()] * 6, pa.binary(), pa.bool_()])


STRETCHES = ["head_a", "head_b", "context", "doc", "sub", "s", "bytes", "hot"]


def windows(stretches: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """For blocks of stretches: a hash of each window, its place in data, data, the stretch, and its place there."""
    sizes = np.array([len(x) for x in stretches])
    for rows in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // STRETCH)) + 1):
        data = b"".join([stretches[i] for i in rows])
        h = gram_hashes(data)
        starts, n = np.cumsum(sizes[rows]) - sizes[rows], sizes[rows] - LENGTH + 1
        of = np.repeat(np.arange(len(rows)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, total = starts[of] + inside, sums(h)
        yield (total[at + GRAMS] - total[at]) * powers()[1][at], at, data, rows[of], inside


def repeated(h: np.ndarray, at: np.ndarray, data: bytes, order: np.ndarray) -> np.ndarray:
    """Of windows in an order that puts equal hashes together, earliest first: whether an earlier one has the same bytes."""
    h, at = h[order], at[order]
    fresh = _fresh(h)
    lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    again = np.flatnonzero(~fresh)
    word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    same = np.ones(len(again), bool)
    for o in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        same &= word[at[again] + o] == word[at[lead[again]] + o]
    out = np.zeros(len(h), bool)
    out[again] = same
    for k in again[~same]:  # another string of the same hash: looked up among all before
        first = lead[k]
        out[k] = any(data[at[k] : at[k] + LENGTH] == data[at[x] : at[x] + LENGTH] for x in range(first, k))
    return out


SPAN = "doc long, sub long, start int, end int, window long, other long"
SPAN_NAMES = ["doc", "sub", "start", "end", "window", "other"]
SPAN_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]


def compare(batches: Iterator[pa.RecordBatch], block_runs: int = BLOCK_RUNS) -> Iterator[pa.RecordBatch]:
    """Repeated stretches (doc, sub, start, end) of runs sorted by head.

    Heads are compared in blocks of whole ones, none of which has more than block_runs runs unless it is
    hot. Of hot heads, each window's first occurrence in a block is handed on under two hashes of its
    bytes instead of a verdict.
    """

    def spans_at(doc: np.ndarray, sub: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((start, sub, doc))
        doc, sub, start = doc[order], sub[order], start[order]
        if not len(doc):
            return _batch([doc, sub, start, start, start, start], SPAN_NAMES, SPAN_TYPES)
        cut = np.flatnonzero(_fresh(doc, sub) | np.concatenate(([True], start[1:] > start[:-1] + 1)))
        last = np.concatenate((cut[1:], [len(doc)])) - 1
        none = pa.nulls(len(cut), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[cut]), pa.array(sub[cut]), pa.array(start[cut], pa.int32()), pa.array(start[last] + LENGTH, pa.int32()), none, none], SPAN_NAMES
        )

    def settle(block: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, sub, s = (block.column(c).to_numpy() for c in ("doc", "sub", "s"))
        stretches = block.column("bytes").to_pylist()
        parts = list(windows(stretches))
        shift = np.cumsum([0, *[len(p[2]) for p in parts]])
        h, row, inside = (np.concatenate([p[k] for p in parts]) for k in (0, 3, 4))
        at, data = np.concatenate([p[1] + o for p, o in zip(parts, shift, strict=False)]), b"".join([p[2] for p in parts])
        d, u, start = doc[row], sub[row], s[row] + inside
        order = np.lexsort((start, u, d, h))
        again = repeated(h, at, data, order)
        mine = order[again]
        yield spans_at(d[mine], u[mine], start[mine])
        warm = block.column("hot").to_numpy(zero_copy_only=False)[row][order] & ~again
        if warm.any():
            w = order[warm]
            word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
            other = np.zeros(len(w), np.uint64)
            for o in (*range(0, LENGTH - 8, 8), LENGTH - 8):
                other = (other ^ word[at[w] + o]) * M1
                other ^= other >> np.uint64(29)
            yield _batch([d[w], u[w], start[w], start[w] + LENGTH, h[w].view(np.int64), other.view(np.int64)], SPAN_NAMES, SPAN_TYPES)

    held = None
    for b in batches:
        table = pa.Table.from_batches([b])
        held = table if held is None else pa.concat_tables([held, table])
        while len(held) > block_runs:
            cuts = np.flatnonzero(_fresh(held.column("head_a").to_numpy(), held.column("head_b").to_numpy()))
            # Whole heads, as many as fit; only a hot head exceeds a block. It may be cut anywhere, its windows meet again by their hashes.
            n = int(cuts[cuts <= block_runs][-1]) or block_runs
            yield from settle(held.slice(0, n).combine_chunks())
            held = held.slice(n)
    if held is not None and len(held):
        yield from settle(held.combine_chunks())


def dealt(texts: DataFrame, batches: int) -> Iterator[DataFrame]:
    """Batches of about equally many rows, in the order of the rows."""
    low, high = texts.agg(F.min("doc"), F.max("doc")).first()
    if low is None:
        return
    wanted = [k / batches for k in range(1, batches)]
    edges = sorted({r["e"] for r in texts.select(F.explode(F.expr(f"approx_percentile(doc, array({', '.join(map(str, wanted))}))")).alias("e")).collect()} - {high}) if wanted else []
    for k in range(len(edges) + 1):
        batch = texts.filter(F.col("doc") > edges[k - 1]) if k else texts
        yield batch.filter(F.col("doc") <= edges[k]) if k < len(edges) else batch


def with_hot(runs: DataFrame, block_runs: int) -> DataFrame:
    """Runs to be compared and whether their head is hot: it has more than block_runs of them."""
    heads = runs.groupBy("head_a", "head_b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_runs)
    large = materialise(heads.select("head_a", "head_b", F.lit(True).alias("hot")), "hot")
    if large.isEmpty():
        return runs.withColumn("hot", F.lit(False))
    return runs.join(large, ["head_a", "head_b"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def spans(texts: DataFrame, batches: int = BATCHES, hot: np.ndarray | None = None, block_runs: int = BLOCK_RUNS) -> DataFrame:
    """doc, sub, start, end of repeated stretches of a table of doc, sub and text, none of them null."""
    hot = hot_heads(texts) if hot is None else hot
    family = SuffixFamily(texts.sparkSession, hot)
    dealt_out = list(dealt(texts, batches))
    scans = [family.add(batch, keep=k + 1 < len(dealt_out)) for k, batch in enumerate(dealt_out)]  # no batch follows the last
    family.close()
    if not scans:
        return texts.sparkSession.createDataFrame([], "doc long, sub long, start int, end int")
    scanned = scans[0]
    for s in scans[1:]:
        scanned = scanned.unionByName(s)
    start, end = span_of(F.col("place"))
    whole = scanned.filter(F.col("state") == WHOLE).select("doc", "sub", start.alias("start"), end.alias("end"))
    to_compare = with_hot(scanned.filter(F.col("state") == COMPARE).select("doc", "sub", "head_a", "head_b", "context", "place"), block_runs)
    to_compare = to_compare.groupBy("doc", "sub").agg(F.collect_set(F.struct("head_a", "head_b", "context", "place", "hot")).alias("runs"))
    stretches = texts.join(to_compare, ["doc", "sub"]).select("doc", "sub", "text", "runs").mapInArrow(
        lambda b: released(contexts(b)), "head_a long, head_b long, context long, doc long, sub long, s long, bytes binary, hot boolean"
    )
    deal = F.xxhash64("head_a", "head_b", F.when(F.col("hot"), F.col("context")).otherwise(0))
    ordered = stretches.repartition(deal).sortWithinPartitions("head_a", "head_b", "context", "doc", "sub", "s")
    found = materialise(ordered.mapInArrow(lambda b: released(compare(b, block_runs)), SPAN), "compared")
    warm = found.filter(F.col("window").isNotNull())
    firsts = materialise(warm.groupBy("window", "other").agg(F.min(F.struct("doc", "sub", "start")).alias("first")), "windows")
    again = warm.join(firsts, ["window", "other"]).filter(F.struct("doc", "sub", "start") != F.col("first"))
    names = ["doc", "sub", "start", "end"]
    return whole.unionByName(found.filter(F.col("window").isNull()).select(names)).unionByName(again.select(names))


def with_spans(rows: DataFrame, doc: str, sub: str, found: DataFrame, name: str) -> DataFrame:
    """rows with the repeated stretches of their text under a name, null if there are none."""
    each = found.groupBy(F.col("doc").alias(doc), F.col("sub").alias(sub)).agg(F.collect_list(F.struct("start", "end")).alias(name))
    return rows.join(each, [doc, sub], "left")


def _texts(rows: DataFrame, doc: str, sub: str) -> DataFrame:
    return rows.select(F.col(doc).alias("doc"), F.col(sub).alias("sub"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def merged(starts: list[int], ends: list[int], size: int) -> list[tuple[int, int]]:
    """Maximal removed runs, within a text of so many bytes."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out if a < size]


def remaining(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in removed:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def _own(value: pa.Scalar) -> tuple[list[int], list[int]]:
    return ([], []) if not value.is_valid else (value.values.field(0).to_pylist(), value.values.field(1).to_pylist())


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], []]
        for text, own in zip(b.column(1).to_pylist(), b.column(2), strict=True):
            data = (text or "").encode()
            removed = merged(*_own(own), len(data))
            values = (len(data), sum(y - x for x, y in removed), len(removed), sha256(remaining(data, removed)).hexdigest())
            for c, v in zip(out, values, strict=True):
                c.append(v)
        arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_spans(docs: DataFrame, batches: int = BATCHES, hot: np.ndarray | None = None, block_runs: int = BLOCK_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Null text is empty. A null doc_id comes before all others; rows that share a doc_id are documents
    of their own, in the order of a hash of their texts. A very long text is hashed in overlapping
    stretches. An empty table gives no rows; further columns are not read.
    """
    rows, doc, sub = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = spans(_texts(rows, doc, sub), batches, hot, block_runs)
    return with_spans(rows, doc, sub, found, "spans").select("doc_id", "text", "spans").mapInArrow(
        digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def without_spans(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs with the repeated bytes taken out of text; a character that loses a byte goes as a whole.

    Other columns stay as they are, as do null texts; no row is dropped.
    """
    rows, doc, sub = keyed(docs)
    found = spans(_texts(rows, doc, sub), batches)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for t, x in zip(texts, own, strict=True):
            if t is None or x is None:
                out.append(t)
                continue
            data = t.encode()
            out.append(remaining(data, merged([i["start"] for i in x], [i["end"] for i in x], len(data))).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    name = unused(rows, "spans")
    return with_spans(rows, doc, sub, found, name).withColumn("text", cleaned(F.col("text"), F.col(name))).select(*docs.columns)
