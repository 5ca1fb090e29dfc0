"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is its distinct five-word shingles, weighted by count times IDF. A sample is the shingle
that minimises ``ln c - r (t - beta + 1)`` with ``t = floor(ln w / r + beta)`` for gamma draws r, c and
a uniform beta of each shingle; two documents draw the same (shingle, t) with the probability of
their weighted Jaccard similarity. BANDS bands of ROWS samples bring candidates together, exact
weighted Jaccard similarity verifies them, and classes are connected components.

The draws come as sums of exponentials: with a, e1 and e2 exponential, ``c = a + e1``, ``v = ln(c / a)``
is exponential too, ``r = v + e2`` and ``beta = e2 / r``. The value to minimise is then ``ln a - r t``,
and t is 0 for weight 1: the shingle's hash itself, from which a is drawn, tells the order.

The IDF is ``ln(1 + n / df) / ln(1 + RARE)`` and 1 for a shingle in fewer than one of RARE documents.
Document frequencies are counted over all documents in a count-min sketch of fixed size: collisions
raise the frequency of a rare shingle by about the mean shingles of a document in WIDTH.

A large group of near copies makes its own shingles frequent. So that the threshold means the same for
it, bands are also drawn without the IDF where they differ, and a pair is near if it reaches the
threshold with the IDF or without it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objectlake.operators.components import connected_components
from objectlake.session import discard, materialise

from .memory import released
from .rows import LOWEST, keyed
from .shingles import blocks, shingles

SIMILARITY = 0.8
BANDS, ROWS = 18, 4
#: A shingle in more than one of so many documents weighs less than 1.
RARE = 1_000
#: The sketch: counters in a row, rows, and counters that are added up together.
WIDTH, DEPTH, PART = 1 << 20, 2, 1 << 12
#: Weights are kept in so many steps.
STEPS = 64
#: Shingles of a bucket's texts that one group holds, and shingles of texts that are compared with all of those.
CHUNK, ROVERS = 1 << 20, 1 << 17
#: What a text counts for beside its shingles.
PER_TEXT = 64

#: Stands for no shingle of weight 1.
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=1)
def multipliers() -> np.ndarray:
    """An odd factor for each sample."""
    rng = np.random.Generator(np.random.PCG64(20_240_501))
    return rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * M1
    return h ^ (h >> np.uint64(29))


def _begins(doc: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))


def signatures(doc: np.ndarray, ids: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """Samples (64-bit names of shingle and t), a row for each document; rows of documents without shingles are 0."""
    out = np.zeros((n_docs, BANDS * ROWS), np.uint64)
    if not len(doc):
        return out
    begins = _begins(doc)
    of = doc[begins]
    other = weight != 1
    odd = np.flatnonzero(other)
    h = _mixed(ids * M2)
    if len(odd):
        odd_begins, h_odd = _begins(doc[odd]), h[odd]
        odd_of, odd_size = doc[odd][odd_begins], np.diff(np.append(odd_begins, len(odd)))
        place = np.searchsorted(of, odd_of)
        w, ln_w = weight[odd], np.log(weight[odd])
    order = lambda x: np.log(-np.log1p(-((x >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)))
    exponential = lambda bits: -np.log((bits.astype(float) + 0.5) / float(1 << 32))
    for j, m in enumerate(multipliers()):
        x = h * m
        if not len(odd):
            out[of, j] = np.minimum.reduceat(x, begins)
            continue
        x_odd = x[odd]
        x[odd] = NONE
        name = np.minimum.reduceat(x, begins)
        least = np.where(name == NONE, np.inf, order(name))
        g = _mixed(x_odd ^ h_odd)
        ln_a = order(x_odd)
        v = np.log1p(exponential(g & np.uint64(0xFFFFFFFF)) / np.exp(ln_a))
        r = v + exponential(g >> np.uint64(32))
        t = np.floor((ln_w - v) / r) + 1
        value = ln_a - r * t
        best = np.minimum.reduceat(value, odd_begins)
        hit = value == np.repeat(best, odd_size)
        names = np.zeros(len(odd_of), np.uint64)
        names[np.repeat(np.arange(len(odd_of)), odd_size)[hit]] = x_odd[hit] + t[hit].astype(np.int64).view(np.uint64) * M2
        won = best < least[place]
        name[place[won]] = names[won]
        out[of, j] = name
    return out


class Weights:
    """The IDF of any shingle, from the sketch's frequencies: for each counter a weight in STEPS steps."""

    def __init__(self, steps: np.ndarray | None = None):
        self.steps = steps

    def of(self, ids: np.ndarray) -> np.ndarray:
        if self.steps is None:
            return np.ones(len(ids))
        return np.maximum.reduce([row[at] for row, at in zip(self.steps, counters(ids), strict=True)]) / STEPS


#: Counts alone, without the IDF.
PLAIN = Weights()


def measures(known: Weights) -> list[Weights]:
    """The weights by which a pair may be near."""
    return [PLAIN] if known.steps is None else [known, PLAIN]


def counters(ids: np.ndarray) -> list[np.ndarray]:
    """The counter of each shingle in each row of the sketch."""
    h = _mixed(ids * M1)
    return [((h >> np.uint64(20 * k)) & np.uint64(WIDTH - 1)).astype(np.int64) for k in range(DEPTH)]


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    """1 up to n_docs / RARE, then ln(1 + n / df) / ln(1 + RARE); in steps, the least of them 1 / STEPS."""
    exact = np.minimum(1.0, np.log1p(n_docs / np.maximum(df, 1)) / np.log1p(RARE))
    return np.maximum(np.round(exact * STEPS), 1).astype(np.uint8)


def _texts(rows: DataFrame, doc: str, sub: str) -> DataFrame:
    return rows.select(F.col(doc).alias("doc"), F.col(sub).alias("sub"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """The sketch of document frequencies over all texts, and how many texts there are.

    Each task adds up its own texts; the tasks' sketches are added up part by part, each part in one
    task that reads them one after the other. The driver gets the sum: DEPTH * WIDTH numbers.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((DEPTH, WIDTH), np.int32), 0
        for b in batches:
            own = b.column(0).to_pylist()
            total += len(own)
            for i, j in blocks(own):
                for row, at in zip(n, counters(shingles(own[i:j])[1]), strict=True):
                    some, times = np.unique(at, return_counts=True)
                    row[some] += times.astype(np.int32)
        parts = n.reshape(-1, PART)
        used = np.flatnonzero(parts.any(axis=1))
        values = [total.to_bytes(8, "little"), *[parts[k].tobytes() for k in used]]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int32()), pa.array(values, pa.binary())], ["part", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer(), np.int32 if part >= 0 else np.int64)
                sums[part] = sums[part] + own if part in sums else own.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["part", "n"])

    rows = materialise(texts.select("text").mapInArrow(lambda b: released(counted(b), "shingles"), "part int, n binary").repartition("part").mapInArrow(lambda b: released(added(b), "shingles"), "part int, n binary"), "sketch")
    out, total = np.zeros((DEPTH * WIDTH // PART, PART), np.int64), 0
    for r in rows.collect():  # a row for each part, whatever the corpus
        if r["part"] < 0:
            total = int(np.frombuffer(r["n"], np.int64)[0])
        else:
            out[r["part"]] = np.frombuffer(r["n"], np.int64)
    discard(rows)
    return out.reshape(DEPTH, WIDTH), total


def weights(texts: DataFrame) -> Weights:
    """The IDF by document frequencies over all texts given."""
    df, total = frequencies(texts)
    return Weights(np.stack([idf(row, total) for row in df])) if total else PLAIN


SIGNED = "doc long, sub long, key_a long, key_b long, n_shingles long, bands array<long>"


def sign(texts: DataFrame, known: Weights) -> DataFrame:
    """doc, sub, a 128-bit key of the text, how many shingles it has, and a hash of each band of samples.

    A text with frequent shingles has further hashes, of those bands that differ without the IDF.
    """

    def hashed(doc: np.ndarray, ids: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
        samples = signatures(doc, ids, weight, n_docs).reshape(n_docs, BANDS, ROWS)
        salt = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        h = salt * np.ones((n_docs, 1), np.uint64)
        for k in range(ROWS):
            h = _mixed((h ^ samples[:, :, k]) * M2)
        return h.view(np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(2).to_pylist()
            n, bands = np.zeros(len(own), np.int64), np.zeros((len(own), 2 * BANDS), np.int64)
            given = np.zeros((len(own), 2 * BANDS), bool)
            for i, j in blocks(own):
                doc, ids, count = shingles(own[i:j])
                n[i:j] = np.bincount(doc, minlength=j - i)
                bands[i:j, :BANDS] = hashed(doc, ids, count.astype(float), j - i)
                given[i:j, :BANDS] = (n[i:j] > 0)[:, None]
                rarity = known.of(ids)
                some = np.bincount(doc[rarity != 1], minlength=j - i) > 0
                if some.any():
                    of = some[doc]
                    at = i + np.flatnonzero(some)
                    bands[at, BANDS:] = hashed((np.cumsum(some) - 1)[doc[of]], ids[of], count[of] * rarity[of], len(at))
                    given[at, BANDS:] = bands[at, BANDS:] != bands[at, :BANDS]
            keys = np.frombuffer(b"".join(md5(t.encode()).digest() for t in own), ">i8").astype(np.int64).reshape(-1, 2)
            offsets = np.concatenate(([0], np.cumsum(given.sum(axis=1))))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bands[given]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(n), lists], ["doc", "sub", "key_a", "key_b", "n_shingles", "bands"])

    return texts.mapInArrow(lambda b: released(each(b), "shingles"), SIGNED)


def vectors(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """id, shingles in ascending order and their counts. ids: id, and the doc and sub of a row that holds the text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(1).to_pylist()
            place = 0
            for i, j in blocks(own):
                doc, found, count = shingles(own[i:j])
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=j - i)))), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (found.view(np.int64), count.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(place, j - i), *lists], ["id", "shingles", "counts"])
                place += j - i

    return texts.join(ids, ["doc", "sub"]).select("id", "text").mapInArrow(lambda b: released(each(b), "shingles"), "id long, shingles array<long>, counts array<long>")


def similarity(ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray, known: Weights) -> float:
    """Weighted Jaccard similarity of two texts' shingles, each by ascending id, with their counts."""
    w_a, w_b = n_a * known.of(ids_a), n_b * known.of(ids_b)
    _, i, j = np.intersect1d(ids_a, ids_b, assume_unique=True, return_indices=True)
    both = np.minimum(w_a[i], w_b[j]).sum()
    return float(both / max(w_a.sum() + w_b.sum() - both, 1e-12))


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[offsets[k] : offsets[k + 1]] for k in range(len(column))]


def verified(pairs: DataFrame, own: DataFrame, known: Weights, threshold: float) -> DataFrame:
    """The pairs (a, b) of at least the threshold, with the IDF or without. own: id, shingles and counts.

    Both joins are plain equi-joins, so that a leader with very many partners is split by AQE.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [_arrays(b.column(k)) for k in range(2, 6)]
            near = [any(similarity(x.view(np.uint64), n, y.view(np.uint64), m, w) >= threshold for w in measures(known)[::-1]) for x, n, y, m in zip(*parts, strict=True)]
            yield b.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    return (
        pairs.join(own.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"), F.col("counts").alias("n_a")), "a")
        .join(own.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"), F.col("counts").alias("n_b")), "b")
        .select("a", "b", "of_a", "n_a", "of_b", "n_b").mapInArrow(lambda b: released(each(b), "shingles"), "a long, b long")
    )


def compared(batches: Iterator[pa.RecordBatch], known: Weights, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between components of a group: rows of group, id, component, roving, shingles, counts, sorted by group.

    Each roving text is held against all texts of the group at once; of the texts it is linked to, one
    for each component is handed on. Groups are dealt to about CHUNK + ROVERS shingles.
    """

    def settle(rows: pa.Table) -> pa.RecordBatch:
        ids, component = rows.column("id").to_numpy(), rows.column("component").to_numpy()
        own, n = (_arrays(rows.column(c).combine_chunks()) for c in ("shingles", "counts"))
        sizes = np.array([len(x) for x in own])
        shingle, count = np.concatenate(own).view(np.uint64), np.concatenate(n)
        begins = np.cumsum(sizes) - sizes
        weighed = [count * w.of(shingle) for w in measures(known)]
        totals = [np.add.reduceat(weight, begins) for weight in weighed]
        found: list[tuple[int, int]] = []
        for i in np.flatnonzero(rows.column("roving").to_numpy(zero_copy_only=False)):
            mine = shingle[begins[i] : begins[i] + sizes[i]]
            at = np.minimum(np.searchsorted(mine, shingle), sizes[i] - 1)
            shared, near = mine[at] == shingle, np.zeros(len(ids), bool)
            for weight, total in zip(weighed, totals, strict=True):
                both = np.add.reduceat(np.where(shared, np.minimum(weight[begins[i] + at], weight), 0.0), begins)
                near |= both >= threshold * (total + total[i] - both)
            near &= component != component[i]
            _, one = np.unique(component[near], return_index=True)
            found += [(int(ids[i]), int(x)) for x in ids[near][one]]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["a", "b"])

    held = None
    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        group = held.column("group").to_numpy()
        cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
        for i, j in zip(np.concatenate(([0], cuts[:-1])), cuts, strict=True) if len(cuts) else ():
            yield settle(held.slice(int(i), int(j - i)))
        held = held.slice(int(cuts[-1])) if len(cuts) else held
    if held is not None and len(held):
        yield settle(held)


def links(texts: DataFrame, known_texts: DataFrame, entries: DataFrame, known: Weights, threshold: float, chunk: int, rovers: int) -> DataFrame:
    """Verified links that connect whatever texts of a bucket are connected within it.

    known_texts: id, doc and sub; entries: bucket, id and size (shingles). First each bucket's leader, the text that shares most
    buckets with others, is compared with the rest. Where a bucket still holds several components, each
    text outside the largest is compared with the whole bucket: texts are dealt into chunks of bounded
    size and the outside ones into smaller chunks, every pair of chunks is one group, and no pair of
    texts is ever a row. Sums for each bucket are written out before rows are joined to them, so that a
    hot bucket's rows are split by AQE.
    """
    sizes = materialise(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    inside = materialise(entries.join(sizes, "bucket"), "inside")
    reach = inside.groupBy("id").agg(F.sum("n").alias("reach"))
    place = F.max(F.struct("reach", -F.col("id"))).alias("m")
    leaders = materialise(inside.select("bucket", "id").join(reach, "id").groupBy("bucket").agg(place).select("bucket", (-F.col("m.col2")).alias("leader")), "leaders")
    led = materialise(inside.select("bucket", "id", "size").join(leaders, "bucket").filter("id <> leader"), "led")
    discard(sizes, inside, leaders)
    pairs = led.select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).distinct()
    own = materialise(vectors(texts, known_texts.join(led.select("id").union(led.select("leader")).distinct(), "id")), "vectors")
    found = materialise(verified(pairs, own, known, threshold), "links")
    component = materialise(connected_components(found), "component")
    now = materialise(led.drop("leader").join(component, "id", "left").withColumn("component", F.coalesce("component", "id")).withColumn("load", F.col("size") + PER_TEXT), "now")
    parts = now.groupBy("bucket", "component").agg(F.sum("load").alias("n"))
    open_ = materialise(parts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("largest")
    ).filter("parts > 1"), "open")
    n_chunks = F.ceil(F.col("all") / chunk).cast("int")
    n_rovers = F.ceil((F.col("all") - F.col("largest.n")) / rovers).cast("int")
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    dealt = materialise(now.join(open_, "bucket").select(
        "bucket", "id", "component", (F.col("component") != F.col("largest.component")).alias("roving"),
        n_chunks.alias("chunks"), n_rovers.alias("groups"), deal(n_chunks, 1).alias("chunk"), deal(n_rovers, 2).alias("rover"),
    ), "dealt")
    steady = dealt.select("bucket", "id", "component", F.lit(False).alias("roving"), "chunk", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("rover"))
    roving = dealt.filter("roving").select("bucket", "id", "component", "roving", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "rover")
    groups = (
        steady.unionByName(roving).groupBy("bucket", "chunk", "rover", "id").agg(F.first("component").alias("component"), F.max("roving").alias("roving"))
        .select(F.xxhash64("bucket", "chunk", "rover").alias("group"), "id", "component", "roving")
        .join(own, "id").repartition("group").sortWithinPartitions("group")
        .select("group", "id", "component", "roving", "shingles", "counts")
    )
    more = groups.mapInArrow(lambda b: released(compared(b, known, threshold), "shingles"), "a long, b long")
    more = materialise(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "more")
    discard(led, own, component, now, open_, dealt)
    return found.unionByName(more)


def _classify(texts: DataFrame, threshold: float = SIMILARITY, chunk: int = CHUNK, rovers: int = ROVERS) -> DataFrame:
    """doc and sub, n_shingles, and class (doc and sub of the row that stands for it) of every row of doc, sub and text."""
    known = weights(texts)
    signed = materialise(sign(texts, known), "signed")
    own = materialise(
        signed.groupBy("key_a", "key_b")
        .agg(F.min(F.struct("doc", "sub")).alias("row"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
        .withColumn("id", F.monotonically_increasing_id()), "texts"
    )
    entries = materialise(own.select("id", "size", F.explode("bands").alias("bucket")), "entries")
    component = materialise(connected_components(links(texts, own.select("id", "row.*"), entries, known, threshold, chunk, rovers)), "component")
    discard(entries)
    linked = own.select("id", "row").join(component, "id")
    tops = linked.join(linked.groupBy("component").agg(F.min("row").alias("top")), "component").select("id", "top")
    of_text = materialise(own.select("key_a", "key_b", "id", "row").join(tops, "id", "left").select(
        "key_a", "key_b", F.coalesce("top", "row").alias("class")
    ), "classes")
    discard(own, component)
    return signed.drop("bands").join(of_text, ["key_a", "key_b"]).select("doc", "sub", "n_shingles", "class")


def _null(doc: Column) -> Column:
    return F.when(doc != LOWEST, doc)


def classify(docs: DataFrame, threshold: float = SIMILARITY, chunk: int = CHUNK, rovers: int = ROVERS) -> DataFrame:
    """doc_id, class_id, n_shingles and first (whether the row stands for its class) of every document.

    class_id is the smallest doc_id of the class. Equal texts are of one class, also empty ones; null
    text counts as empty and a null doc_id as the smallest. Texts of one to four words have one
    shingle. A very long text is hashed in one piece and counts by its shingles when groups are dealt.
    Rows that share a doc_id each have the class of their own text. An empty table gives no rows;
    further columns are not read.
    """
    found = _classify(_texts(*keyed(docs.select("doc_id", "text"))), threshold, chunk, rovers)
    return found.select(
        _null(F.col("doc")).alias("doc_id"), _null(F.col("class.doc")).alias("class_id"), "n_shingles", (F.struct("doc", "sub") == F.col("class")).alias("first")
    )


def remove(docs: DataFrame) -> DataFrame:
    """One document of each class, with its own columns: the row with the smallest doc_id, one of equal rows."""
    rows, doc, sub = keyed(docs)
    found = _classify(_texts(rows, doc, sub)).filter(F.struct("doc", "sub") == F.col("class"))
    kept = materialise(found.select(F.col("doc").alias(doc), F.col("sub").alias(sub)), "kept")
    return rows.join(kept, [doc, sub], "left_semi").select(docs.columns)
