"""Alignment of two tokenizers' ids by the bytes they cover.

A is a byte-level BPE that gets a blank before the text, B a piece model that adds that blank itself. Both
cover the same bytes, so a place where tokens of both end cuts the text into groups: the ends of each
side's tokens go into a dictionary from end to index, the common keys, sorted, slice both id lists, and
links are expanded within each slice, from every A token to every B token whose bytes overlap.

Neither tokenizer joins a printable character with a blank after it, or with a line feed between it and
another one, so a text falls into units there whose ends are common ends, and a text's groups are its
units' groups in a row. New units are aligned together, as one text; what a worker has met lately, unless
it is long, it remembers.

How many documents hold a pair linked is counted over all documents. Documents are taken in groups of
bounded size; each pair that a group's documents hold is one row with the documents and how often they
hold it, so that a pair of nearly every document is a row for each group and not for each document. Rows
meet the pairs' counts in one join and come back to their group, where documents are summed up.

Texts that are null, empty, or whose bytes either tokenizer does not give back (a literal U+2581 is such a
case) have no tokens: zeros and an empty groups_sha256. Every row of documents gives a row, also where rows
share a doc_id or have none; a repeated row is a document of its own. Very long texts are worked through in
slices. An empty table gives no rows. Columns besides doc_id and text are left alone.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from objectlake.session import materialise

from . import memory
from .tokens import tokenizer_path

BYTE_MODEL, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters and documents of a group; a longer document is a group of its own.
GROUP_CHARS, GROUP_DOCS = 1 << 21, 1024
#: Characters that are cut into units at once, units that are remembered (twice, the older half is dropped), and the longest of them.
SLICE, REMEMBERED, LONGEST = 1 << 20, 150_000, 40
#: Characters of units that are encoded together.
TOGETHER = 1 << 16
#: Printable characters, no white space in any of its definitions.
PRINTABLE = "!-~¡-¬®-ɏͰ-ͷΆ-ϿЀ-ҁ一-鿿"
#: Where units begin. A blank at the very end stays with its unit.
UNIT = re.compile(f"(?<=[{PRINTABLE}])(?= .|\n[{PRINTABLE}])", re.DOTALL)
#: Blanks and line feeds that begin no unit, in a text after its first character.
ODD = re.compile(f"[^{PRINTABLE}][ \n]|\n[^{PRINTABLE}]|[ \n]\\Z|\x1e")

#: One unit: its groups as text, how many tokens, groups and links it has, and its links as pairs (a << 32 | b), repeated as often as they stand.
Aligned = tuple[str, int, int, int, tuple[int, ...]]


def common_ends(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], dict[int, int], dict[int, int]]:
    """The ends that both lists have, in order, and how many tokens of either side are over at each of its ends."""
    a_at, b_at = dict(zip(a_ends, range(1, len(a_ends) + 1), strict=True)), dict(zip(b_ends, range(1, len(b_ends) + 1), strict=True))
    return sorted(a_at.keys() & b_at.keys()), a_at, b_at


def overlapping(a_ids: list[int], a_ends: list[int], b_ids: list[int], b_ends: list[int], i: int, i2: int, j: int, j2: int) -> list[int]:
    """Pairs of a slice whose bytes overlap."""
    if i2 - i == 1 or j2 - j == 1:  # one token spans the slice and overlaps all of the other side
        return [a << 32 | b for a in a_ids[i:i2] for b in b_ids[j:j2]]
    pairs, low = [], j
    for k in range(i, i2):
        start, m = a_ends[k - 1] if k else 0, low
        while b_ends[m] <= start:
            m += 1
        low = m
        while m < j2 and (b_ends[m - 1] if m else 0) < a_ends[k]:
            pairs.append(a_ids[k] << 32 | b_ids[m])
            m += 1
    return pairs


class Aligner:
    """Two tokenizers in one Python worker, and the units it has met lately.

    The byte-level vocabulary is read from its file; tiktoken, which takes a vocabulary in the order of its
    merges, applies it several times as fast as the library of that file, with the same ids.
    """

    #: Encoded before other units, so that the piece model's blank is this one's.
    FIRST = " a"

    def __init__(self, byte_path: str, piece_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(byte_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        as_bytes = {i: bytes(_byte_of()[c] for c in entry) for entry, i in model["vocab"].items() if all(c in _byte_of() for c in entry)}
        merged = [model["vocab"][a + b] for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        if merged != sorted(merged):
            raise ValueError("ids are not in the order of merges")
        used = {*merged, *(i for i, x in as_bytes.items() if len(x) == 1)}  # special tokens are no bytes
        self.a = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks={as_bytes[i]: i for i in used}, special_tokens={})
        self.a_bytes = [as_bytes.get(i, b"") for i in range(max(as_bytes) + 1)]
        self.b = m = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.b_bytes = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.vocab_size())]
        self.a_size, self.b_size = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.a_text, self.b_text = [f"{i}|" for i in range(len(self.a_bytes))], list(map(str, range(len(self.b_bytes))))
        self.new: dict[str, Aligned | None] = {}
        self.old: dict[str, Aligned | None] = {}

    def align(self, units: list[str]) -> list[Aligned | None]:
        """Of units as they stand in a row in some text. None where a side's bytes are not the unit's."""
        data = [u.encode() for u in (self.FIRST, *units)]
        text, whole = self.FIRST + "".join(units), b"".join(data)
        a_ids, b_ids = self.a.encode_ordinary(text), self.b.encode(text[1:])
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != whole or b"".join(map(self.b_bytes.__getitem__, b_ids)) != whole:
            if len(units) == 1:
                return [None]
            half = len(units) // 2
            return self.align(units[:half]) + self.align(units[half:])
        a_ends, b_ends = list(accumulate(map(self.a_size.__getitem__, a_ids))), list(accumulate(map(self.b_size.__getitem__, b_ids)))
        found, groups, pairs = [], [], []
        edges = accumulate(map(len, data))
        edge, a_text, b_text = next(edges), self.a_text, self.b_text
        ends, a_at, b_at = common_ends(a_ends, b_ends)
        i = j = a0 = b0 = 0
        for end in ends:
            i2, j2 = a_at[end], b_at[end]
            if i2 - i == 1 and j2 - j == 1:
                a, b = a_ids[i], b_ids[j]
                groups.append(a_text[a] + b_text[b])
                pairs.append(a << 32 | b)
            else:
                groups.append(",".join(map(str, a_ids[i:i2])) + "|" + ",".join(map(str, b_ids[j:j2])))
                pairs += overlapping(a_ids, a_ends, b_ids, b_ends, i, i2, j, j2)
            i, j = i2, j2
            if end == edge:
                found.append((";".join(groups), i - a0, j - b0, len(groups), tuple(pairs)))  # tuples of numbers are no burden to the garbage collector
                groups, pairs, edge, a0, b0 = [], [], next(edges, None), i, j
        return found[1:]

    def units_of(self, text: str) -> Iterator[list[str]]:
        """The units of blank + text, in slices."""
        full, at = " " + text, 0
        while at < len(full):
            edge = UNIT.search(full, at + SLICE) if len(full) - at > SLICE else None
            end = edge.start() if edge else len(full)
            part = full[at:end]
            simple = part[1:2] not in ("", " ", "\n") and not ODD.search(part, 1)
            yield (part[0] + part[1:].replace(" ", "\x1e ").replace("\n", "\x1e\n")).split("\x1e") if simple else UNIT.split(part)
            at = end

    def known(self, units: Collection[str]) -> list[Aligned | None]:
        """The alignment of each unit, in their order."""
        if len(self.new) > REMEMBERED:
            self.new, self.old = {}, self.new
        new, old, fresh, chars, long = self.new, self.old, [], 0, {}
        for u in units:
            if u not in new:
                if u in old:
                    new[u] = old[u]
                else:
                    fresh.append(u)
                    chars += len(u)
                    if chars >= TOGETHER:
                        self._learn(fresh, long)
                        fresh, chars = [], 0
        if fresh:
            self._learn(fresh, long)
        return [long[u] if u in long else new[u] for u in units] if long else [new[u] for u in units]

    def _learn(self, units: list[str], long: dict[str, Aligned | None]) -> None:
        units = sorted(units, key=lambda u: u[-1:].isspace())  # one that ends in white space comes last, as it does in its text
        ended = sum(u[-1:].isspace() for u in units)
        found = self.align(units[: len(units) - ended]) if ended < len(units) else []
        for u in units[len(units) - ended :]:
            found += self.align([u])
        for u, x in zip(units, found, strict=True):
            (self.new if len(u) <= LONGEST else long)[u] = x


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def aligner(byte_model: str, piece_model: str) -> Aligner:
    """One per Python worker."""
    return Aligner(tokenizer_path(byte_model), tokenizer_path(piece_model))


memory.REMEMBERED["units"] = aligner.cache_clear


@dataclass
class Group:
    """Documents whose links are gathered by pair."""

    docs: list[dict] = field(default_factory=list)
    chars: int = 0
    place: dict[str, int] = field(default_factory=dict)  # of each unit among those met, and its groups
    text: dict[str, str] = field(default_factory=dict)
    sizes: list[tuple[int, int, int]] = field(default_factory=list)  # tokens and groups of each unit met, and its pairs
    pairs: list[tuple[int, ...]] = field(default_factory=list)
    doc: list[int] = field(default_factory=list)  # of each entry of a document and one of its units: the document, the unit, how often
    unit: list[int] = field(default_factory=list)
    times: list[int] = field(default_factory=list)

    def add(self, own: Aligner, doc_id: int | None, text: str) -> None:
        number, digest, total = len(self.docs), sha256(), Counter()
        for units in own.units_of(text) if text else ():
            counted = Counter(units)
            unmet = [u for u in counted if u not in self.place]
            found = own.known(unmet)
            if None in found:
                total = Counter()
                break
            for u, (groups, n_a, n_b, n_groups, pairs) in zip(unmet, found, strict=True):
                self.place[u] = len(self.pairs)
                self.text[u] = groups
                self.sizes.append((n_a, n_b, n_groups))
                self.pairs.append(pairs)
            digest.update(((";" if total else "") + ";".join(map(self.text.__getitem__, units))).encode())
            total = total + counted if total else counted
        self.doc += [number] * len(total)
        self.unit += map(self.place.__getitem__, total)
        self.times += total.values()
        self.docs.append({"doc": number, "doc_id": doc_id, "groups_sha256": digest.hexdigest() if total else ""})
        self.chars += len(text)

    def full(self) -> bool:
        return self.chars >= GROUP_CHARS or len(self.docs) >= GROUP_DOCS

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """A row for each document, and one for each pair with its documents and how often they hold it."""
        doc, unit, times = (np.array(x, np.int64) for x in (self.doc, self.unit, self.times))
        sizes = np.fromiter(chain.from_iterable(self.sizes), np.int64).reshape(-1, 3)
        n_links = np.fromiter(map(len, self.pairs), np.int64)
        sums = np.zeros((4, len(self.docs)), np.int64)
        for k, column in enumerate((*sizes.T, n_links)):
            np.add.at(sums[k], doc, times * column[unit])
        names = ("n_a", "n_b", "n_groups", "n_links")
        yield _batch([{"group": number} | d | dict(zip(names, s, strict=True)) for d, s in zip(self.docs, sums.T.tolist(), strict=True)])
        if not len(doc):
            return
        names_of, local = np.unique(np.fromiter(chain.from_iterable(self.pairs), np.int64), return_inverse=True)
        starts, n = np.cumsum(n_links) - n_links, n_links[unit]
        at = np.repeat(starts[unit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        packed = local[at].astype(np.int64) * len(self.docs) + np.repeat(doc, n)  # pair first, document second
        order = np.argsort(packed, kind="stable")
        packed, each = packed[order], np.repeat(times, n)[order]
        first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
        times, packed = np.add.reduceat(each, first), packed[first]
        pair, doc = names_of[packed // len(self.docs)], (packed % len(self.docs)).astype(np.int32)
        edges = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        for at in range(0, len(edges), 50_000):
            some = edges[at : at + 50_000]
            stop = edges[at + 50_000] if at + 50_000 < len(edges) else len(pair)
            offsets = pa.array(np.append(some, stop) - some[0], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[some[0] : stop], kind)) for x, kind in ((doc, pa.int32()), (times, pa.int64()))]
            held = {"group": pa.array(np.full(len(some), number)), "pair": pa.array(pair[some]), "docs": lists[0], "times": lists[1]}
            yield pa.RecordBatch.from_arrays([held.get(f.name, pa.nulls(len(some), f.type)) for f in GATHERED_ARROW], schema=GATHERED_ARROW)


GATHERED = "group long, pair long, docs array<int>, times array<long>, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
GATHERED_ARROW = pa.schema([("group", pa.int64()), ("pair", pa.int64()), ("docs", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())), ("doc", pa.int32()), ("doc_id", pa.int64()),
                            ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict.fromkeys(GATHERED_ARROW.names) | r for r in rows], GATHERED_ARROW)


def gather(docs: DataFrame, byte_model: str, piece_model: str) -> DataFrame:
    """Rows of documents and of pairs, group by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, group = aligner(byte_model, piece_model), TaskContext.get().partitionId() << 32, Group()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                group.add(own, doc_id, text.as_py() or "")
                if group.full():
                    yield from group.rows(number)
                    number, group = number + 1, Group()
        if group.docs:
            yield from group.rows(number)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, GATHERED)


def pair_counts(gathered: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked) and best: is that its A id's highest count?

    An A id has at most as many pairs as B has ids.
    """
    counts = gathered.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum(F.size("docs")).alias("count"))
    top = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.select("pair", "count", (F.col("count") == top).alias("best"))


def _summed(table: pa.Table) -> pa.Table:
    """One group: what each document's pairs add up to."""
    is_doc = table["doc"].is_valid()
    docs, pairs = table.filter(is_doc), table.filter(pa.compute.invert(is_doc))
    place = docs["doc"].to_numpy()
    size = int(place.max()) + 1 if len(place) else 0
    count_sum, n_best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    if pairs.num_rows:
        lists = pairs["docs"].combine_chunks()
        of = np.repeat(np.arange(pairs.num_rows), lists.value_lengths().to_numpy())
        doc, times = lists.flatten().to_numpy(), pairs["times"].combine_chunks().flatten().to_numpy()
        np.add.at(count_sum, doc, times * pairs["count"].to_numpy()[of])
        np.add.at(n_best, doc, times * pairs["best"].to_numpy(zero_copy_only=False).astype(np.int64)[of])
    return pa.table({c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": n_best[place], "count_sum": count_sum[place], "groups_sha256": docs["groups_sha256"]})


def align(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Models are looked up by name on each executor; paths that all of them have will do too.
    """
    gathered = materialise(gather(docs, byte_model, piece_model), "aligned")
    joined = gathered.filter("pair IS NOT NULL").select("group", "pair", "docs", "times").join(pair_counts(gathered), "pair").drop("pair")
    own = gathered.filter("doc IS NOT NULL").drop("pair", "docs", "times")
    return joined.unionByName(own, allowMissingColumns=True).groupBy("group").applyInArrow(_summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
