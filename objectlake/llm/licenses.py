"""License notices: phrases that stand word by word, and notices found by an exact set-similarity join.

Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. The base finds the
places where a phrase's words stand consecutively. The method joins blocks of text with templates of
notices: a block is a window of words, twice as long as a template of its size may be and half
overlapping the next, so that a notice lies whole in some block however the text is divided into lines.
A block meets a template if it holds at least 90 % of the template's distinct words.

Templates' words are ordered by how many documents hold them, rarest first, over all documents. Of n
template words, a needed, one of the first n - a + 1 must be in the block (prefix filter), and among the
first b - a + 1 of the block's b template words; b must reach a (length filter); and what can still be
common before and after such a word must reach a (positional filter). What is left is verified by
intersection, so the join is exact. Words that no template holds can't be common and are left out of both
sides at once. The templates are a parameter of a few dozen rows; their prefixes are what is broadcast.

Null texts count as empty and give a row without words. Every row of documents gives a row, also where rows
share a doc_id or have none. Very long texts are worked through in slices; their blocks are rows, not one
list. An empty table gives no rows. Columns besides doc_id and text are left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objectlake.session import materialise

from .expressions import text_or_empty

# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Notices as they stand in published works, and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "This project is licensed under the terms of the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

PERCENT = 90
SLICE = 1 << 20
WORD_BYTES = rb"0-9a-z\x80-\xff"
WORD = re.compile(rb"[" + WORD_BYTES + rb"]+")
GAP = re.compile(rb"[^" + WORD_BYTES + rb"]")
#: Which bytes belong to words, once A-Z are lower-cased.
IN_WORD = np.array([WORD.fullmatch(bytes([b])) is not None for b in range(256)])


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; bytes of other characters are no ASCII letters."""
    return (text or "").encode().lower()


def word_slices(data: bytes, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of about so many bytes that cut no word."""
    at = 0
    while at < len(data):
        gap = GAP.search(data, at + most) if len(data) - at > most else None
        end = gap.end() if gap else len(data)
        yield at, end
        at = end


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    needed: int
    scale: int

    @staticmethod
    def of(label: str, text: str, percent: int) -> Template:
        found = [w.decode() for w in WORD.findall(lowered(text))]
        words = tuple(sorted(set(found)))
        return Template(label, words, -(-len(words) * percent // 100), max(8, 1 << (len(found) - 1).bit_length()))


def templates_of(templates: tuple[tuple[str, str], ...], percent: int) -> list[Template]:
    return [t for label, text in templates if (t := Template.of(label, text, percent)).words]


class Phrases:
    """Places where the words of a phrase stand consecutively."""

    def __init__(self, phrases: tuple[tuple[str, str], ...]):
        split = [(p.encode().split(), label) for p, label in phrases]
        between, end = rb"[^" + WORD_BYTES + rb"]+", rb"(?![" + WORD_BYTES + rb"])"
        self.patterns = [(words, re.compile(between.join(map(re.escape, words)) + end), label) for words, label in split]

    def starts(self, data: bytes) -> list[tuple[int, str]]:
        """Byte and label of each place, by byte."""
        out = []
        for words, pattern, label in self.patterns:
            found = pattern.search(data) if all(w in data for w in words) else None
            while found:
                at = found.start()
                if not at or not IN_WORD[data[at - 1]]:
                    out.append((at, label))
                found = pattern.search(data, at + 1)
        return sorted(out)


def frequencies(docs: DataFrame, words: frozenset[str]) -> dict[str, int]:
    """How many documents hold each of these words. As many numbers as words come back, whatever the corpus."""
    wanted = frozenset(w.encode() for w in words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                data, own = lowered(text.as_py()), set()
                for a, b in word_slices(data):
                    own |= wanted.intersection(WORD.findall(data[a:b]))
                total.update(own)
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in total], "n": list(total.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

    found = docs.select(text_or_empty().alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in found.collect()}


def blocks(ranks: np.ndarray, scale: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and rank of each distinct template word of each block, in this order. ranks: of all n words, -1 for other words."""
    at = np.flatnonzero(ranks >= 0)
    last = max(0, -(-n // scale) - 2)
    own = at // scale
    block, rank = np.concatenate((own, own - 1)), np.concatenate((ranks[at], ranks[at])).astype(np.int64)
    inside = (block >= 0) & (block <= last)
    packed = np.unique((block[inside] << 20) | rank[inside])
    return packed >> 20, packed & ((1 << 20) - 1)


SCANNED = "doc_id long, row long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, scale int, block long, tokens array<int>"


def scan_texts(docs: DataFrame, rank: dict[str, int], prefixes: dict[int, frozenset[int]], least: dict[int, int], phrases: tuple[tuple[str, str], ...]) -> DataFrame:
    """A row for each document, and one for each block that holds a prefix word and enough template words."""
    of = {w.encode(): r for w, r in rank.items()}
    word_of = {r: w for w, r in of.items()}
    rare = [word_of[r] for r in sorted(frozenset().union(*prefixes.values()))] if prefixes else []
    marks = {scale: np.isin(np.arange(len(of)), list(own)) for scale, own in prefixes.items()}
    base = Phrases(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                            ("base_labels", pa.list_(pa.string())), ("scale", pa.int32()), ("block", pa.int64()), ("tokens", pa.list_(pa.int32()))])
        nothing = dict.fromkeys(schema.names)
        for batch in batches:
            out = []
            for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = lowered(text.as_py())
                places, n, numbers = base.starts(data), 0, []
                candidate = any(w in data for w in rare)
                parts: list[np.ndarray] = []
                for a, b in word_slices(data):
                    inside = IN_WORD[np.frombuffer(data, np.uint8, b - a, a)]
                    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
                    numbers += [n + int(np.searchsorted(starts, p - a)) for p, _ in places if a <= p < b]
                    n += len(starts)
                    if candidate:
                        parts.append(np.array([of.get(w, -1) for w in WORD.findall(data[a:b])], np.int32))
                out.append(nothing | {"doc_id": doc_id, "row": row, "n_words": n, "n_base": len(places), "first_word": numbers[0] if places else None, "last_word": numbers[-1] if places else None, "base_labels": sorted({x for _, x in places})})
                if not candidate:
                    continue
                ranks = np.concatenate(parts)
                for scale, mark in marks.items():
                    block, own = blocks(ranks, scale, n)
                    edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, np.int64)
                    ends = np.append(edges[1:], len(block))
                    held = np.add.reduceat(mark[own], edges) if len(edges) else edges
                    for k in np.flatnonzero((held > 0) & (ends - edges >= least[scale])).tolist():
                        out.append(nothing | {"doc_id": doc_id, "row": row, "scale": scale, "block": int(block[edges[k]]), "tokens": own[edges[k] : ends[k]].astype(np.int32)})
                        if len(out) >= 10_000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
            yield pa.RecordBatch.from_pylist(out, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, SCANNED)


def matches(scanned: DataFrame, kinds: list[Template], rank: dict[str, int]) -> DataFrame:
    """doc_id, row, block, scale, label, containment of every block that meets a template's threshold."""
    spark, index = scanned.sparkSession, []
    for number, t in enumerate(kinds):
        ordered = sorted(rank[w] for w in t.words)
        index += [(number, t.label, t.scale, t.needed, len(ordered), i, r, ordered) for i, r in enumerate(ordered[: len(ordered) - t.needed + 1])]
    prefix = spark.createDataFrame(index, "template int, label string, scale int, needed int, n int, i int, token int, ordered array<int>")
    words = scanned.filter("block IS NOT NULL").select("doc_id", "row", "scale", "block", "tokens", F.size("tokens").alias("b"), F.posexplode("tokens").alias("j", "token"))
    pairs = words.join(F.broadcast(prefix), ["scale", "token"])  # a few rows for each template
    length, own_prefix = F.col("b") >= F.col("needed"), F.col("j") <= F.col("b") - F.col("needed")
    position = F.least("i", "j") + 1 + F.least(F.col("n") - 1 - F.col("i"), F.col("b") - 1 - F.col("j")) >= F.col("needed")
    common = pairs.filter(length & own_prefix & position).withColumn("common", F.size(F.array_intersect("tokens", "ordered")))
    return common.filter("common >= needed").select("doc_id", "row", "scale", "block", "label", (F.col("common") / F.col("n")).alias("containment"))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a phrase stands, else the greatest share of a template's words that a block meeting
    its threshold holds, 0 without such a block.
    """
    kinds = templates_of(templates, percent)
    vocabulary = frozenset(w for t in kinds for w in t.words)
    counted = frequencies(docs, vocabulary)
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    prefixes: dict[int, frozenset[int]] = {}
    least: dict[int, int] = {}
    for t in kinds:
        prefixes[t.scale] = prefixes.get(t.scale, frozenset()) | frozenset(sorted(rank[w] for w in t.words)[: len(t.words) - t.needed + 1])
        least[t.scale] = min(least.get(t.scale, t.needed), t.needed)
    scanned = materialise(scan_texts(docs, rank, prefixes, least, phrases), "scanned")
    found = matches(scanned, kinds, rank).groupBy("doc_id", "row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    rows = scanned.filter("block IS NULL").drop("scale", "block", "tokens")
    both = rows.select("*", F.lit(None).cast("array<string>").alias("more"), F.lit(None).cast("double").alias("containment")).unionByName(found, allowMissingColumns=True)
    joined = both.groupBy("doc_id", "row").agg(
        *(F.max(c).alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "containment")), F.max("more").alias("more"),
    )
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def duckdb_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, percent: int = PERCENT) -> str:
    """The same rows in DuckDB, without filters: every block against every template."""
    text = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    kinds = ",\n  ".join(f"('{t.label}', {t.scale}, {t.needed}, {text(t.words)})" for t in templates_of(templates, percent))
    bases = ",\n  ".join(f"('{label}', {text(p.split())})" for p, label in phrases)
    return f"""
WITH templates(label, scale, needed, words) AS (VALUES
  {kinds}),
phrases(label, words) AS (VALUES
  {bases}),
docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
),
places AS (
  SELECT row, label, unnest(list_filter(range(0, len(w) - len(words) + 1), lambda i: w[i + 1 : i + len(words)] = words)) AS place
  FROM docs, phrases WHERE list_has_all(w, words)
),
base AS (
  SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY row
),
blocks AS (
  SELECT row, scale, list_distinct(w[b * scale + 1 : (b + 2) * scale]) AS held
  FROM (SELECT row, scale, w, unnest(range(0, greatest(1, (len(w) + scale - 1) // scale - 1))) AS b FROM docs, (SELECT DISTINCT scale FROM templates))
),
met AS (
  SELECT row, label, len(list_intersect(held, words)) AS common, needed, len(words) AS n FROM blocks JOIN templates USING (scale)
),
found AS (
  SELECT row, list(DISTINCT label) AS labels, max(common / n) AS containment FROM met WHERE common >= needed GROUP BY row
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN base USING (row) LEFT JOIN found USING (row)
"""
