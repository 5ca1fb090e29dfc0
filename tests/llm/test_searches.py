"""Hard negatives, license notices and alignment of tokenizers against plain versions and on odd inputs."""

import re
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache
from hashlib import sha256
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from objectlake.llm import alignment, licenses, negatives

# ---- hard negatives


def test_residue_products_are_exact():
    rng = np.random.default_rng(7)
    for rows, width, top in ((5, 3, 10), (7, 64, 300), (4, 2_500, 40_000), (3, 1_030, 5_000_000), (2, 0, 1)):
        a, b = rng.integers(-top, top + 1, (rows, width)), rng.integers(-top, top + 1, (rows + 1, width))
        a[0], b[0] = top, -top
        bound = width * top * top + 1
        moduli = negatives.primes(max(width, 1), bound)
        assert all(min(width, negatives.SPAN) * (p // 2) ** 2 <= 1 << 24 for p in moduli) and len(set(moduli)) == len(moduli)
        got = negatives.Residues(a, moduli).scores(negatives.Residues(b, moduli))
        want = [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b] for r in a]
        assert got.tolist() == want


def mined(rows):
    """By definition; rows: vec_id, embedding, label."""
    usable = []
    for n, (k, v, y) in enumerate(rows):
        if k is None or y is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        usable.append((n, k, [int(np.floor(256.0 * x)) for x in v], (y + 1) % 10 if k % 7 == 0 else y))
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    out = []
    for a in (x for x in usable if x[1] % 100 == 0):
        order = sorted((x for x in usable if x[0] != a[0]), key=lambda x: (-score(a, x), x[1]))
        for p in [x for x in order if x[3] == a[3]][:5]:
            s = score(a, p)
            near = [x for x in order if x[3] != a[3] and 80 * s <= 100 * score(a, x) <= 100 * s][:5]
            out += [(a[1], p[1], k + 1, x[1], s, score(a, x)) for k, x in enumerate(near)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<double>, label int, row string, v long")


def test_hard_negatives_as_defined(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), [float(x) for x in rng.integers(-3, 4, 6) / 4], int(rng.integers(0, 4))) for k in range(0, 900)]
    rows += [(k, [0.5, 0.5, 0.25, 0.0, 0.0, 0.25], k % 2) for k in range(1000, 1400)]  # one vector for a third of the rows
    rows += [(2000, [1e3, -2e3, 5.0, 0.0, 1.0, 0.1], 1), (2001, [9e2, -2.1e3, 5.0, 0.0, 1.0, 0.1], 1), (2002, [8e2, -2e3, 5.0, 1.0, 1.0, 0.1], 2)]
    rows += [(3000, [], 1), (3001, [0.5, 0.25], 1), (3002, [0.5] * 8, 2), (3003, None, 1), (3004, [0.5, None], 1), (3005, [float("nan")], 1), (3006, [float("-inf")], 1), (3007, [0.5], None), (None, [0.5], 1)]
    got = [tuple(r) for r in negatives.mine(vectors(spark, rows)).collect()]
    want = mined(rows)
    assert sorted(got) == want and len(want) > 100
    assert negatives.mine(vectors(spark, rows).limit(0)).count() == 0


def test_rows_that_share_an_id_and_scores_beyond_64_bits(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (101, [0.9, 0.0], 2), (101, [0.9, 0.0], 2)]
    got = sorted(tuple(r) for r in negatives.mine(vectors(spark, rows)).collect())
    assert got == mined(rows) == [(100, 100, k, 101, 65536, 256 * 230) for k in (1, 1, 2, 2)]
    with pytest.raises(ValueError, match="64 bits"):
        negatives.mine(vectors(spark, [(0, [1e9, 1.0], 1), (1, [1e9, 1.0], 1)])).collect()


# ---- license notices

FIRST = "licensed under the apache license version 2 0"


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def scanned(text):
    """By definition: every phrase at every place, every block against every template."""
    w = words_of(text)
    places = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base, more, best = {x for _, x in places}, set(), 0.0
    for label, notice in licenses.TEMPLATES:
        own, scale = set(words_of(notice)), 8
        while scale < len(words_of(notice)):
            scale *= 2
        for b in range(max(1, -(-len(w) // scale) - 1)):
            common = len(own & set(w[b * scale : (b + 2) * scale]))
            if 100 * common >= licenses.PERCENT * len(own):
                more.add(label)
                best = max(best, common / len(own))
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if at else best)


def license_texts():
    filler = "lorem ipsum dolor sit amet the of and to in a use copy free form all under public version this work "
    mit, isc = (t for label, t in licenses.TEMPLATES if label in ("mit", "isc") and t.startswith("Permission"))
    return [
        None, "", "MIT License", "xmit license mit licenses mit-license MIT\n\tLICENSE", "Released under the MIT License.", f"{filler * 20}{mit}{filler * 30}",
        mit.replace("hereby", "here").replace("charge", "cost"), f"{filler * 7}{isc.replace('fee', 'payment').replace('granted', 'given')} {filler}", isc[: len(isc) // 2],
        "Licensed under CC BY-NC 4.0.", "cc by cc by gnu general public license gnu general public", "GNU GENERAL\x00PUBLIC LICENSE, Version 3, this work is licensed under it", "ÄÖÜ MIT LİCENSE ﬀ mit license¹ mit license",
        " ".join(reversed(FIRST.split())), filler * 400 + FIRST + " " + filler * 5_000 + "mit license", "x" * 3_000_000 + " cc by " + "y" * 10,
    ]


def test_license_scan_as_defined(spark):
    texts = license_texts()
    rows = [(k, t, "b", 1) for k, t in enumerate(texts)] + [(4, texts[4], "b", 1), (4, "other", "b", 1), (None, "mit license", "b", 1), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, scale int")
    got = sorted(repr(tuple(r)) for r in licenses.scan(docs).collect())
    want = [(k, *scanned(t)) for k, t, *_ in rows]
    assert got == sorted(map(repr, want))
    labels = {k: w[6] for k, *w in [(w[0], *w) for w in want[: len(texts)]]}
    assert labels[4] == "mit" and labels[5] == "mit" and labels[6] == "mit" and labels[7] == "isc" and labels[8] == "" and labels[9] == "cc-by,cc-by-nc" and labels[13] == "apache"
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_scan_without_templates(spark):
    docs = spark.createDataFrame([(1, "mit license"), (2, "Released under the MIT License")], "doc_id long, text string")
    assert [r.labels for r in licenses.scan(docs, templates=()).orderBy("doc_id").collect()] == ["mit", "mit"]
    assert [r.labels for r in licenses.scan(docs, templates=(("own", "one two three"),), phrases=()).orderBy("doc_id").collect()] == ["", ""]


def test_template_words_are_ordered_by_documents_that_hold_them(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", "a a a B", "a-c", "d", None])], "doc_id long, text string")
    assert licenses.frequencies(docs, frozenset("abc")) == {"a": 3, "b": 2, "c": 1}


# ---- alignment


@pytest.fixture(scope="module")
def models():
    return alignment.aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@lru_cache(maxsize=1)
def byte_level():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


def whole(models, text):
    """Groups and overlapping pairs of a whole text, each pair as often as it stands, by comparing all tokens' ranges."""
    a = byte_level().encode(" " + text, add_special_tokens=False).ids if text else []
    b = models.b.encode(text) if text else []
    a_bytes, b_bytes = [models.a_bytes[i] for i in a], [models.b_bytes[i] for i in b]
    if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return 0, 0, [], []
    ranges = lambda parts: [(e - len(x), e) for x, e in zip(parts, np.cumsum(list(map(len, parts))).tolist(), strict=True)]
    ra, rb = ranges(a_bytes), ranges(b_bytes)
    ends = sorted({e for _, e in ra} & {e for _, e in rb})
    group_of = lambda ids, r: [",".join(str(i) for i, _ in own) for _, own in groupby(zip(ids, r, strict=True), lambda x: bisect_left(ends, x[1][1]))]
    groups = list(map("|".join, zip(group_of(a, ra), group_of(b, rb), strict=True)))
    links, j = [], 0
    for i, (s, e) in zip(a, ra, strict=True):
        while j and rb[j - 1][1] > s:
            j -= 1
        while rb[j][1] <= s:
            j += 1
        k = j
        while k < len(rb) and rb[k][0] < e:
            links.append((i, b[k]))
            k += 1
    return len(a), len(b), groups, links


def expected(models, rows):
    found = [(k, *whole(models, t or "")) for k, t in rows]
    counts, top = defaultdict(int), defaultdict(int)
    for *_, links in found:
        for p in set(links):
            counts[p] += 1
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return [(k, n_a, n_b, len(g), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), sha256(";".join(g).encode()).hexdigest() if n_a else "") for k, n_a, n_b, g, links in found]


PIECES = ["the", " ", "  ", "\n", " \n ", "\t", "don't", "Straße", "naïve", "日本語", "😀", "<|endoftext|>", "<s>", "<0x41>", "　", "\xa0", "\xad", "\x1c", "\x00", "é", "▁", "12345", "...", "x" * 50, "internationalisation", "�", "a.\nB", "ing\n", "\r\n", "\x1e", "'S 's"]


def test_alignment_as_defined(spark, models):
    rng = np.random.default_rng(3)
    texts = [None, "", " ", "  ", "a", " a ", "one two  three", "a ▁ b", *["".join(rng.choice(PIECES, 12)) for _ in range(150)], " ".join(rng.choice(PIECES[:10], 4000)), "wordwithoutblanks" * 3000]
    texts += ["the same text"] * 80
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "the"), (None, "the end"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, group long, pair int").repartition(5)
    got = sorted(repr(tuple(r)) for r in alignment.align(docs).collect())
    assert got == sorted(map(repr, expected(models, rows)))
    assert alignment.align(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.characters(exclude_categories=("Cs",))), max_size=30).map("".join))
def test_units_are_aligned_like_the_whole_text(models, text):
    group = alignment.Group()
    group.add(models, 1, text)
    n_a, n_b, groups, links = whole(models, text)
    own = {k: v[0] for k, v in next(group.rows(0)).to_pydict().items()}
    assert (own["n_a"], own["n_b"], own["n_groups"], own["n_links"]) == (n_a, n_b, len(groups), len(links))
    assert own["groups_sha256"] == (sha256(";".join(groups).encode()).hexdigest() if n_a else "")
    batches = list(group.rows(7))
    held = {p: (docs, times) for b in batches[1:] for p, docs, times in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)}
    want = defaultdict(int)
    for a, b in links:
        want[a << 32 | b] += 1
    assert held == {p: ([0], [n]) for p, n in want.items()}


def test_very_long_texts_are_cut_into_slices(models):
    text = "A line of words, and then\n another one; " * 30_000
    group = alignment.Group()
    group.add(models, 1, text)
    n_a, n_b, groups, links = whole(models, text)
    own = {k: v[0] for k, v in next(group.rows(0)).to_pydict().items()}
    assert len(text) > alignment.SLICE
    assert (own["n_a"], own["n_b"], own["n_groups"], own["n_links"], own["groups_sha256"]) == (n_a, n_b, len(groups), len(links), sha256(";".join(groups).encode()).hexdigest())
