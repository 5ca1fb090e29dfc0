"""Each operator against a plain version of what it computes, on small whole tables."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from objectlake.llm import fingerprints, memory, near_dedup, packing, pieces, pii, quality, sharding, shingles, spans_index, toxicity, urls, weak
from objectlake.llm.rows import keyed
from objectlake.llm.tokens import WordTokenizer, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())


# Personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a.b", "@", "x-1", ".com", " ", "1.2.3.4", "256", ".", "+1", " (555) ", "555-1234", "4111 1111 1111 1111", "-", "é", "%", "12", "\n"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_query(documents, rows):
    found = {r.doc_id: r for r in pii.find(documents).collect()}
    for doc_id, text in rows:
        base = plain_spans(text)
        want = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        r = found[doc_id]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in base) for j in range(4))
        assert set(want.split(",")) <= set(r.spans.split(",")) or not want


def test_wide_spans_need_support():
    text = "My phone: (555) 123-4567. Write to jo.doe [at] mail [dot] example [dot] com"
    kinds = [k for _, k, _ in pii.wide_spans(text, pii.base_spans(text))]
    assert kinds == [3, 0]
    assert pii.replaced("mail a@b.com now", pii.SpanModel((0.0,) * (pii.N_FEATURES + 1), {})) == "mail [EMAIL] now"


def test_em_finds_the_reliable_labeler():
    rng = random.Random(5)
    counts = Counter()
    for _ in range(4000):
        truth = 1 if rng.random() < 0.7 else -1
        counts[tuple(truth if rng.random() < a else -truth for a in (0.95, 0.8, 0.6))] += 1
    prior, right = weak.estimate(sorted(counts.items()), 3)
    assert abs(prior - 0.7) < 0.08 and right[0] > right[1] > right[2]


# Toxicity


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen, held = labels.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 = 0")
    found = toxicity.judge(docs.join(held.select("doc_id"), "doc_id"), labels.limit(0)).limit(1).collect()
    assert found[0].toxic is False
    chain = toxicity.train(docs, seen)
    scored = toxicity.scored(docs.join(held, "doc_id").select("text", "toxic"), chain, "p").select("toxic", "p.p_toxic").collect()
    hit = sum(r.p_toxic >= 0.5 for r in scored if r.toxic) / sum(r.toxic for r in scored)
    false = sum(r.p_toxic >= 0.5 for r in scored if not r.toxic) / sum(1 - r.toxic for r in scored)
    assert hit > 0.85 and false < 0.01


def test_training_rows_are_bounded_by_labels(spark, monkeypatch):
    seen = []
    fit = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda x, *a: (seen.append(len(x)), fit(x, *a))[1])
    docs = spark.createDataFrame([(k % 2, f"text {k} of {k % 2}") for k in range(2_000)], "doc_id long, text string")
    toxicity.train(docs, spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int"))
    assert seen == [2]


def test_chain_feeds_out_of_fold_predictions():
    """Against a plain chain: each link is fitted on the words and what models of the other folds say of the links before."""
    rng = np.random.default_rng(6)
    x = rng.random((200, 4)).astype("f4")
    y = np.stack([x[:, 0] > 0.5, x[:, 1] > 0.6, x[:, 0] + x[:, 1] > 1], axis=1).astype("f4")
    folds = np.arange(200) % toxicity.FOLDS
    chain, own = toxicity.fit_chain(x, y, folds, ("a", "b")), x
    for link in range(3):
        want = toxicity.fit_linear(own, y[:, link])
        assert np.allclose(chain.weights[link], want, atol=1e-4)
        fed = np.zeros(200, "f4")
        for k in range(toxicity.FOLDS):
            w = toxicity.fit_linear(own[folds != k], y[folds != k, link])
            fed[folds == k] = toxicity.sigmoid(w[0] + own[folds == k] @ w[1:])
        own = np.hstack([own, fed[:, None]])


# Quality rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    words = WORDS.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, documents, rows):
    extra = ["a b c a b c", "x x x x x", "a b c d", "one\n\none\n \none", "", "a\x0bb\x0cc", "é é é é # é é é", "a b c x a b c y a b c"]
    both = documents.select("doc_id", "text").union(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    found = {r.doc_id: r for r in quality.judge(both).collect()}
    for doc_id, text in rows + [(10_000 + k, t) for k, t in enumerate(extra)]:
        r, want = found[doc_id], plain_measures(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text[:80]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_keeps_good_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.judge(docs).join(labels, "doc_id").filter("not base_failed").collect()
    kept = [r.kept for r in found if r.quality]
    assert sum(kept) / len(kept) > 0.97
    dropped = [not r.kept for r in found if not r.quality]
    assert sum(dropped) / len(dropped) > 0.5


# Urls


def plain_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_urls(spark):
    odd = ["HTTP://A.Example.NET/de/8#x", "x://net/de/", "a://b://c/d", "://org/es/1", "no", "http://example.com?x/en/", None, "ftp://notexample.com/en/7", "http://sub.net/de/9"]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    pages = pages.union(spark.createDataFrame([(10_000 + k, u) for k, u in enumerate(odd)], "page_id long, url string"))
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    found = {r.page_id: r for r in urls.filter_urls(pages).collect()}
    for r in pages.collect():
        host, path = plain_url(r.url)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        got = found[r.page_id]
        assert (got.host, got.path) == (host, path)
        assert got.rule == (max(fits)[1] if fits else None)
        assert got.verdict == (max(fits)[2] if fits else ("block" if got.p_block >= 0.5 else "allow"))


def test_suffix_statistics_are_out_of_fold_and_cover_every_suffix(spark):
    rows = [(f"s{k}", f, k % 5 + 1, 0 if f < 0 else k % 5 + 1, 0.0 if f < 0 else float((k + f) % 2)) for k in range(3000) for f in (-1, 0, 1)]
    stats = spark.createDataFrame(rows, "suffix string, fold int, n long, labelled long, blocked double")
    n, own = sum(r[2] for r in rows), {}
    for r in rows:
        own.setdefault(r[0], []).append(r)
    found = {(r.suffix, r.fold): r for r in urls.suffix_features(stats, n, 0.25).collect()}
    assert len(found) == 9000
    for suffix, fold, *_ in rows:
        rest = [r for r in own[suffix] if r[1] != fold]
        got = found[suffix, fold]
        assert got.suffix_share == pytest.approx(sum(r[2] for r in own[suffix]) / n)
        assert got.suffix_blocked == pytest.approx((sum(r[4] for r in rest) + 2.5) / (sum(r[3] for r in rest) + 10))


def test_urls_of_many_suffixes_are_all_judged(spark):
    pages = spark.range(6000).selectExpr("id page_id", "case when id % 2 = 0 then concat('http://h', id, '.com/', if(id % 4 = 0, 'en/', 'xx/')) else concat('http://a.net', id, '/de/') end url")
    assert urls.filter_urls(pages).filter("verdict in ('allow', 'block')").count() == 6000


# Sharding


def test_sharding(documents, rows):
    found = {r.doc_id: r for r in sharding.shard_documents(documents).collect()}
    for doc_id, text in rows:
        r = found[doc_id]
        assert r.size == len(text.encode()) + 8 and r.text_crc32 == crc32(text.encode())
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
    for shard in range(24):
        slots = sorted(r.slot for r in found.values() if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_weight_changes_stay_in_their_subtree(spark):
    keys = spark.range(20_000)
    tree = sharding.base_tree()
    rack = tree[0].children[0]
    heavier = (sharding.Node(tree[0].id, (sharding.Node(rack.id, (sharding.Shard(0, 2.0), *rack.children[1:])), *tree[0].children[1:])), *tree[1:])
    moved = keys.select(sharding.shard_of(keys.id, tree).alias("a"), sharding.shard_of(keys.id, heavier).alias("b")).filter("a <> b").collect()
    assert moved and all(not (r.a >= 12 and r.b >= 12) for r in moved)  # no row moves within the untouched region
    counts = Counter(r.a for r in keys.select(sharding.shard_of(keys.id, heavier).alias("a")).collect())
    assert abs(counts[0] / 20_000 - 2 / 25) < 0.01


def test_slots_of_a_row_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 500)
    docs = spark.range(6000).selectExpr("if(id < 4000, 7, id) doc_id", "if(id < 4000, 'same', concat('t', id)) text")
    slots = {}
    for r in sharding.shard_documents(docs).collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, slots.values())) == 6000
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


# SentencePiece


@pytest.fixture(scope="module")
def codec():
    return pieces.PieceCodec(tokenizer_path("piece_bpe_32k.model"))


PIECES = st.lists(st.sampled_from(["the ", " ", "  ", "\n", "thing", "a", "é", "日本", "😀", "▁", "tion", "<s>", "1", "000", "zzz", "<0x0A>"]), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(text=PIECES, chunk=st.integers(17, 60))
def test_chunks_encode_as_the_library_does(codec, text, chunk):
    want = codec.model.encode(text)
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == want
    assert codec.decode(np.array(want, "u4")) == codec.model.decode(want)
    if not text:
        return
    z, margin, out = pieces.BLANK + text.replace(" ", pieces.BLANK), codec.longest, b""
    cuts = [(max(0, k - margin), k, min(len(z), k + chunk)) for k in range(0, len(z), chunk)]
    slices = [z[a : k + chunk + margin] for a, k, _ in cuts]
    shift = lambda s, a: [(q + a, m) for q, m in s]
    rows = []
    for (a, k, to), part in zip(cuts, slices, strict=True):
        ins, outs, weight = codec.transfer(part, k - a, to - a)
        rows.append((shift(ins, a), shift(outs, a), weight))
    for ((q, m), (x, n)), (a, k, to), part in zip(pieces.combine(rows), cuts, slices, strict=True):
        out += codec.backtrace(part, k - a, to - a, (q - a, m), (x - a, n))
    assert np.frombuffer(out, "<u4").tolist() == want


def test_giant_documents_round_trip(spark, codec):
    texts = ["word " * 3000, "ab" * 5000, "x" * 9000, "日本語" * 4000, "a  b " * 2500, " " * 9000 + "end"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    encoded = pieces.encode(docs, chunk=1024, fan=2).cache()  # up to 15 chunks: three levels of products
    for r in encoded.collect():
        assert r.ids == codec.model.encode(texts[r.doc_id]) and r.n_chunks > 4
    assert encoded.count() == 7
    assert {r.doc_id: r.text for r in pieces.decode(encoded).collect()} == dict(enumerate(texts))


def test_products_are_associative(codec):
    z, size = pieces.BLANK + "xyzzy" * 40, 24
    cuts = [(k, min(len(z), k + size)) for k in range(0, len(z), size)]
    chunks = [codec.transfer(z, *c) for c in cuts]
    left = chunks[0]
    for c in chunks[1:]:
        left = pieces.product(left, c)
    tree = pieces.products(chunks)[-1][0]
    assert left[:2] == tree[:2] and np.array_equal(left[2], tree[2]) and (tree[2] == 0).any()


def test_giant_documents_without_an_id(spark, codec):
    texts = ["ab " * 3000, "x" * 5000]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert sorted(r.ids for r in pieces.encode(docs, chunk=2048).collect()) == sorted(map(codec.model.encode, texts))


# Packing


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB'sé ²3!\n\t<|>日Σİ́", max_size=60))
def test_word_tokenizer_is_the_library(text):
    own = test_word_tokenizer_is_the_library.__dict__.setdefault("own", WordTokenizer(tokenizer_path("word_bpe_49k.json")))
    want = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(next(iter(own.ids([text]))), "<u4").tolist() == want


def test_packing(documents, rows):
    own = WordTokenizer(tokenizer_path("word_bpe_49k.json"))
    ids = {d: own.tokenizer.encode(t, add_special_tokens=False).ids + [2] for d, t in rows}
    found = packing.pack(documents).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
    for d, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[d])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    tokens = sum(map(len, ids.values()))
    assert 1 - tokens / (packing.CAPACITY * len(by_sequence)) < 0.05


@given(st.integers(1, 50_000))
def test_cut(length):
    parts = packing.cut(length)
    assert sum(parts) == length and max(parts) <= packing.CAPACITY and len(parts) <= length // packing.CAPACITY + 4


# Near duplicates


def plain_similarity(a, b):
    def weigh(t):
        w = t.lower().encode().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    a, b = weigh(a), weigh(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_near_duplicates(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 300))) for _ in range(150)]
    for k in range(60):
        base = texts[k % 30].split()
        for _ in range(max(1, len(base) // rng.choice([30, 60, 200]))):
            base[rng.randrange(len(base))] = rng.choice(words)
        texts.append(" ".join(base))
    texts += texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or plain_similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = {i: find(i) for i in range(len(texts))}
    for sizes in ((near_dedup.CHUNK, near_dedup.ROVERS), (2_000, 500)):
        got = {r.doc_id: r.class_id for r in near_dedup.classify(docs, chunk=sizes[0], rovers=sizes[1]).collect()}
        assert got == want


def changed(text, share, rng):
    """text with single words put in until the plain similarity falls to share."""
    words = text.split()
    while True:
        put = list(words)
        put[rng.randrange(len(put))] = f"n{rng.random()}"
        if plain_similarity(text, " ".join(put)) < share:
            return " ".join(words)
        words = put


@pytest.mark.parametrize("sizes", [(near_dedup.CHUNK, near_dedup.ROVERS), (5_000, 1_500)])
def test_threshold_is_the_same_in_hot_groups(spark, sizes):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(5000)]
    new = lambda: " ".join(rng.choices(words, k=400))
    near, copied = new(), new()
    texts = [near, *[changed(near, share, rng) for share in [0.81, 0.82, 0.83, 0.85] * 20], *[copied] * 80, changed(copied, 0.81, rng)]
    texts += [changed(near, 0.6, rng), changed(copied, 0.6, rng), *[new() for _ in range(80)]]
    want = [0] * 81 + [81] * 81 + list(range(162, len(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in near_dedup.classify(docs, chunk=sizes[0], rovers=sizes[1]).collect()}
    assert [got[k] for k in range(len(texts))] == want
    kept = {r.doc_id for r in near_dedup.remove(docs).collect()}
    assert kept == set(want)


def test_samples_collide_as_weighted_jaccard():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1 << 48, 600, dtype=np.uint64)
    a, b = np.sort(ids[:400]), np.sort(ids[100:])
    w_a, w_b = rng.integers(1, 4, 400).astype(float), rng.integers(1, 4, 500).astype(float)
    s = [near_dedup.signatures(np.zeros(len(x), np.int64), x, w, 1)[0] for x, w in ((a, w_a), (b, w_b))]
    weight_a, weight_b = dict(zip(a.tolist(), w_a, strict=True)), dict(zip(b.tolist(), w_b, strict=True))
    keys = weight_a.keys() | weight_b.keys()
    want = sum(min(weight_a.get(k, 0), weight_b.get(k, 0)) for k in keys) / sum(max(weight_a.get(k, 0), weight_b.get(k, 0)) for k in keys)
    assert abs((s[0] == s[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / len(s[0]))


@pytest.mark.parametrize("parts", [1, 40])
def test_document_frequencies_are_counted_over_all_documents(spark, parts):
    rng = random.Random(8)
    lines = [" ".join(rng.choices("abcdefghij", k=6)) for _ in range(12)]
    texts = [" ".join(x for k, x in enumerate(lines) if rng.random() < 0.02 * k) + f" tail number {i} of these texts" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    df = Counter()
    for t in texts:
        df.update(shingles.shingles([t])[1].tolist())
    known = near_dedup.weights(near_dedup._texts(*keyed(docs)))
    ids = np.array(sorted(df), np.uint64)
    want = near_dedup.idf(np.array([df[i] for i in ids.tolist()]), 300) / near_dedup.STEPS
    assert (known.of(ids) <= want).all() and (known.of(ids) == want).mean() > 0.99  # a collision only lowers a weight
    assert len(set(want.tolist())) > 5


def test_similarity_with_idf_decides(spark):
    """Pairs of equal plain similarity, on either side of the threshold by what their differing shingles weigh."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(4000)]
    new = lambda n: " ".join(rng.choices(words, k=n))
    lines, tails = [new(25) for _ in range(2)], [new(25) for _ in range(2)]
    body, other = new(90), new(90)
    texts = [f"{body} {lines[0]}", f"{body} {lines[1]}", f"{other} {tails[0]}", f"{other} {tails[1]}"]
    texts += [f"{new(60)} {lines[k % 2]}" for k in range(300)] + [new(60) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = near_dedup.weights(near_dedup._texts(*keyed(docs)))

    def weighted(a, b):
        (_, x, n), (_, y, m) = shingles.shingles([a]), shingles.shingles([b])
        return near_dedup.similarity(x, n, y, m, known)

    assert plain_similarity(texts[0], texts[1]) < 0.8 and plain_similarity(texts[2], texts[3]) < 0.8
    assert weighted(texts[0], texts[1]) >= 0.8 > weighted(texts[2], texts[3])
    got = {r.doc_id: r.class_id for r in near_dedup.classify(docs).collect()}
    assert got[1] == 0 and got[3] == 3


def test_counts_are_not_capped(spark):
    docs = spark.createDataFrame([(0, "a " * 40_000), (1, "a " * 60_000), (2, "a " * 60_001), (3, "b " * 50_000)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.classify(docs).collect()} == {0: 0, 1: 1, 2: 1, 3: 3}


def test_long_unrelated_texts_share_no_samples():
    rng = np.random.default_rng(3)
    ids = [np.sort(rng.integers(0, 1 << 48, 400_000, dtype=np.uint64)) for _ in range(4)]
    for weight in (np.ones(400_000), rng.integers(1, 4, 400_000) * 0.5):
        s = [near_dedup.signatures(np.zeros(len(x), np.int64), x, weight, 1)[0] for x in ids]
        assert all((s[i] == s[j]).sum() <= 1 for i in range(4) for j in range(i))


def test_rows_that_share_an_id_keep_their_own_class(spark):
    rng = random.Random(2)
    a, b, c = (" ".join(rng.choices("abcdefghijklmnop", k=80)) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (5, a + " end"), (5, b), (5, b), (None, c), (None, a), (7, c)], "doc_id long, text string")
    kept = sorted(((r.doc_id or -1), r.text) for r in near_dedup.remove(docs).collect())
    assert kept == sorted([(-1, c), (-1, a), (5, b)])


def test_shingles_are_whole_texts():
    doc, ids, count = shingles.shingles(["a b c d e f", "A  b\nc d e f", "a b", "", "x y z x y z x y z x y z"])
    assert np.bincount(doc, minlength=5).tolist() == [2, 2, 1, 0, 3]
    assert ids[doc == 0].tolist() == ids[doc == 1].tolist()
    assert count[doc == 4].sum() == 8


# Fingerprints


def test_fingerprints(documents, rows):
    found = {r.doc_id: r for r in fingerprints.compare(documents).collect()}
    near, error = [], []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = found[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = Counter(text.lower().split()), Counter(edited.lower().split())
        near.append(r.near_edited > r.near_next)
        error.append(r.near_edited - sum((a & b).values()) / max(1, sum((a | b).values())))
    by_text = {}
    for doc_id, text in rows:
        assert by_text.setdefault(text, found[doc_id].fingerprint) == found[doc_id].fingerprint
    assert np.mean(near) > 0.9 and abs(np.mean(error)) < 0.04


def test_likeness_is_close_on_each_document(documents, rows):
    found = {r.doc_id: r.near_edited for r in fingerprints.compare(documents).collect()}
    error = []
    for k, (doc_id, text) in enumerate(rows):
        q = len(text) // 4
        a, b = Counter(text.lower().split()), Counter((text[: len(text) - q] + rows[(k + 1) % len(rows)][1][:q]).lower().split())
        error.append(found[doc_id] - sum((a & b).values()) / max(1, sum((a | b).values())))
    assert math.sqrt(np.mean(np.square(error))) < 0.075


# Repeated spans


def plain_removed(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data = text.encode()
        mark = bytearray(len(data))
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                mark[i : i + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(x for x, m in zip(data, mark, strict=True) if not m)
        runs = sum(1 for i in range(len(mark)) if mark[i] and not (i and mark[i - 1]))
        out[doc_id] = (len(data), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("batches", "hot"), [(1, False), (4, False), (5, True)])
def test_repeated_spans(spark, documents, rows, batches, hot):
    rng = random.Random(9)
    passages = ["".join(rng.choices("abcdé ", k=rng.randint(90, 260))) for _ in range(6)]
    more = [(10_000 + k, "".join(rng.choice(passages) if rng.random() < 0.7 else "".join(rng.choices("xyz ", k=40)) for _ in range(12))) for k in range(40)]
    more += [(20_000, "The " * 200), (20_001, "a" * 1000), (20_002, "The " * 100)]
    heads, block_runs = None, spans_index.BLOCK_RUNS
    if hot:  # every head of these texts is spread in scans, and blocks are so small that many heads exceed them
        found = spans_index.runs([t.encode() for _, t in more if len(t) >= 100])
        heads, block_runs = np.unique(found[0] ^ found[1]), 5
    both = documents.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in spans_index.removed_spans(both, batches, heads, block_runs).collect()}
    assert found == plain_removed(rows + more)


def one_head(n):
    """Texts that share 16 bytes, which are their anchor, among bytes of their own."""
    rng = np.random.default_rng(6)
    new = lambda k: rng.integers(97, 123, k, dtype=np.uint8).tobytes()
    hashes = {x: int(spans_index.gram_hashes(x)[0]) for x in (new(16) for _ in range(200_000))}
    head = min(hashes, key=hashes.get)
    return [(new(110) + head + new(110)).decode() for _ in range(n)]


def test_hot_heads_are_cut_into_blocks(spark, monkeypatch):
    texts = one_head(600)
    texts += [t[:150] + "0" * 60 + t[20:] for t in texts[:100]]
    rows = [(k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in spans_index.removed_spans(docs, block_runs=60).collect()}
    assert found == plain_removed(rows)
    runs = spans_index.runs([t.encode() for t in texts])
    some = np.unique(np.stack(runs[:2]), axis=1, return_counts=True)[1]
    assert some.max() >= 600  # ten times the block
    order = np.lexsort((runs[3], runs[2], runs[1], runs[0]))
    a, b, context, doc, s, e = (c[order] for c in runs)
    counts = {h: n for h, n in zip(*np.unique(a, return_counts=True), strict=True)}
    stretches = [texts[d].encode()[i : j + 100] for d, i, j in zip(doc, s, e, strict=True)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, context, doc, np.zeros(len(a), np.int64), s)] + [pa.array(stretches), pa.array([counts[h] > 60 for h in a])], spans_index.STRETCHES)
    held, made = [], spans_index.windows
    monkeypatch.setattr(spans_index, "windows", lambda own: (held.append(len(own)), made(own))[1])
    assert list(spans_index.compare(iter([batch.slice(k, 50) for k in range(0, len(a), 50)]), 60))
    assert max(held) <= 60 and sum(held) == len(a)


def test_levels_hold_each_context_once_where_heads_are_spread(spark):
    texts = one_head(120)
    texts += texts[::-1] + [texts[k] + texts[k + 1] for k in range(100)]
    found = spans_index.runs([t.encode() for t in texts])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        family = spans_index.SuffixFamily(spark, np.unique(found[0] ^ found[1]))
        rows = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc long, sub long, text string")
        for batch in spans_index.dealt(rows, 4):
            family.add(batch)
        assert [n for n, _ in family.levels] == [4]
        level = family.levels[0][1].select("head_a", "head_b", "context", F.input_file_name().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(level) == len({(r.head_a, r.head_b, r.context) for r in level}) == len(set(zip(*(c.tolist() for c in found[:3]), strict=True)))
    assert len({r.p for r in level}) > 8


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rng = random.Random(10)
    new = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    alone, passage = new(600), new(300)
    rows = [(None, alone), (None, new(50) + passage + new(80)), (3, passage), (3, new(200)), (3, "x" + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(r.doc_id, r.text) for r in spans_index.without_spans(docs).collect()]
    assert (None, alone) in left and rows[3] in left
    assert sorted(t for d, t in left if d == 3 and t != rows[3][1]) == ["", "x"]
    found = spans_index.removed_spans(docs).collect()
    assert sorted(r.n_removed for r in found) == [0, 0, 0, 300, 300] and len(found) == 5


def test_levels_merge_in_the_query(spark, documents, monkeypatch):
    families = []
    made = spans_index.SuffixFamily.__init__
    monkeypatch.setattr(spans_index.SuffixFamily, "__init__", lambda self, *a: (made(self, *a), families.append(self))[0])
    spans_index.removed_spans(documents)
    assert [f.merges for f in families] == [1]  # of four batches the second merges with the first, none follows the last


def test_levels_merge_geometrically(spark, documents, rows):
    texts = spans_index._texts(*keyed(documents))
    family, sizes, firsts = spans_index.SuffixFamily(spark), [], []
    for batch in spans_index.dealt(texts, 7):
        family.add(batch)
        sizes.append([n for n, _ in family.levels])
        firsts.append(sum(level.count() for _, level in family.levels))
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]
    key = ["head_a", "head_b", "context"]
    every = spans_index.runs([t.encode() for _, t in rows if len(t.encode()) >= 100])
    assert firsts[-1] == len(set(zip(*(c.tolist() for c in every[:3]), strict=True)))  # each context once, in one level
    top = family.levels[0][1].select(*key).collect()
    assert len(top) == len(set(top))


def test_equal_hashes_of_other_bytes_are_told_apart():
    data = b"".join(bytes([65 + k]) * 100 for k in (0, 1, 0, 1))
    at = np.array([0, 100, 200, 300])
    assert spans_index.repeated(np.zeros(4, np.uint64), at, data, np.arange(4)).tolist() == [False, False, True, True]


def test_spans_of_documents_longer_than_a_stretch():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 123, spans_index.STRETCH + 5000, dtype=np.uint8).tobytes()
    *_, doc, s, e = spans_index.runs([text])
    covered = np.zeros(len(text) - 99, bool)
    for a, b in zip(s, e, strict=True):
        covered[a : b + 1] = True
    assert covered.all()


def test_terms_of_long_texts_are_counted_in_slices():
    text = "Bad words, the BADDEST wording; 12x\n" * 90_000
    assert len(text) > 3 * toxicity.SLICE
    words = [w for part in toxicity.words_of(text) for w in part]
    assert words == toxicity.WORD.findall(text.lower())
    x = toxicity.features([text, ""], ("bad", "badd~", "absent"))
    assert np.allclose(np.expm1(x[0, :2]), 90_000) and not x[1].any() and x[0, 2] == 0


def test_batches_are_sliced_by_the_bytes_of_their_texts():
    texts = ["a" * 5, None, "b" * 7, "é" * 50, "", "c" * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["k", "text"])
    parts = [b.column(0).to_pylist() for b in memory.by_bytes([batch, batch.slice(0, 0)], 1, 12)]
    assert parts == [[0, 1, 2], [3], [4, 5]]
    assert [b.num_rows for b in memory.released(iter([batch]))] == [6]


def near_copies(rows, share, seed):
    """Of each longer text a copy with some words replaced, and their plain similarity."""
    rng = random.Random(seed)
    out = []
    for doc_id, text in rows:
        words = text.split(" ")
        if len(words) < 60:
            continue
        for k in rng.sample(range(len(words)), max(1, int(share * len(words)))):
            words[k] = f"new{rng.randrange(10**6)}"
        copy = " ".join(words)
        out.append((doc_id, copy, plain_similarity(text, copy)))
    return out


def test_recall_on_near_copies(spark, rows):
    """Copies of 0.8 or more by plain similarity share their original's class."""
    single = {text: doc_id for doc_id, text in rows}
    copies = near_copies([(d, t) for t, d in single.items()], 0.012, 12)
    docs = spark.createDataFrame([(d, t) for t, d in single.items()] + [(d + 1_000_000, t) for d, t, _ in copies], "doc_id long, text string")
    classes = {r.doc_id: r.class_id for r in near_dedup.classify(docs).collect()}
    wanted = [(d, s) for d, _, s in copies if s >= 0.8]
    found = [classes[d] == classes[d + 1_000_000] for d, _ in wanted]
    print(f"recall {np.mean(found):.4f} of {len(found)} near copies")
    assert len(found) > 50 and np.mean(found) >= 0.97


def test_workers_forget_what_other_operators_remembered():
    forgotten = []
    before = dict(memory.REMEMBERED)
    memory.REMEMBERED.update({"x": lambda: forgotten.append("x"), "y": lambda: forgotten.append("y")})
    try:
        assert list(memory.released(iter([1, 2]), "x")) == [1, 2]
    finally:
        memory.REMEMBERED.clear()
        memory.REMEMBERED.update(before)
    assert forgotten == ["y"] and {"words", "shingles"} <= set(before)


def test_draws_of_repeated_terms_come_from_columns(spark):
    """A term that occurs once is drawn by its hash; one that occurs more often is drawn lower or alike, and its logarithms are computed once."""
    from objectlake.llm import fingerprints

    rows = [(n, 0, 7_000_001, float(n), True, True) for n in (1, 2, 50)]
    weighed = spark.createDataFrame(rows, "doc long, sub long, _term long, _n double, own boolean, edited boolean")
    drawn = fingerprints.drawn(weighed)
    got = {r.doc: r._draws for r in drawn.collect()}
    assert all(a >= b for a, b in zip(got[1], got[2])) and sum(a > b for a, b in zip(got[1], got[50])) > 50
    assert got[1] == spark.sql(f"select array({', '.join(f'shiftrightunsigned(xxhash64(7000001L, {j}), 1)' for j in range(fingerprints.SAMPLES))})").first()[0]


def test_draws_travel_as_arrays(spark):
    """Rows of draws have few columns, whatever the samples, and each row meets one set of minima; a term that weighs less in one text is a draw of each."""
    from objectlake.llm import fingerprints

    rows = [(1, 0, 7_000_001, float(n), own, not own) for n, own in ((1, True), (3, False))]
    weighed = spark.createDataFrame(rows, "doc long, sub long, _term long, _n double, own boolean, edited boolean")
    plan = fingerprints.drawn(weighed)._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"_{name}{fingerprints.SAMPLES - 1}#" not in plan for name in "aev")
    words = spark.createDataFrame([(1, 0, [["x", "y", "y"], ["z"], ["z", "z"]]), (2, 0, [["x", "y", "y", "z"], [""], ["z"]])], "doc long, sub long, words array<array<string>>")
    found = {r.doc: r for r in fingerprints.signatures(words).collect()}
    assert found[1].own == found[2].own and found[1].edited == found[2].edited and found[1].own != found[1].edited


def test_stages_hand_texts_to_workers_in_small_batches(spark):
    """10,000 texts of 2 KB are several batches; the session's own smaller setting stays."""
    from objectlake.session import BATCH, BATCH_BYTES, small_batches

    before = spark.conf.get(BATCH)
    try:
        small_batches(spark)
        texts = spark.range(0, 10_000, 1, 1).select(F.repeat(F.lit("ab"), 1000).alias("text"))
        sizes = [r.n for r in texts.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in bs), "n long").collect()]
        assert len(sizes) > 1 and max(sizes) < 2 * BATCH_BYTES
        spark.conf.set(BATCH, "65536")
        small_batches(spark)
        assert spark.conf.get(BATCH) == "65536"
    finally:
        spark.conf.set(BATCH, before)
