"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from objectlake.llm import fingerprints, near_dedup, packing, pieces, pii, quality, sharding, spans_index, toxicity, urls

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, doc long, spans string, p string, key string, p_toxic double, count long"
LONG = "lorem ipsum dolor sit amet " * 9000
TEXTS = [None, "", " ", "one", "a b c d", "Call +1 (555) 555-1234 or mail a.b@example.com now", "same text here again " * 9, "same text here again " * 9, LONG, "ä" * 40_000, "\n\n\t"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", len(t or ""), k, k, "x", "y", "z", 0.5, 1) for k, t in enumerate(TEXTS)]
    rows += [rows[6], (None, "no id " * 30, None, None, None, None, None, None, None, None, None, None), (None, None, *[None] * 10)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, None), (5, 0, 1), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "pii": lambda d, y: pii.find(d),
    "toxicity": lambda d, y: toxicity.judge(d, y),
    "quality": lambda d, y: quality.judge(d),
    "sharding": lambda d, y: sharding.shard_documents(d),
    "pieces": lambda d, y: pieces.round_trip(pieces.encode(d, chunk=16_384)),
    "near": lambda d, y: near_dedup.classify(d),
    "spans": lambda d, y: spans_index.removed_spans(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_document(name, docs, labels):
    assert OPERATORS[name](docs, labels).count() == docs.count()
    assert OPERATORS[name](docs.limit(0), labels).count() == 0
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_fingerprints_have_a_row_for_each_row(docs):
    found = fingerprints.compare(docs).collect()
    of = {}
    for r in docs.collect():
        of.setdefault(r.doc_id, []).append(len(r.text or ""))
    assert len(found) == docs.count()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append(r.n_chars)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in of.items()}
    assert fingerprints.compare(docs.limit(0)).count() == 0
    one = fingerprints.compare(docs.filter("doc_id = 5")).first()
    assert one.near_next == 1.0


def test_packing_holds_every_document(docs):
    assert packing.pack(docs).filter("start = 0").count() == docs.count()
    assert packing.pack(docs.limit(0)).count() == 0


def test_urls_take_nulls(spark):
    rows = [(0, None, "x"), (1, "", "x"), (2, "no scheme", None), (3, "http://A.COM/en/1?q#f", "x"), (3, "http://A.COM/en/1?q#f", "x"), (None, "://", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    found = urls.filter_urls(pages).collect()
    assert len(found) == 6 and all(r.verdict in ("allow", "block") for r in found)
    assert urls.filter_urls(pages.limit(0)).count() == 0


STAGES = {
    "toxicity": lambda d, y: toxicity.remove(d, y), "near_dedup": lambda d, y: near_dedup.remove(d),
    "suffix_dedup": lambda d, y: spans_index.without_spans(d), "pii": lambda d, y: pii.redact(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(name, docs, labels):
    out = STAGES[name](docs, labels)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert {(r.id, r.spans, r.p, r.key) for r in rows} <= {(r.id, r.spans, r.p, r.key) for r in docs.collect()}
    assert STAGES[name](docs.limit(0), labels).count() == 0
    if name != "near_dedup":
        assert len(rows) >= docs.count() - (name == "toxicity") * 3


def test_near_dedup_keeps_one_of_each_class(docs):
    kept = [r.text for r in near_dedup.remove(docs).collect()]
    assert kept.count("same text here again " * 9) == 1
    assert len([t for t in kept if not t]) == 1
    assert LONG in kept


def test_stage_names_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "pii", "packing"]
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001").cache()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert packed.select("doc_id").distinct().count() > 100
