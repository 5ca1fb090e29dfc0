"""Operators on literal rows, and laws that hold for any."""

import subprocess
import sys
from datetime import UTC, datetime
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from objectlake.functions.coerce import coerce, drift
from objectlake.functions.text import standardise
from objectlake.model import Field, LinkType, ObjectType, Ontology, Security, User
from objectlake.operators import changes, clean, edits, fuse, objects, secure, watch
from objectlake.operators.components import connected_components
from objectlake.operators.filters import Condition, predicate, resolve
from objectlake.plans import bindings, medallion
from objectlake.sources import tables

NOW = datetime(2024, 5, 10, 23, tzinfo=UTC)


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(expression(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("operator", "value", "kind", "kept"),
    [
        ("equals", "a", "string", ["a"]), ("equals", None, "string", [None]), ("in", ["a", "b"], "string", ["a", "b"]),
        ("not_in", ["a"], "string", ["b", "50%", None]), ("contains", "%", "string", ["50%"]),
    ],
)
def test_conditions(spark, operator, value, kind, kept):
    rows = spark.createDataFrame([("a",), ("b",), ("50%",), (None,)], "v string")
    assert [r.v for r in rows.filter(predicate(Condition("v", operator, value), kind)).collect()] == kept


def test_ranges(spark):
    rows = spark.createDataFrame([(1.0,), (2.5,), (None,)], "v double")
    assert rows.filter(predicate(Condition("v", "range", {"min": 1, "max": 2}), "number")).count() == 1
    for bad in ({"min": 3, "max": 2}, {}):
        with pytest.raises(ValueError):
            predicate(Condition("v", "range", bad), "number")
    with pytest.raises(ValueError):
        predicate(Condition("v", "in", []), "string")
    assert resolve(Condition("v", "relative_date", {"since_days": 9}), NOW).value == {"start": "2024-05-01"}


@pytest.mark.parametrize(
    ("kind", "fits", "refused"),
    [
        ("integer", [" 7 ", "-3"], ["1.5", "x", ""]), ("decimal", ["49.99", "1.100000000000"], ["1.12345678901", "1" * 30, "inf"]),
        ("date", ["2026-05-01"], ["2026-5-1", "2026-05-01T10:00", "2026-13-01"]), ("timestamp", ["2026-05-01T10:00:00"], ["2026-05-01T10:00:00+02:00"]),
        ("timestamptz", ["2026-05-01T10:00:00Z"], ["2026-05-01T10:00:00"]), ("boolean", ["ON", "no", "2"], ["maybe"]), ("number", ["1e3"], ["x"]),
    ],
)
def test_coercion_refuses_what_does_not_fit(spark, kind, fits, refused):
    got = column(spark, [*fits, *refused, None], lambda c: coerce(c, kind).isNotNull())
    assert got == [True] * len(fits) + [False] * (len(refused) + 1)


def test_drift(spark):
    rows = spark.createDataFrame([("1", "a"), ("x", "b"), (None, "c")], "n string, s string")
    assert [(r["column"], r.misfits, r.example) for r in drift(rows, {"n": "integer", "s": "string"}).collect()] == [("n", 1, "x"), ("s", 0, None)]


def plain_standard(t):
    import re
    import unicodedata

    t = unicodedata.normalize("NFC", t).replace("\r\n", "\n").replace("\r", "\n")
    lines = [re.sub(r"\s+", " ", x) for x in t.split("\n")]
    return re.sub(r" ?\n ?", "\n", "\n".join(lines)).strip(" \n")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="ab \t\r\né\x1c\x85\xa0é", max_size=12), min_size=1, max_size=20))
def test_standardise(spark, texts):
    assert column(spark, texts, standardise) == [plain_standard(t) for t in texts]


def test_expectations_hold_and_count(spark):
    rows = spark.createDataFrame([(1, 5.0, "x"), (2, -1.0, "xyz"), (3, None, "y")], "id int, v double, s string")
    rules = [clean.Constraint("v", "min", 0, "number", "quarantine"), clean.Constraint("s", "max_length", 2), clean.Constraint("v", "required")]
    kept, held, counts = clean.expectations(rows, rules)
    assert sorted(r.id for r in kept.collect()) == [1, 3] and [r.id for r in held.collect()] == [2]
    assert {(r.field, r.reason): r.n for r in counts.collect()} == {("v", "min"): 1, ("v", "required"): 1}
    with pytest.raises(clean.ExpectationFailed):
        clean.expectations(rows, [clean.Constraint("v", "min", 0, "number", "fail")])


def test_duplicates(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 5), (2, 5), (None, 1), (None, 2), (3, None), (3, 1), (4, 0)], "k int, v int")
    alone, others = clean.split_duplicates(rows, ["k"])
    assert [r.k for r in alone.collect()] == [4] and others.count() == 8
    kept, _ = clean.split_duplicates(rows, ["k"], "v")
    assert sorted((r.k or 0, r.v) for r in kept.collect()) == [(0, 2), (1, 2), (4, 0)]


def test_duplicates_of_two_key_columns_and_a_hot_null_key(spark):
    rows = spark.range(3000).selectExpr("if(id < 2000, null, id div 2) a", "if(id < 2000, null, 'x') b", "id v")
    alone, others = clean.split_duplicates(rows, ["a", "b"])
    assert alone.count() == 0 and others.count() == 3000
    kept, _ = clean.split_duplicates(rows, ["a", "b"], "v")
    assert {r.v for r in kept.collect()} == {1999} | set(range(2001, 3000, 2)) and kept.columns == rows.columns


def test_a_changed_condition_starts_a_new_baseline(spark):
    counts = lambda *rows: spark.createDataFrame(rows, "condition string, user_id string, definition string, n long")
    before = counts(("c", "u", "v1", 5), ("d", "u", "v1", 5), ("gone", "u", "v1", 7))
    now = counts(("c", "u", "v2", 9), ("d", "u", "v1", 6))
    assert [(r.condition, r.verdict) for r in watch.count_watch(before, now).collect()] == [("d", "gained 1")]
    kept = watch.baseline(before, now)
    assert sorted(map(tuple, kept.collect())) == [("c", "u", "v2", 9), ("d", "u", "v1", 6), ("gone", "u", "v1", 7)]
    assert watch.count_watch(kept, counts(("c", "u", "v2", 8))).first().verdict == "fell 1"


SNAPSHOT = st.dictionaries(st.integers(0, 20), st.one_of(st.none(), st.sampled_from("abc")), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(old=SNAPSHOT, new=SNAPSHOT)
def test_diff_applied_gives_the_new_snapshot(spark, old, new):
    frame = lambda d: spark.createDataFrame(list(d.items()), "id int, v string")
    state = {str(k): v for k, v in old.items()}
    for r in changes.diff(frame(old), frame(new), "id").collect():
        assert (r.change == "INSERT") == (r.id not in state)
        if r.change == "DELETE":
            assert r["values"].v == state.pop(r.id)
        else:
            state[r.id] = r["values"].v
    assert state == {str(k): v for k, v in new.items()}


def test_partial_reads(spark):
    old, new = spark.range(10).withColumn("v", F.lit(1)), spark.range(4).withColumn("v", F.lit(1))
    with pytest.raises(changes.PartialRead):
        changes.checked_diff(old, new, "id")
    assert changes.checked_diff(old, new, "id", accept=True).count() == 6


EDGES = st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=EDGES)
def test_components(spark, pairs):
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    found = connected_components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.id: r.component for r in found.collect()} == {x: find(x) for x in parent}


def test_long_chains_are_one_component(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(chain).filter("component <> 0").count() == 0


def test_match_probabilities(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id string, a string, b string, c string")
    found = fuse.candidates(rows(("1", "x", "y", "z")), rows(("2", "x", "y", "z"), ("3", "x", "y", "-"), ("4", "x", "y", None), ("5", "q", "y", "z")), ["a", "b", "c"], review=0.4)
    assert {r.right_id: (round(r.probability, 4), r.disposition) for r in found.collect()} == {"2": (0.9986, "propose"), "3": (0.4502, "review"), "4": (0.8902, "review")}


def test_identity_blank_keys_stand_alone(spark):
    frame = lambda *r: spark.createDataFrame(list(r), "id string, name string")
    sources = {"a": (frame(("1", "x"), ("2", " "), ("3", None)), "id"), "b": (frame(("9", "x"), ("8", " ")), "id")}
    found = fuse.resolve(fuse.sourced(sources, ["name"]), ["name"])
    assert {(r.source, r.source_id): r.entity_id for r in found.collect()} == {("a", "1"): "1", ("b", "9"): "1", ("a", "2"): "2", ("b", "8"): "b:8", ("a", "3"): "3"}


LOG = "id long, object_type string, object_id string, operation string, changes string, status string, created_at timestamp"


def test_overlay(spark):
    at = datetime(2024, 1, 2)
    log = spark.createDataFrame([
        (1, "T", "1", "update", '{"v":"applied"}', "applied", at), (2, "T", "1", "update", '{"v":null}', "pending", at), (3, "T", "2", "delete", "{}", "applied", at),
        (4, "T", "9", "create", '{"v":"new"}', "pending", at), (5, "T", "3", "update", '{"v":"old edit"}', "applied", datetime(2023, 1, 1)),
    ], LOG)
    lake = spark.createDataFrame([(1, "lake"), (2, "lake"), (3, "lake")], "id int, v string")
    found = edits.overlay(lake, "id", "T", log, F.lit("2024-01-01").cast("timestamp"), ["v"])
    assert {r.object_id: r.v for r in found.collect()} == {"1": None, "9": "new", "3": "lake"}


def test_batches_apply_whole_or_not_at_all(spark):
    state = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "object_id string, value string")
    writes = spark.createDataFrame([
        (1, "a", "update", "1", "x"), (1, "b", "update", None, "y"), (2, "c", "update", "stale", "z"), (2, "d", "create", None, "w"), (3, "e", "create", None, "v"),
    ], "batch_id int, object_id string, operation string, expected string, value string")
    new, status = edits.apply_batch(state, writes)
    assert {r.object_id: r.value for r in new.collect()} == {"a": "x", "b": "y", "c": "3", "e": "v"}
    assert {r.batch_id: r.status for r in status.collect()} == {1: "applied", 2: "abandoned", 3: "applied"}


def test_percentile_is_a_rank(spark):
    rows = spark.createDataFrame([(200, float(d), "r") for d in (1, 2, 3, 4)], "status int, duration_ms double, route string")
    r = watch.red(rows, ["route"]).first()
    assert (r.p50, r.p99, r.error_ratio) == (3.0, 4.0, 0.0)


def test_security(spark):
    types = (
        ObjectType("A", "a", "id", (Field("id", data_type="integer"), Field("region")), Security(field="region")),
        ObjectType("B", "b", "id", (Field("id", data_type="integer"), Field("a", data_type="integer", links_to="A"), Field("secret")), Security(via="a")),
    )
    ontology = Ontology({t.name: t for t in types}, {"B.a": LinkType("a", "B", "A", field="a", reverse="bs")}).expand()
    data = {"A": spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, region string"), "B": spark.createDataFrame([(1, 1, "s"), (2, 2, "s"), (3, 3, "s"), (4, None, "s")], "id int, a int, secret string")}
    user = User("u", "x", frozenset({"read:A", "read:B"}))
    seen = objects.ObjectSet.of(ontology, "B", data.__getitem__, user)
    assert [r.id for r in seen.rows.collect()] == [1]
    assert objects.ObjectSet.of(ontology, "B", data.__getitem__, User("n", None, frozenset({"read:*"}))).rows.count() == 0
    assert objects.ObjectSet.of(ontology, "B", data.__getitem__, User("n", "x")).rows.count() == 0
    around = objects.ObjectSet.of(ontology, "A", data.__getitem__, user).search_around("bs")
    assert [r.id for r in around.rows.collect()] == [1]
    first = seen.where(Condition("secret", "equals", "s")).rows.collect()
    assert first == secure.visible(ontology, "B", user, lambda n: data[n].filter("secret = 's'") if n == "B" else data[n]).collect()
    assert secure.visible_schema(ontology, User("d", None, frozenset({"discover:A"}))) == {"A": ["id", "region"]}
    assert set(ontology.without({"A"}).types) == set()


def test_pages_and_ceilings(spark):
    load = lambda n: spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id int, v string")
    t = ObjectType("T", "t", "id", (Field("id", data_type="integer"), Field("v", searchable=True)))
    some = objects.ObjectSet.of(Ontology({"T": t}), "T", load, User("u", None, frozenset({"read:*"})))
    assert [r.id for r in some.page("v").collect()] == [2, 3, 1, 4]
    assert [r.id for r in some.page("v:desc").collect()] == [4, 1, 3, 2]
    assert [r.id for r in some.page("v", 99, 0).collect()] == [2]
    assert [r.id for r in some.page("nothing", 2).collect()] == [3, 4]
    with pytest.raises(objects.TooMany):
        some.ids(ceiling=3)
    assert some.text(" ").rows.count() == 4 and some.text("B").rows.count() == 2
    facets = some.facets({"v": Condition("v", "equals", "a")})
    assert sum(r.n for r in facets.collect()) == 3


def test_lake_publishes_only_what_passes(spark, tmp_path):
    lake = tables.Lake(spark, f"file://{tmp_path}")
    rows = spark.range(10).withColumnRenamed("id", "k")
    audit = lambda new, old: tables.audit(new, "k", [], {}, old.count() if old is not None else None)
    assert lake.publish("t", rows, audit) == 1
    assert lake.publish("t", rows.repartition(3), audit) == 1
    with pytest.raises(tables.AuditFailed):
        lake.publish("t", rows.limit(2), audit)
    assert lake.read("t").count() == 10
    assert lake.publish("t", rows.union(spark.range(10, 12)), audit) == 2
    assert lake.read("t", 1).count() == 10 and lake.read("t").count() == 12


def test_sync_to_gold(spark, tmp_path):
    lake = tables.Lake(spark, f"file://{tmp_path}")
    source = bindings.table(spark, "/root/testdata/sf0.001", "customer")
    declared = {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "number", "c_mktsegment": "string"}
    rule = [clean.Constraint("c_acctbal", "min", 0, "number", "quarantine")]
    medallion.sync(lake, "customer", source, "c_custkey", declared, rule)
    assert medallion.build_gold(lake, [bindings.ONTOLOGY.types["Customer"], bindings.ONTOLOGY.types["Part"]]) == {"Customer": 1}
    assert lake.read("gold_Customer").count() == source.filter("c_acctbal >= 0").count()
    changed = source.withColumn("c_acctbal", F.when(F.col("c_custkey") == 1, 7.0).otherwise(F.col("c_acctbal"))).filter("c_custkey <> 2")
    medallion.sync(lake, "customer", changed, "c_custkey", declared, rule)
    assert sorted(r.change for r in lake.appended("changelog").collect()) == ["DELETE", "UPDATE"]
    assert medallion.build_gold(lake, [bindings.ONTOLOGY.types["Customer"]]) == {"Customer": 2}
    assert lake.appended("gold_history_Customer").count() >= 1
    with pytest.raises(medallion.Drift):
        medallion.sync(lake, "bad", source.withColumn("c_acctbal", F.lit("x")), "c_custkey", declared, [])
    assert medallion.targets([bindings.ONTOLOGY.types["Region"]]) == {"region": ["r_regionkey", "r_name"]}


def test_join_tables_are_published_without_dangling_pairs(spark, tmp_path):
    lake = tables.Lake(spark, f"file://{tmp_path}/links")
    lake.publish("gold_A", spark.createDataFrame([("1",), ("2",)], "id string"))
    lake.publish("gold_B", spark.createDataFrame([("7",), ("8",)], "id string"))
    lake.publish("silver_ab", spark.createDataFrame([(1, 7), (1, 7), (2, 8), (3, 7), (1, 9), (None, 7), (2, None)], "a int, b int"))
    assert medallion.publish_join_tables(lake, {"ab": ("a", "b", "A", "B", "ab")}) == {"ab": 1}
    assert sorted(map(tuple, lake.read("gold_link_ab").select("a", "b").collect())) == [("1", "7"), ("2", "8")]


def test_constraints_of_proposed_changes(spark):
    rows = [(1, "create", '{"x": "5", "y": ""}', "pending"), (2, "update", '{"x": "no"}', "applied"), (3, "delete", '{"x": "0"}', "pending"), (4, "update", '{"x": "0"}', "abandoned"), (5, "update", '{"y": null}', "pending")]
    log = spark.createDataFrame([(i, "T", "o", op, c, st) for i, op, c, st in rows], "id long, object_type string, object_id string, operation string, changes string, status string")
    rules = [edits.Constraint("x", "min", 6), edits.Constraint("x", "number"), edits.Constraint("y", "required")]
    found = edits.violations(log, "T", rules).collect()
    assert sorted((r.id, r.field, r.rule) for r in found) == [(1, "x", "min"), (1, "y", "required"), (2, "x", "number"), (5, "y", "required")]


def test_audit_lines_skip_torn_ones(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"user_id": 1, "at": 2}\n{"user_id": 3, "a\n')
    assert [r.user_id for r in tables.audit_entries(spark, f"file://{tmp_path}", "user_id int, at int").collect()] == [1]


def test_the_library_stands_without_its_corpus_part():
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('objectlake.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 100 and not any(n.startswith('op') for n in e.queries() if n[2:3].isdigit()), sorted(e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
