"""Gold assembly, approved pairs, declared access and settled statuses on small tables."""

import pytest

from objectlake.model import Field, ObjectType
from objectlake.operators import clean, edits, fuse, objects
from objectlake.plans import bindings, medallion
from objectlake.sources import tables

SF = "/root/testdata/sf0.001"
PERSON = ObjectType("Person", "a", "pid", (Field("pid", "id"), Field("name"), Field("area"), Field("score", data_type="integer")))


def _sources(spark):
    a = spark.createDataFrame([("1", "ann", "n", 1), ("2", "bob", "n", None), ("3", "", "s", 3), ("4", None, "s", 4), (None, "zed", "s", 5)], "id string, name string, area string, score long")
    b = spark.createDataFrame([("x", "ann", "n", 9), ("y", "bob", "s", 8), ("z", "cyd", "s", 7)], "id string, name string, area string, score long")
    return {"a": (a, "id"), "b": (b, "id")}


def _entities(spark, pairs, security=None):
    approved = spark.createDataFrame(pairs, "left string, right string") if pairs is not None else None
    found = fuse.resolve(fuse.sourced(_sources(spark), ["name", "area", "score"]), ["name"], security, approved)
    return {(r.source, r.source_id): (r.entity_id, r.refused) for r in found.collect()}


def test_approved_pairs_join_groups_transitively(spark):
    alone = _entities(spark, None)
    assert alone[("b", "x")] == ("1", False) and alone[("a", "3")] == ("3", False) and alone[("b", "z")] == ("b:z", False)
    assert _entities(spark, []) == alone
    # z joins 4, 4 joins 1, which the key had joined with x; unknown rows, repeats and a pair of one row count for nothing
    joined = _entities(spark, [("b:z", "a:4"), ("a:4", "a:1"), ("a:4", "a:1"), ("a:1", "b:gone"), ("a:3", "a:3"), (None, "a:2")])
    assert {k for k, v in joined.items() if v == ("1", False)} == {("a", "1"), ("b", "x"), ("a", "4"), ("b", "z")}
    assert joined[("a", "3")] == ("3", False) and joined[("a", "2")] == joined[("b", "y")] == ("2", False)


def test_approved_pairs_do_not_pass_a_boundary(spark):
    found = _entities(spark, [("b:z", "a:1")], "area")
    assert found[("a", "1")] == ("1", True) and found[("b", "x")] == ("b:x", True) and found[("b", "z")] == ("b:z", True)
    assert found[("a", "2")] == ("2", True) and found[("b", "y")] == ("b:y", True)
    assert found[("a", "3")] == ("3", False)


def test_gold_of_two_sources(spark, tmp_path):
    lake = tables.Lake(spark, f"file://{tmp_path}/gold")
    for name, (rows, _) in _sources(spark).items():
        lake.publish(f"silver_{name}", rows.filter("id is not null"))
    rule = medallion.Identity({"a": ("a", "id"), "b": ("b", "id")}, ["name"], {"score": ["b", "a"]}, "area")
    assert medallion.build_gold(lake, [PERSON], identities={"Person": rule}) == {"Person": 1}
    rows = {r.pid: (r.name, r.score, r._fused_from) for r in lake.read("gold_Person").collect()}
    assert rows == {"1": ("ann", 9, "a,b"), "2": ("bob", None, "a"), "b:y": ("bob", 8, "b"), "3": ("", 3, "a"), "4": (None, 4, "a"), "b:z": ("cyd", 7, "b")}
    lost = sorted((r.entity_id, r.kind, r.field, r.losing) for r in lake.appended("gold_conflicts_Person").collect())
    assert lost == [("1", "property", "score", "1"), ("2", "security", "area", "n"), ("b:y", "security", "area", "s")]
    assert medallion.build_gold(lake, [PERSON], identities={"Person": rule}) == {"Person": 1}  # unchanged: no version, no conflicts again
    assert lake.appended("gold_conflicts_Person").count() == 3


def test_links_to_nothing_refuse_a_type_alone(spark, tmp_path):
    lake = tables.Lake(spark, f"file://{tmp_path}/links")
    owner = ObjectType("Owner", "owner", "id", (Field("id"),))
    thing = ObjectType("Thing", "thing", "id", (Field("id"), Field("owner", links_to="Owner")))
    assert [[t.name for t in w] for w in medallion.waves([thing, owner])] == [["Owner"], ["Thing"]]
    lake.publish("silver_owner", spark.createDataFrame([("o",)], "id string"))
    lake.publish("silver_thing", spark.createDataFrame([("t", "o"), ("u", None)], "id string, owner string"))
    assert medallion.build_gold(lake, [thing, owner]) == {"Owner": 1, "Thing": 1}
    lake.publish("silver_thing", spark.createDataFrame([("t", "gone"), ("u", "o")], "id string, owner string"))
    refused = {}
    assert medallion.build_gold(lake, [thing, owner], refused=refused) == {"Owner": 1} and "dangling owner" in refused["Thing"]
    assert sorted(r.id for r in lake.read("gold_Thing").filter("owner is null").collect()) == ["u"]
    with pytest.raises(tables.AuditFailed):
        medallion.build_gold(lake, [thing, owner])


def test_functions_read_declared_types_alone(spark):
    read = objects.Declared(bindings.ONTOLOGY, bindings.loader(spark, SF), bindings.ASIA, frozenset({"Order", "Customer"}))
    whole = objects.ObjectSet.of(bindings.ONTOLOGY, "Customer", bindings.loader(spark, SF), bindings.ASIA)
    assert read("Customer").rows.count() == whole.rows.count()  # the boundary runs through undeclared types
    assert read("Customer").search_around("orders").rows.count() == whole.search_around("orders").rows.count()
    with pytest.raises(objects.Undeclared):
        read("Nation")
    with pytest.raises(KeyError):
        read("Customer").search_around("nation")


def test_settled(spark):
    log = [(1, "pending", 1), (1, "applied", 2), (1, "abandoned", 3), (2, "applied", 1), (2, "pending", 2), (3, "applied", 1), (4, "pending", 1), (4, "pending", 2)]
    found = edits.settled(spark.createDataFrame(log, "write_id int, status string, seq int"))
    assert sorted(map(tuple, found.collect())) == [(1, "applied", 1), (2, "pending", 1), (4, "pending", 0)]
    assert edits.settled(spark.createDataFrame([], "write_id int, status string, seq int")).count() == 0


def test_no_rules_keep_every_row(spark):
    kept, held, counts = clean.expectations(spark.range(3), [])
    assert kept.count() == 3 and held.count() == 0 and counts.count() == 0 and kept.columns == ["id"]
