"""Action templates: values, expected values, created ids, and what refuses a request."""

import duckdb
import pytest

from objectlake import catalogue
from objectlake.operators.actions import Action, Criterion, Step, propose

REQUESTS = "request_id int, user map<string,string>, parameters map<string,string>, lists map<string,array<string>>"
STATE = "object_id string, fields map<string,string>"
RENAME = Action(
    ("ids", "name"),
    (
        Step("update", "lists.ids", {"name": "parameter.name", "by": "user.id", "kind": "fixed"}, (
            Criterion("current.owner", "equals", "user.id", "not yours"),
            Criterion("current.size", "in", (1, 2, 30), "odd size", number=True),
            Criterion("parameter.name", "in", "lists.names", "no such name"),
            Criterion("current.size", "less_than", "parameter.most", "too big", number=True),
        )),
        Step("create", "parameter.log", {"id": "parameter.logged", "text": "current.name"}),
        Step("delete", "parameter.gone", {}),
    ),
    ("log", "logged", "names", "most", "gone"), "id",
)
OWN = Action(("ids", "name"), RENAME.steps[:1], ("names", "most"))


def run(spark, rows, action, **more):
    state = [("a", {"name": "A", "owner": "u", "size": "2"}), ("b", {"name": "B", "owner": "w", "size": "30.0"}), ("c", {"owner": "u", "size": "7", "by": "x"}), ("d", None)]
    found = propose(spark.createDataFrame(rows, REQUESTS), spark.createDataFrame(state, STATE), action, **more)
    return {(r.request_id, r.step, r.object_id): r for r in found.collect()}


def test_values_expected_values_and_criteria(spark):
    got = run(spark, [(1, {"id": "u"}, {"name": "N", "most": "10"}, {"ids": ["a", "b", "c", "d"]}), (2, {"id": "u"}, {"name": "N"}, {"ids": ["a"], "names": ["M"]})], OWN)
    assert {r.problem for r in got.values()} == {None}
    one = got[1, 0, "a"]
    assert one.changes == {"name": "N", "by": "u", "kind": "fixed"} and one.expected == {"name": "A", "by": None, "kind": None} and one.failure is None
    assert got[1, 0, "c"].expected == {"name": None, "by": "x", "kind": None}
    assert [got[1, 0, k].failure for k in "bcd"] == ["not yours", "odd size", None]  # a criterion is skipped where a side is absent
    assert got[2, 0, "a"].failure == "no such name"


def test_requests_are_refused_as_a_whole(spark):
    user, full = {"id": "u"}, {"name": "N", "log": "new", "logged": "new", "gone": "b"}
    rows = [
        (1, user, full, {"ids": ["a"]}), (2, user, full | {"logged": "other"}, {"ids": ["a"]}), (3, user, full | {"log": "a", "logged": "a"}, {"ids": ["b"]}), (4, user, full | {"gone": "z"}, {"ids": ["a"]}),
        (5, user, full | {"gone": "a"}, {"ids": ["a"]}), (6, user, {"log": "new"}, None), (7, user, full | {"x": "1", "w": "2"}, {"ids": ["a"]}), (8, {}, full, {"ids": ["a"]}),
        (9, user, full, {"ids": ["a", "b", "c"]}), (10, user, {k: v for k, v in full.items() if k != "gone"}, {"ids": ["a"]}), (11, None, None, None),
    ]
    got = run(spark, rows, RENAME, ceiling=2)
    problems = {}
    for (request, *_), r in got.items():
        problems.setdefault(request, set()).add(r.problem)
    assert problems == {
        1: {None}, 2: {"id differs"}, 3: {"object exists"}, 4: {"no such object"}, 5: {"duplicate object"}, 6: {"missing ids,name"}, 7: {"unknown w,x"}, 8: {"no user attribute id"},
        9: {"too many objects"}, 10: {"no object"}, 11: {"missing ids,name"},
    }
    assert got[1, 1, "new"].changes == {"id": "new", "text": None} and got[1, 1, "new"].expected is None and got[1, 2, "b"].changes == {}


def test_no_requests(spark):
    assert not run(spark, [], RENAME)


@pytest.mark.parametrize("orders", [3, 501])
def test_several_problems_of_a_request_and_its_sql(spark, tmp_path, orders):
    """Customer 221 names orders twice and no note; 501 orders twice are too many for 13."""
    tables = {
        "region": [(2, "ASIA")], "nation": [(8, "INDIA", 2)], "customer": [(k, f"Customer#{k:09d}", 8, 1.0, "BUILDING") for k in (13, 17, 221)],
        "orders": [(1000 * k + n, k, "O", 10.0, "1-URGENT") for k in (13, 17, 221) for n in range(orders)],
    }
    kinds = {
        "region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int",
        "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string",
    }
    con = duckdb.connect()
    for name, rows in tables.items():
        df = spark.createDataFrame(rows, kinds[name])
        if name == "orders":
            df = df.selectExpr("*", "timestamp '1995-01-01 00:00:00' as o_orderdate")
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    found = catalogue.QUERIES["action_proposals"](spark, str(tmp_path))
    want = con.sql(catalogue.ORACLES["action_proposals"])
    assert sorted((tuple(r[c] for c in want.columns) for r in found.collect()), key=repr) == sorted(want.fetchall(), key=repr)
    assert {(r.request_id, r.problem) for r in found.collect()} == {(13, "duplicate object" if orders == 3 else "too many objects"), (17, "no object"), (221, "no object")}
