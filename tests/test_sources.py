"""Sources read in parts, integrity from footers, denied ids as bitmaps, verdicts on changed types."""

import os

import pytest

from objectlake.functions.text import standardised
from objectlake.operators import changes, secure
from objectlake.sources import tables
from objectlake.sources.lake import Lake

DERBY = "org.apache.derby.jdbc.EmbeddedDriver"


def test_jdbc_is_read_in_ranges_of_the_key(spark, tmp_path):
    spark._jvm.System.setProperty("derby.stream.error.file", f"{tmp_path}/derby.log")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(0, 1000).selectExpr("id + 50 AS K", "CAST(id % 7 AS INT) AS V", "id AS W").write.jdbc(url, "T", properties={"driver": DERBY})
    rows = tables.read(spark, "jdbc", url, ["K", "V"], key="K", parts=4, dbtable="T", driver=DERBY)
    assert rows.columns == ["K", "V"] and rows.rdd.getNumPartitions() == 4
    sizes = rows.rdd.glom().map(len).collect()
    assert sum(sizes) == 1000 and min(sizes) > 200
    assert tables.read(spark, "jdbc", url, ["V"], dbtable="T", driver=DERBY).count() == 1000
    spark.range(0).selectExpr("id AS K").write.jdbc(url, "NOROWS", properties={"driver": DERBY})
    assert tables.read(spark, "jdbc", url, key="K", parts=4, dbtable="NOROWS", driver=DERBY).count() == 0


def test_integrity_from_footers(spark, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}/lake")
    with lake.together() as now:
        for name in ("a", "b", "c"):
            now.publish(name, spark.range(100).selectExpr("id AS k", "id % 3 AS v").repartition(2))
    now = lake.generation()
    assert tables.lake_findings(now, {"a": ["k", "v"], "b": ["k"]}) == []
    with tables.from_footers(spark):
        plan = tables.footer_count(now.read("a"))._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    assert "PushedAggregation" not in now.read("a").groupBy().count()._jdf.queryExecution().toString()
    broken = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "lake/b") for f in names if f.startswith("part-")][0]
    with open(broken, "r+b") as f:
        f.truncate(os.path.getsize(broken) // 2)
    os.remove(os.path.join(os.path.dirname(broken), f".{os.path.basename(broken)}.crc"))
    gone = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "lake/c") for f in names if f.startswith("part-")][0]
    os.remove(gone)
    found = tables.lake_findings(now, {"a": ["k", "w"], "b": ["k"], "c": ["k"], "d": ["k"]})
    assert found == [("a", "missing column w", 100), ("b", "unreadable", None), ("c", "other rows than published", 50), ("d", "declared but missing", None)]


@pytest.mark.parametrize("ids", [[], [0], [0, 7, 8, 32_767, 32_768, 100_000]])
def test_bitmaps_give_denied_ids_back(spark, ids):
    rows = [(k, "x") for k in ids] + [(k + 1_000_000, "mine") for k in ids] + [(k + 5, None) for k in ids[:1]]
    made = secure.denied_bitmaps(spark.createDataFrame(rows, f"k long, {secure.BOUNDARY} string"), "k", "mine")
    assert sorted((r.boundary, r.id) for r in secure.denied_ids(made).filter("boundary is not null").collect()) == [("x", k) for k in ids]
    assert sorted(r.id for r in secure.denied_ids(made).filter("boundary is null").collect()) == [k + 5 for k in ids[:1]]
    assert sum(r.n for r in made.collect()) == len(ids) + len(ids[:1])


def test_verdicts_and_misfits(spark):
    found = spark.createDataFrame([("a", "integer", 0), ("b", "date", 2)], "column string, data_type string, misfits long")
    assert {r.column: r.verdict for r in changes.type_change_verdicts(found).collect()} == {"a": "absorbed", "b": "refused"}
    kinds = lambda *x: spark.createDataFrame(list(x), "column string, type string")
    drifted = changes.type_drift(kinds(("a", "int"), ("b", "int")), kinds(("a", "bigint"), ("b", "string")))
    rows = spark.createDataFrame([(1, "7"), (1 << 40, "x"), (None, None)], "a long, b string")
    assert sorted((r.column, r.verdict, r.misfits) for r in changes.misfits_of_old_types(drifted, rows).collect()) == [("a", "widened", 1), ("b", "CHANGED", 1)]
    assert changes.misfits_of_old_types(drifted.limit(0), rows).count() == 0


def test_only_texts_beyond_ascii_pass_through_python(spark):
    rows = [(1, " a\t b ", None), (2, "e\u0301", "x  y"), (3, None, " \r\n z"), (4, None, None), (5, "n", "o\u0308 ")]
    made = standardised(spark.createDataFrame(rows, "k int, a string, b string"), ["a", "b"])
    assert sorted(map(tuple, made.collect()), key=lambda r: r[0]) == [(1, "a b", None), (2, "\u00e9", "x y"), (3, None, "z"), (4, None, None), (5, "n", "\u00f6")]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") >= 1 and made.filter("k = 1").count() == 1
    assert standardised(made, []).columns == ["k", "a", "b"]
