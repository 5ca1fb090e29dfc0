"""Duplicates are counted after rows are dealt by key and value."""

from objectlake.operators import clean


def test_values_are_counted_after_the_shuffle(spark):
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 5), (None, 1), (None, 2), (3, None), (4, None), (4, 1)], "k long, v long")
    kept, others = clean.split_duplicates(rows, ["k"], "v")
    assert {tuple(r) for r in kept.collect()} == {(1, 6), (None, 2), (3, None)} and others.count() == 6
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan
