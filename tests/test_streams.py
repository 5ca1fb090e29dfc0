"""The keyed index and the streaming watch, batch by batch and after restarts."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from objectlake.operators import edits
from objectlake.streaming import incremental, watching

LOG = "id long, object_type string, object_id string, operation string, changes string, status string, user_id string, created_at timestamp"
START = datetime(2026, 1, 1)


def entry(k, obj, operation, minutes, status="applied"):
    return (k, "T", obj, operation, "{}", status, "u", START + timedelta(minutes=minutes))


def files(tmp_path):
    return {os.path.join(d, f) for d, _, names in os.walk(tmp_path / "index/data") for f in names if f.endswith(".parquet")}


def deleted(index):
    return sorted(r.object_id for r in index.read().filter("operation = 'delete'").collect())


def add(spark, tmp_path, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")


def catch_up(spark, tmp_path):
    index = incremental.tombstone_index(spark, f"file://{tmp_path}/index", 8)
    before = index.state()["number"]
    incremental.index_applied(incremental.stream(spark, f"file://{tmp_path}/log", LOG), index, f"file://{tmp_path}/checkpoint")
    return index, index.state()["number"] - before


def test_index_rewrites_touched_buckets_only(spark, tmp_path):
    add(spark, tmp_path, [entry(k, f"o{k}", "update", k) for k in range(100)])
    index, merges = catch_up(spark, tmp_path)
    assert merges == 1 and not deleted(index) and index.state()["merged"] == 100 and len(index.state()["buckets"]) == 8
    before, held = index.state()["buckets"], files(tmp_path)
    add(spark, tmp_path, [entry(200, "o7", "delete", 200)])
    index, merges = catch_up(spark, tmp_path)
    after = index.state()["buckets"]
    changed = [b for b in before if before[b] != after[b]]
    assert merges == 1 and deleted(index) == ["o7"] and index.state()["merged"] == 1 and len(changed) == 1
    assert held <= files(tmp_path)  # readers of the manifest before may still be at work
    assert index.read().count() == 100
    assert catch_up(spark, tmp_path)[1] == 0  # it is current


def test_late_rows_and_replayed_batches(spark, tmp_path):
    add(spark, tmp_path, [entry(1, "a", "delete", 500), entry(2, "b", "create", 500)])
    index, _ = catch_up(spark, tmp_path)
    position = index.state()["position"]
    add(spark, tmp_path, [entry(3, "a", "create", 100), entry(4, "b", "delete", 100), entry(5, "c", "delete", 100), entry(6, "c", "create", 99), entry(7, "d", "delete", 600, "pending")])
    index, _ = catch_up(spark, tmp_path)
    assert deleted(index) == ["a", "c"] and index.state()["late"] == 4 and index.state()["position"] == position
    state = index.state()
    rows = spark.createDataFrame([entry(9, "z", "delete", 900)], LOG).select("object_type", "object_id", "created_at", "id", "operation")
    assert index.merge(rows, state["batch"]) == state and deleted(index) == ["a", "c"]
    again = index.merge(rows, state["batch"] + 1)
    assert deleted(index) == ["a", "c", "z"] and again["position"] > position and again["late"] == 0


def test_index_equals_the_batch_operator(spark, tmp_path):
    rng = random.Random(20)
    rows = [entry(k, f"o{rng.randint(1, 40)}", rng.choice(["create", "update", "delete"]), rng.randint(0, 300), rng.choice(["applied", "applied", "pending"])) for k in range(240)]
    for start in range(0, 240, 60):
        add(spark, tmp_path, rows[start : start + 60])
        index, _ = catch_up(spark, tmp_path)
    assert deleted(index) == sorted(r.object_id for r in edits.tombstones(spark.createDataFrame(rows, LOG)).collect())
    assert len(os.listdir(tmp_path / "index/_state")) == 2 + sum(f.endswith(".crc") for f in os.listdir(tmp_path / "index/_state"))


def test_an_empty_index(spark, tmp_path):
    assert incremental.tombstone_index(spark, f"file://{tmp_path}/none").read().count() == 0


COUNTS = "condition string, user_id string, definition string, at timestamp, n long"


def sequential(rows, threshold):
    """By definition, sample by sample."""
    last, out = {}, []
    for condition, user, definition, at, n in sorted(rows, key=lambda r: r[3]):
        was = last.get((condition, user))
        sent = was[2] if was else None
        if was and was[0] == definition and n != was[1]:
            if threshold is None:
                text = f"gained {n - was[1]}" if n > was[1] else f"fell {was[1] - n}"
            else:
                text = None if n <= threshold else "above" if was[1] <= threshold else "still above"
            if text and text != sent:
                out.append((condition, user, at, n, text))
                sent = text
        last[condition, user] = (definition, n, sent)
    return sorted(out)


def run_watch(spark, tmp_path, parts, threshold):
    watching.keeps_state(spark)
    for rows in parts:
        spark.createDataFrame(rows, COUNTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        fired = watching.watch_stream(incremental.stream(spark, f"file://{tmp_path}/in", COUNTS), threshold)
        incremental.run_to_end(fired, f"file://{tmp_path}/checkpoint", lambda df, k: df.write.mode("overwrite").parquet(f"file://{tmp_path}/out/batch={k}"))
    return sorted(tuple(r) for r in spark.read.schema(watching.FIRED).parquet(f"file://{tmp_path}/out").select("condition", "user_id", "at", "n", "verdict").collect())


def test_watch_equals_a_sequential_one_after_restarts(spark, tmp_path):
    for threshold in (None, 4):
        rng = random.Random(5)
        rows = [(c, u, "v2" if c == "x" and k >= 14 else "v1", START + timedelta(days=k), rng.randint(0, 8)) for k in range(24) for c in "xy" for u in ("u", "w") if rng.random() < 0.9]
        parts = [[r for r in rows if a <= (r[3] - START).days < b] for a, b in ((0, 3), (3, 13), (13, 24))]
        rng.shuffle(parts[1])
        found = run_watch(spark, tmp_path / str(threshold), parts, threshold)
        assert found == sequential(rows, threshold) and len(found) > 10


def test_first_counts_and_new_definitions_say_nothing(spark, tmp_path):
    at = lambda k: START + timedelta(days=k)
    parts = [
        [("c", "u", "v1", at(0), 3), ("c", "w", "v1", at(0), 50)],
        [("c", "u", "v1", at(1), 5), ("c", "u", "v1", at(0), 900), ("c", "w", "v2", at(1), 9)],  # one comes a second time
        [("c", "u", "v1", at(2), 7), ("c", "u", "v1", at(3), 7), ("c", "w", "v2", at(2), 8), ("c", "new", "v1", at(2), 1)],
    ]
    assert run_watch(spark, tmp_path, parts, None) == [("c", "u", at(1), 5, "gained 2"), ("c", "w", at(2), 8, "fell 1")]


def test_windows_change_in_update_mode(spark, tmp_path):
    schema = "at timestamp, route string, status int"
    index = incremental.red_index(spark, f"file://{tmp_path}/index", 4)
    for rows in ([(START, "a", 200), (START, "a", 500)], [(START + timedelta(hours=3), "a", 404), (START + timedelta(days=9), "b", 200)], [(START, "a", 500), (START + timedelta(days=8), "b", 500)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        incremental.index_red(incremental.stream(spark, f"file://{tmp_path}/in", schema), index, f"file://{tmp_path}/checkpoint")
    found = index.read().select("route", "n", "errors", F.datediff("start", F.lit(START)).alias("day")).collect()
    assert sorted((r.route, r.day, r.n, r.errors) for r in found) == [("a", 0, 3, 2), ("b", 8, 1, 1), ("b", 9, 1, 0)]  # the request of nine days before came too late
