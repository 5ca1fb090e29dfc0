"""Batches of writes in their order, against a sequential version."""

import random

import pytest

from objectlake.operators import edits

STATE = "object_id long, fields map<string,string>"
WRITES = "batch_id long, seq int, object_id long, operation string, expected map<string,string>, changes map<string,string>"


def sequential(state, writes):
    now, status = {k: dict(v or {}) for k, v in state}, {}
    for batch in sorted({w[0] for w in writes}):
        trial = {k: dict(v) for k, v in now.items()}
        ok = True
        for _, _, k, operation, expected, changes in sorted((w for w in writes if w[0] == batch), key=lambda w: w[1]):
            if operation == "create":
                ok &= k not in trial
                trial[k] = dict(changes or {})
            else:
                ok &= k in trial and all(trial[k].get(f) == v for f, v in (expected or {}).items())
                if operation == "delete":
                    trial.pop(k, None)
                else:
                    trial.setdefault(k, {}).update(changes or {})
        status[batch] = "applied" if ok else "abandoned"
        now = trial if ok else now
    return now, status


def check(spark, state, writes, **more):
    new, status = edits.apply_in_order(spark.createDataFrame(state, STATE), spark.createDataFrame(writes, WRITES), **more)
    got = {r.object_id: r.fields for r in new.collect()}, {r.batch_id: r.status for r in status.collect()}
    assert got == sequential(state, writes)
    assert new.count() == len(got[0]) and status.count() == len(got[1])
    return got


def v(x):
    return {"v": x}


def test_a_stale_batch_does_not_keep_the_next_from_its_object(spark):
    got = check(spark, [(1, v("a"))], [(1, 0, 1, "update", v("stale"), v("b")), (2, 0, 1, "update", v("a"), v("c"))])
    assert got == ({1: v("c")}, {1: "abandoned", 2: "applied"})


def test_a_batch_builds_on_an_earlier_ones_value(spark):
    got = check(spark, [(1, v("a"))], [(1, 0, 1, "update", v("a"), v("b")), (2, 0, 1, "update", v("b"), {"w": None})])
    assert got == ({1: {"v": "b", "w": None}}, {1: "applied", 2: "applied"})


def test_a_batch_creates_and_then_updates(spark):
    writes = [(1, 0, 5, "create", None, v("a")), (1, 1, 5, "update", v("a"), v("b")), (2, 0, 5, "create", None, v("x")), (3, 0, 5, "delete", v("b"), None), (4, 0, 5, "create", None, v("y"))]
    got = check(spark, [(1, None)], writes)
    assert got == ({1: {}, 5: v("y")}, {1: "applied", 2: "abandoned", 3: "applied", 4: "applied"})


def test_of_two_writers_one_wins_on_every_object(spark):
    state = [(1, v("500")), (2, v("500"))]
    got = check(spark, state, [(k, n, o, "update", v("500"), v(x)) for k in (1, 2) for n, (o, x) in enumerate([(1, f"{k}00"), (2, "600")])])
    assert got == ({1: v("100"), 2: v("600")}, {1: "applied", 2: "abandoned"})


@pytest.mark.parametrize(("seed", "run"), [(1, 256), (2, 3)])
def test_random_batches_that_overlap(spark, seed, run):
    rng = random.Random(seed)
    state = [(k, {"v": rng.choice("ab"), "w": None}) for k in range(0, 30, 2)]
    writes = []
    for batch in range(160):
        objects = [7] if batch % 3 == 0 else rng.sample(range(30), rng.choice([1, 1, 2, 3]))  # one object is in a third of all batches
        for seq in range(len(objects) + rng.choice([0, 0, 1])):
            operation = rng.choice(["create", "update", "update", "update", "delete"])
            expected = rng.choice([None, {}, {"v": rng.choice("ab")}, {"v": rng.choice("ab"), "w": None}])
            writes.append((batch, seq, rng.choice(objects), operation, None if operation == "create" else expected, rng.choice([{"v": rng.choice("ab")}, {"v": rng.choice("ab"), "w": rng.choice(["x", None])}])))
    now, status = check(spark, state, writes, run=run)
    assert 20 < sum(s == "applied" for s in status.values()) < 140


def test_nothing_to_apply_and_writes_without_keys(spark):
    got = check(spark, [(1, v("a"))], [])
    assert got == ({1: v("a")}, {})
    new, status = edits.apply_in_order(spark.createDataFrame([], STATE), spark.createDataFrame([(None, 0, 1, "create", None, v("a")), (1, 0, None, "create", None, v("a"))], WRITES))
    assert not new.collect() and not status.collect()


def test_rounds_are_found_over_ids_alone(spark):
    """Batch 2 waits for 1 on object 2, batches 3 and 4 touch object 9 alone, and 5 waits for all."""
    touches = [(1, 1), (1, 2), (2, 2), (2, 3), (3, 9), (4, 9), (5, 3), (5, 9)]
    due = edits._rounds(spark.createDataFrame(touches, "batch_id long, object_id long"), 256)
    assert [sorted({r.batch_id for r in d.collect()}) for d in due] == [[1, 3, 4], [2], [5]]
    assert set(due[0].columns) == {"batch_id", "object_id", "width", "place", "round"}
