"""Likely matches among all records, against all pairs."""

import math
import random

import pytest

from objectlake.operators import fuse

KIND = "id string, a string, b int, c string"


def all_pairs(rows, blocks, review):
    """Of every two records that agree on a block: probability, and the fields that agree."""
    out = {}
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            same = [None if u is None or v is None else u == v for u, v in zip(x[1:], y[1:], strict=True)]
            if not any(all(same["abc".index(f)] for f in block) for block in blocks):
                continue
            w = math.log(fuse.PRIOR / (1 - fuse.PRIOR)) + sum(0 if s is None else math.log(fuse.M / fuse.U) if s else math.log((1 - fuse.M) / (1 - fuse.U)) for s in same)
            p = 1 / (1 + math.exp(-w))
            if p >= review:
                out[tuple(sorted((x[0], y[0])))] = round(p, 9)
    return out


@pytest.mark.parametrize(("blocks", "review"), [([["a"]], 0.4), ([["a"], ["b"]], 0.4), ([["a"], ["b", "c"]], 0.8), ([["c"]], 0.999999)])
def test_equal_to_all_pairs(spark, blocks, review):
    rng = random.Random(4)
    rows = [(f"r{k:03d}", rng.choice(["x", "y", "z", None]), rng.choice([1, 2, 3, 4, None]), rng.choice(["p", "q", "r", "s", "t", None])) for k in range(120)]
    rows += [(f"h{k:03d}", "x", rng.randint(5, 60), f"v{k % 50}") for k in range(60)]  # a block of a third of the rows
    pairs, members = fuse.dedupe(spark.createDataFrame(rows, KIND), ["a", "b", "c"], blocks, review, block_rows=7)
    of, within = {}, {}
    for r in members.collect():
        of.setdefault(r.class_id, []).append(r.id)
        within[r.class_id] = r.probability
    found, n = {}, 0
    for r in pairs.collect():
        n += 1
        for x in of[r.left_id]:
            for y in of[r.right_id]:
                found[tuple(sorted((x, y)))] = round(r.probability, 9)
    assert n == len({(r.left_id, r.right_id) for r in pairs.collect()})  # each is produced once
    for name, ids in of.items():
        assert name == min(ids)
        if within[name] is not None:
            found |= {(x, y): round(within[name], 9) for x in ids for y in ids if x < y}
    assert found == all_pairs(rows, blocks, review)
    assert sorted(x for ids in of.values() for x in ids) == sorted(r[0] for r in rows)


def test_blocks_are_refined_to_what_a_likely_pair_needs():
    assert fuse.refined(["a", "b", "c"], [["a"], ["b"]], 0.4) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert fuse.refined(["a", "b", "c"], [["a", "b"]], 0.4) == [("a", "b")]
    assert fuse.refined(["a"], [["a"]], 0.99) == []


def test_no_records(spark):
    pairs, members = fuse.dedupe(spark.createDataFrame([], KIND), ["a", "b", "c"])
    assert pairs.count() == 0 and members.count() == 0
