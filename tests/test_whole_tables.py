"""Queries that must use every row of their tables."""

from objectlake import catalogue
from objectlake.operators import fuse
from objectlake.plans import identity

SF = "/root/testdata/sf0.001"


def test_writes_and_decisions_cover_whole_tables(spark):
    run = lambda name: catalogue.QUERIES[name](spark, SF).collect()
    orders = {r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()}
    customers = {r.c_custkey for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()}
    assert {r.write_id for r in run("approvals")} == orders
    assert {r.batch_id for r in run("apply_batch_status")} == {k // 4 for k in orders}
    applied = {r.batch_id for r in run("apply_batch_status") if r.status == "applied"}
    state = {k for k in orders if k % 7 or k % 5 == 0}
    want = {k for k in orders if (k in state or k // 4 in applied) and not (k % 7 and k % 8 == 5 and k // 4 in applied)}
    assert {r.object_id for r in run("apply_batch_state")} == want
    decided = run("standing_decisions")
    assert {r.proposal_id for r in decided} == customers
    assert {r.proposal_id for r in run("approved_pairs")} == {r.proposal_id for r in decided if r.decision == "approved"}


def test_columns_are_counted_by_different_values_too(spark):
    found = {r.column: r for r in catalogue.QUERIES["columns_changed"](spark, SF).collect()}
    for c, r in found.items():
        values = [x[0] for x in spark.read.parquet(f"{SF}/orders.parquet").select(c).collect() if x[0] is not None]
        assert (r.filled, r["values"], r.added) == (len(values), len(set(values)), c == "o_totalprice")
        assert (r.filled_before, r.values_before) == ((None, None) if r.added else (len(values), len(set(values))))
    assert len(found) == 4


def components(rows):
    """The smallest id of each document's component, by union-find over texts and their longer lines."""
    parent, seen = {k: k for k, _ in rows}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, text in rows:
        for part in (("text", text), *(("line", x) for x in text.split("\n") if len(x) >= 60)):
            a, b = sorted((find(k), find(seen.setdefault(part, k))))
            parent[b] = a
    return {k: find(k) for k, _ in rows}


def test_components_over_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = catalogue.QUERIES["merge_components_documents"](spark, SF).collect()
    assert {r.id: r.component for r in found} == components(rows)


def test_components_of_a_chain_and_a_hot_group(spark):
    end = lambda k: f"{k:060d}"
    rows = [(k, end(k) + end(k + 1)) for k in range(0, 1000)]  # no line in common
    rows += [(2000 + k, end(5000 + (k + 1) // 2) + f"\n{k}\n" + end(7000 + k // 2)) for k in range(600)]  # a chain by first and last lines in turn
    rows += [(4000 + k, end(9000) + f"\n{k}\n" + end(10_000 + k)) for k in range(500)]  # one line
    want = components(rows)
    assert len({want[2000 + k] for k in range(600)}) == len({want[4000 + k] for k in range(500)}) == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component for r in fuse.merge_approved(identity.document_links(docs)).collect()} == want
