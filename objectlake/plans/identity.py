"""Queries over fusion, identity resolution and survivorship."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fuse
from .bindings import ONTOLOGY, SOURCES_SQL, customer_sources, table
from .registry import Registry

R = Registry()
FIELDS = ["c_name", "c_nationkey", "c_acctbal"]


@R.add("conform", "SELECT doc_id, text AS body, lang, CAST(NULL AS VARCHAR) AS title, 'documents' AS _source_table FROM documents")
def conform(spark, sf_dir) -> DataFrame:
    rows = ONTOLOGY.types["Document"].conform(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("text").alias("body"), "lang", F.lit(None).cast("string").alias("title"), F.lit("documents").alias("_source_table"))


@R.add("fuse_storages", """SELECT COALESCE(CAST(d.doc_id AS VARCHAR), CAST(l.doc_id AS VARCHAR)) AS object_id, lang, quality, toxic,
CASE WHEN d.doc_id IS NULL THEN 'labels' WHEN l.doc_id IS NULL THEN 'documents' ELSE 'documents,labels' END AS _fused_from
FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN doc_id + 1000000000000 ELSE doc_id END AS doc_id, lang FROM documents) d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def fuse_storages(spark, sf_dir) -> DataFrame:
    """Every tenth document has an id that labels do not know, so that either storage has objects of its own."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(F.when(k % 10 == 0, k + 1_000_000_000_000).otherwise(k).alias("doc_id"), "lang")
    return fuse.fuse({"documents": (docs, "doc_id"), "labels": (table(spark, sf_dir, "labels"), "doc_id")})


def _resolved(spark, sf_dir, security: str | None = None) -> DataFrame:
    return fuse.resolve(fuse.sourced(customer_sources(spark, sf_dir), FIELDS), ["c_name"], security)


ENTITIES_SQL = f"WITH {SOURCES_SQL}, e AS (SELECT *, substr(c_name, 10) AS tail, CAST(CAST(substr(c_name, 10) AS BIGINT) AS VARCHAR) AS entity_id FROM both_sources)"


@R.add("identity_exact", f"{ENTITIES_SQL} SELECT source, source_id, entity_id FROM e")
def identity_exact(spark, sf_dir) -> DataFrame:
    return _resolved(spark, sf_dir).select("source", "source_id", "entity_id")


@R.add("identity_security_refused", f"""{ENTITIES_SQL}, r AS (SELECT c_name FROM e GROUP BY 1 HAVING MIN(c_nationkey) <> MAX(c_nationkey))
SELECT source, source_id, CASE WHEN c_name IN (SELECT c_name FROM r) THEN (CASE WHEN rank = 0 THEN source_id ELSE source || ':' || source_id END) ELSE entity_id END AS entity_id, c_name IN (SELECT c_name FROM r) AS refused FROM e""")
def identity_security_refused(spark, sf_dir) -> DataFrame:
    return _resolved(spark, sf_dir, "c_nationkey").select("source", "source_id", "entity_id", "refused")


@R.add("identity_equal_texts", """SELECT doc_id, CAST(MIN(doc_id) OVER (PARTITION BY text) AS VARCHAR) AS entity_id FROM documents WHERE trim(text) <> ''""")
def identity_equal_texts(spark, sf_dir) -> DataFrame:
    """Documents that agree on their text, resolved as one source; ids padded, so that text order is id order."""
    docs = table(spark, sf_dir, "documents").filter(F.trim("text") != "").select(F.format_string("%012d", "doc_id").alias("id"), "text")
    found = fuse.resolve(fuse.sourced({"documents": (docs, "id")}, ["text"]), ["text"])
    return found.select(F.col("source_id").cast("long").alias("doc_id"), F.col("entity_id").cast("long").cast("string").alias("entity_id"))


@R.add("merged_count", "SELECT CAST(COUNT(*) AS BIGINT) AS n FROM customer WHERE c_custkey % 3 <> 0")
def merged_count(spark, sf_dir) -> DataFrame:
    return fuse.merged_count(_resolved(spark, sf_dir))


ORDER = {"c_acctbal": ["crm", "erp"]}


@R.add("survivorship", """SELECT CAST(c_custkey AS VARCHAR) AS entity_id, c_name, c_nationkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
CASE WHEN c_custkey % 3 <> 0 THEN 'crm' ELSE 'erp' END AS c_acctbal_source FROM customer""")
def survivorship(spark, sf_dir) -> DataFrame:
    return fuse.survivors(_resolved(spark, sf_dir), FIELDS, ORDER).select("entity_id", "c_name", "c_nationkey", "c_acctbal", "c_acctbal_source")


@R.add("property_conflicts", """SELECT CAST(c_custkey AS VARCHAR) AS entity_id, 'c_nationkey' AS field, CAST(c_nationkey AS VARCHAR) AS chosen, 'erp' AS chosen_source, CAST((c_nationkey + 1) % 25 AS VARCHAR) AS losing, 'crm' AS losing_source
FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 50 = 0""")
def property_conflicts(spark, sf_dir) -> DataFrame:
    resolved = _resolved(spark, sf_dir)
    fields = ["c_name", "c_nationkey"]
    return fuse.conflicts(resolved, fuse.survivors(resolved, fields, ORDER), fields)


@R.add("security_conflicts", f"{ENTITIES_SQL} SELECT c_name, CAST(COUNT(*) AS BIGINT) AS members FROM e GROUP BY 1 HAVING MIN(c_nationkey) <> MAX(c_nationkey)")
def security_conflicts(spark, sf_dir) -> DataFrame:
    return _resolved(spark, sf_dir, "c_nationkey").filter("refused").groupBy("c_name").agg(F.count(F.lit(1)).alias("members"))


@R.add("merge_components", """WITH RECURSIVE pairs AS (SELECT o_orderkey AS a, o_orderkey // 3 * 3 AS b FROM orders UNION SELECT o_orderkey, o_orderkey + 40 FROM orders WHERE o_orderkey % 400 < 160),
e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS id, a AS m FROM e UNION SELECT e.b, r.m FROM reach r JOIN e ON e.a = r.id)
SELECT id, MIN(m) AS component FROM reach GROUP BY 1""")
def merge_components(spark, sf_dir) -> DataFrame:
    """Every order is linked to one of its three, and some in chains of steps of 40."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    pairs = orders.select(k.alias("a"), (F.floor(k / 3) * 3).alias("b")).union(orders.filter(k % 400 < 160).select(k, k + 40)).distinct()
    return fuse.merge_approved(pairs)


def document_links(docs: DataFrame) -> DataFrame:
    """(a, b): every document and the first of those that share a line of at least 60 characters with it, or its whole text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) >= 60)
    keys = docs.select("doc_id", F.explode(F.array_distinct(F.concat(F.array(F.sha2(text, 256)), F.transform(lines, lambda x: F.sha2(F.concat(x, F.lit("\n")), 256))))).alias("key"))
    first = keys.groupBy("key").agg(F.min("doc_id").alias("b"))
    return keys.join(first, "key").select(F.col("doc_id").alias("a"), "b").distinct()


@R.add("merge_components_documents")
def merge_components_documents(spark, sf_dir) -> DataFrame:
    """Components over all documents; no SQL, as a recursive query is too slow for large ones."""
    return fuse.merge_approved(document_links(table(spark, sf_dir, "documents")))


@R.add("match_candidates", f"""WITH {SOURCES_SQL} SELECT a.source_id AS left_id, b.source_id AS right_id, CASE WHEN a.c_nationkey = b.c_nationkey AND a.c_acctbal = b.c_acctbal THEN 'propose' ELSE 'review' END AS disposition,
CASE WHEN a.c_nationkey = b.c_nationkey AND a.c_acctbal = b.c_acctbal THEN 0.9986 ELSE 0.4502 END AS probability
FROM erp a JOIN crm b ON a.c_name = b.c_name WHERE a.c_nationkey = b.c_nationkey OR a.c_acctbal = b.c_acctbal""")
def match_candidates(spark, sf_dir) -> DataFrame:
    """Three compared fields: all agree 0.9986, two of three 0.4502; the review threshold is set below that."""
    s = customer_sources(spark, sf_dir)
    found = fuse.candidates(s["erp"][0], s["crm"][0], FIELDS, [["c_name"]], review=0.4)
    return found.select("left_id", "right_id", "disposition", F.round("probability", 4).cast("decimal(5,4)").cast("double").alias("probability"))


R.sql["match_candidates"] = R.sql["match_candidates"].replace("0.9986 ELSE 0.4502 END", "CAST(0.9986 AS DOUBLE) ELSE CAST(0.4502 AS DOUBLE) END")


#: Records of both sources as classes of equal ones, the balance in cents; blocks by name and by nation.
RECORDS_SQL = f"""{SOURCES_SQL}, r AS (SELECT source || ':' || source_id AS id, c_name, c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM both_sources),
k AS (SELECT MIN(id) AS class_id, c_name, c_nationkey, cents, COUNT(*) AS n FROM r GROUP BY ALL)"""


def _deduped(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = fuse.sourced(customer_sources(spark, sf_dir), FIELDS)
    records = rows.select(F.concat_ws(":", "source", "source_id").alias("id"), "c_name", "c_nationkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    return fuse.dedupe(records, ["c_name", "c_nationkey", "cents"], [["c_name"], ["c_nationkey"]], review=0.4)


@R.add("dedupe_pairs", f"""WITH {RECORDS_SQL} SELECT a.class_id AS left_id, b.class_id AS right_id, concat_ws(',', CASE WHEN a.c_name = b.c_name THEN 'c_name' END, CASE WHEN a.c_nationkey = b.c_nationkey THEN 'c_nationkey' END, CASE WHEN a.cents = b.cents THEN 'cents' END) AS agreeing
FROM k a JOIN k b ON a.class_id < b.class_id AND (a.c_name = b.c_name)::INT + (a.c_nationkey = b.c_nationkey)::INT + (a.cents = b.cents)::INT >= 2""")
def dedupe_pairs(spark, sf_dir) -> DataFrame:
    """Within and across both sources: two of three fields agree."""
    return _deduped(spark, sf_dir)[0].select("left_id", "right_id", "agreeing")


@R.add("dedupe_members", f"WITH {RECORDS_SQL} SELECT id, class_id, CASE WHEN n > 1 THEN 'propose' END AS disposition FROM r JOIN k USING (c_name, c_nationkey, cents)")
def dedupe_members(spark, sf_dir) -> DataFrame:
    return _deduped(spark, sf_dir)[1].select("id", "class_id", "disposition")


@R.add("new_proposals", "SELECT DISTINCT LEAST(CAST(c_custkey AS VARCHAR), 'crm-' || c_custkey) AS left_id, GREATEST(CAST(c_custkey AS VARCHAR), 'crm-' || c_custkey) AS right_id FROM customer WHERE c_custkey % 2 = 0")
def new_proposals(spark, sf_dir) -> DataFrame:
    """Every customer is found twice; every second pair has been proposed before."""
    c = table(spark, sf_dir, "customer")
    pair = lambda df: df.select(F.concat(F.lit("crm-"), "c_custkey").alias("left_id"), F.col("c_custkey").cast("string").alias("right_id"))
    return fuse.propose(pair(c).union(pair(c)), pair(c.filter("c_custkey % 2 = 1")))


def _standing(spark, sf_dir) -> DataFrame:
    """A proposal for every customer; an event decides its user's."""
    decisions = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("proposal_id"), F.when(F.col("event_id") % 3 == 0, "approved").when(F.col("event_id") % 3 == 1, "rejected").otherwise("pending").alias("decision"),
        F.col("ts").alias("decided_at"), F.col("event_id").alias("decision_id"),
    )
    return fuse.standing(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("proposal_id")), decisions)


STANDING_SQL = """WITH n AS (SELECT user_id AS proposal_id, arg_max(CASE event_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END, (ts, event_id)) AS decision FROM events GROUP BY 1)
SELECT c_custkey AS proposal_id, COALESCE(decision, 'pending') AS decision FROM customer LEFT JOIN n ON c_custkey = proposal_id"""


@R.add("standing_decisions", STANDING_SQL)
def standing_decisions(spark, sf_dir) -> DataFrame:
    return _standing(spark, sf_dir)


@R.add("approved_pairs", f"SELECT proposal_id FROM ({STANDING_SQL}) s WHERE decision = 'approved'")
def approved_pairs(spark, sf_dir) -> DataFrame:
    return _standing(spark, sf_dir).filter("decision = 'approved'").select("proposal_id")
