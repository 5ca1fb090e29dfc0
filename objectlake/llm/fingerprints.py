"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its words in lower case, weighted by how often they occur. Sample j of a text is
the term that minimises ``ln c - r (t - beta + 1)`` where ``t = floor(ln w / r + beta)``; r and c are
Gamma(2, 1) and beta is uniform, all drawn from hashes of the term and j. Two texts share sample j
with the probability of their generalised Jaccard similarity (sum of smaller weights by sum of larger
ones), so the share of equal samples estimates it.

The draws come as sums of exponentials: with a, e1 and e2 exponential, ``c = a + e1``, ``v = ln(c / a)``
is exponential too, ``r = v + e2`` and ``beta = e2 / r``. Then the value to minimise is ``ln a - r t``,
and ``t = 0`` for weight 1, so a term that occurs once needs one hash and no logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objectlake.session import discard, materialise

from .rows import LOWEST, keyed

SAMPLES = 64
#: Just below 2 ** 63, so that every share of it is a long.
WHOLE = 9.22337203685477e18
#: Rows that one range of documents is meant to hold while each document's successor is looked up.
RANGE_ROWS = 20_000
ROW = ["doc", "sub"]


def drawn(weighed: DataFrame) -> DataFrame:
    """doc, sub, own, edited and _draws: a long for each sample of _term that occurs _n times; the smallest of a text's terms is its sample.

    The long names term and t: for t = 0 it is the term's hash as it stands, else
    ``1 - exp(-a exp(-r t))`` on the same scale. Logarithms are only taken for _n > 1, each once: a, e1 and v
    are columns, as within one expression they would be computed again wherever they occur. They are arrays, one
    a row and null for _n = 1: a column for each sample would make rows of some 200 columns, mostly empty.
    """
    h, g = (lambda j: f"xxhash64(_term, {j})"), (lambda j: f"xxhash64(_term, {SAMPLES + j})")
    exponential = lambda bits: f"-ln(({bits} + 0.5D) / {float(1 << 32):.1f}D)"
    a = lambda j: f"-ln(({(1 << 52) - 1} - shiftrightunsigned({h(j)}, 12) + 0.5D) / {float(1 << 52):.1f}D)"
    e1, e2 = (lambda j: exponential(f"({g(j)} & 4294967295)")), (lambda j: exponential(f"shiftrightunsigned({g(j)}, 32)"))
    each = lambda sample: f"array({', '.join(map(sample, range(SAMPLES)))})"
    several = lambda sample, name: F.expr(f"CASE WHEN _n > 1 THEN {each(sample)} END").alias(name)

    def moved(j: int) -> str:
        r = f"(_v[{j}] + _e2[{j}])"
        return f"CASE WHEN _v[{j}] IS NULL THEN shiftrightunsigned({h(j)}, 1) ELSE CAST(-expm1(-(_a[{j}] * exp(-{r} * (floor((_ln - _v[{j}]) / {r}) + 1)))) * {WHOLE}D AS BIGINT) END"

    # A lambda keeps each projection out of whole-stage code: its many draws in one method would be
    # too long for the JIT, while a plain projection splits them into short methods.
    apart = F.transform(F.array("own"), lambda x: x)[0].alias("own")
    kept = [*ROW, "_term", "_n", apart, "edited"]
    drawn_a = weighed.select(*kept, several(a, "_a"), several(e1, "_e1"), several(e2, "_e2"))
    moving = drawn_a.select(*kept, "_a", "_e2", F.expr("CASE WHEN _n > 1 THEN ln(_n) END AS _ln"), several(
        lambda j: f"CASE WHEN NOT (_n - 1) * _a[{j}] < _e1[{j}] THEN ln(_e1[{j}] / _a[{j}] + 1) END", "_v"
    ))
    alone = each(lambda j: f"shiftrightunsigned({h(j)}, 1)")
    return moving.select(*ROW, apart, "edited", F.expr(f"CASE WHEN _n > 1 THEN {each(moved)} ELSE {alone} END AS _draws"))


def signatures(parts: DataFrame) -> DataFrame:
    """doc, sub and the samples (arrays of int) of the own and of the edited text, null for a text without words.

    parts: doc, sub and words, three arrays: what both texts share, what the own text alone has, and
    what the edited one alone has. A term that weighs as much in both texts is drawn once. Rows are
    grouped where they lie if parts is already partitioned by doc and sub.
    """
    words = parts.select(*ROW, F.posexplode("words").alias("_part", "_words")).select(*ROW, "_part", F.explode("_words").alias("_word"))
    of = lambda k: F.count(F.when(F.col("_part") == k, 1))
    counted = (
        words.filter("_word <> ''").groupBy(*ROW, F.xxhash64(F.lower("_word")).alias("_term"))
        .agg(of(0).alias("_both"), of(1).alias("_own"), of(2).alias("_edited"))
        .select(*ROW, "_term", (F.col("_both") + F.col("_own")).alias("_own"), (F.col("_both") + F.col("_edited")).alias("_edited"))
    )
    one = lambda n, own, edited: F.struct(n.alias("n"), F.lit(own).alias("own"), F.lit(edited).alias("edited"))
    weighed = counted.select(*ROW, "_term", F.explode(
        F.when(F.col("_own") == F.col("_edited"), F.array(one(F.col("_own"), True, True)))
        .otherwise(F.array(one(F.col("_own"), True, False), one(F.col("_edited"), False, True)))
    ).alias("_w")).filter("_w.n > 0").select(*ROW, "_term", F.col("_w.n").cast("double").alias("_n"), "_w.own", "_w.edited")
    # Most terms bear on both texts alike, so each row meets one set of minima; three rows for each text are left.
    least = drawn(weighed).groupBy(*ROW, "own", "edited").agg(*[F.expr(f"min(_draws[{j}]) AS _{j}") for j in range(SAMPLES)]).groupBy(*ROW).agg(
        *[F.expr(f"min(CASE WHEN {side} THEN _{j} END) AS _{side}_{j}") for side in ("own", "edited") for j in range(SAMPLES)]
    )
    folded = lambda c: f"CAST(shiftright(shiftleft({c} ^ shiftright({c}, 32), 32), 32) AS INT)"
    return least.select(*ROW, *[
        F.expr(f"CASE WHEN _{side}_0 IS NOT NULL THEN array({', '.join(folded(f'_{side}_{j}') for j in range(SAMPLES))}) END AS {side}") for side in ("own", "edited")
    ])


def successors(ids: DataFrame, n_rows: int) -> DataFrame:
    """Rows of doc, sub and n_chars, with next_doc and next_sub: the next row by doc and sub, the first after the last.

    Rows are ranged, so that each task orders one range; only each range's first row is put in line.
    """
    n = max(1, n_rows // RANGE_ROWS)
    ranged = materialise(ids.repartitionByRange(n, *ROW).withColumn("_range", F.spark_partition_id()), "ranges")
    line = Window.orderBy("_range")  # a row for each range
    firsts = ranged.groupBy("_range").agg(F.min(F.struct(*ROW)).alias("_first"))
    after = firsts.select("_range", F.coalesce(F.lead("_first").over(line), F.min("_first").over(Window.partitionBy())).alias("_after"))
    own = Window.partitionBy("_range").orderBy(*ROW)
    return ranged.join(after, "_range").withColumn("_next", F.coalesce(F.lead(F.struct(*ROW)).over(own), F.col("_after"))).select(
        *ROW, "n_chars", F.col("_next.doc").alias("next_doc"), F.col("_next.sub").alias("next_sub")
    )


def edited_texts(texts: DataFrame, follow: DataFrame) -> DataFrame:
    """doc, sub, next_doc, next_sub, text, cut and _head: text up to cut and then _head is the edited text.

    Both joins read the same exchange of the texts.
    """
    asked = follow.select(
        F.col("doc").alias("_doc"), F.col("sub").alias("_sub"), F.col("next_doc").alias("doc"), F.col("next_sub").alias("sub"), F.floor(F.col("n_chars") / 4).cast("int").alias("_q")
    )
    heads = texts.join(asked, ROW).select(
        F.col("_doc").alias("doc"), F.col("_sub").alias("sub"), F.substring("text", F.lit(1), F.col("_q")).alias("_head"), F.col("doc").alias("next_doc"), F.col("sub").alias("next_sub")
    )
    n = F.length("text")
    return texts.join(heads, ROW).select(*ROW, "next_doc", "next_sub", "text", (n - F.floor(n / 4)).cast("int").alias("cut"), "_head")


def word_parts(cut: DataFrame) -> DataFrame:
    """doc, sub and words: those before the cut, those after it, those of the head put in instead.

    A word that the cut goes through belongs to the last two, as far as it stands before the cut.
    """
    split = lambda text: F.split(text, "[ \\t-\\r]+")
    kept = cut.select(*ROW, "text", "cut", "_head", split(F.substring("text", F.lit(1), F.col("cut"))).alias("_kept"))
    broken = F.element_at("_kept", -1)
    return kept.select(*ROW, F.array(
        F.slice("_kept", F.lit(1), F.size("_kept") - 1),
        split(F.concat(broken, F.substr("text", F.col("cut") + 1))), split(F.concat(broken, F.col("_head"))),
    ).alias("words"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two texts without words are alike, one without is unlike any other."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(SAMPLES))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def as_string(samples: Column) -> Column:
    """Eight hex digits a sample; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), ""), F.lit(""))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc, sub, next_doc, next_sub, n_chars, edited_sha256, own and edited samples of every row, written out once."""
    rows, doc, sub = keyed(docs.select("doc_id", "text"))
    texts = rows.select(F.col(doc).alias("doc"), F.col(sub).alias("sub"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = materialise(texts.select(*ROW, F.length("text").cast("long").alias("n_chars")), "ids")
    follow = materialise(successors(ids, ids.count()), "successors")
    cut = edited_texts(texts, follow)
    digests = cut.select(
        *ROW, "next_doc", "next_sub", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.concat(F.substring("text", F.lit(1), F.col("cut")), F.col("_head")), 256).alias("edited_sha256"),
    )
    out = materialise(digests.join(signatures(word_parts(cut)), ROW, "left"), "fingerprints")
    discard(ids, follow)
    return out


def compare(docs: DataFrame) -> DataFrame:
    """The fingerprint of every document and of its edited text, and how alike they and the next one's are.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row for
    every row of docs. Null text is empty; a null doc_id comes first. Rows that share a doc_id follow
    each other in the order of a hash of their texts. A very long text is split into words in one task and
    grouped like any other. An empty table gives no rows; further columns are not read.
    """
    found = fingerprints(docs)
    after = found.select(F.col("doc").alias("next_doc"), F.col("sub").alias("next_sub"), F.col("own").alias("of_next"))
    return found.join(after, ["next_doc", "next_sub"]).select(
        F.when(F.col("doc") != LOWEST, F.col("doc")).alias("doc_id"), "n_chars", "edited_sha256",
        as_string(F.col("own")).alias("fingerprint"), as_string(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("of_next")).alias("near_next"),
    )
