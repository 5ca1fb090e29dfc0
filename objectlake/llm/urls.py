"""URL filtering: rules by host and path, and gradient-boosted trees for what no rule covers.

The trees see lexical features only (lengths, depth, digit ratio, entropy, parameter counts, suffix
statistics). They are trained on urls that a rule has labelled, on a bounded sample of them.
DataFrame functions and JVM-side trees only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objectlake.session import materialise

from .expressions import count_of, let, thinned

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled urls that the trees are fitted on, at most; chosen by hash of the url, so by no order of the table.
TRAINING_ROWS = 50_000
#: Parts of the labelled urls; a labelled url's suffix statistics come from the other parts.
FOLDS = 5
#: Labelled urls that the prior counts for in a suffix's share of blocked ones.
PRIOR_WEIGHT = 10


@dataclass(frozen=True)
class Rule:
    """verdict (allow or block) for a host, its subdomains, and paths that start with path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"),
)


def host_and_path(url: Column) -> Column:
    """struct(host, path): after the first :// up to /, ?, # or the end; then up to ?, # or the end."""
    at = F.locate("://", url)
    rest = F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.substr(url, at + 3))
    return let(rest, lambda r: F.struct(
        F.translate(F.regexp_extract(r, r"\A([^/?#]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(r, r"\A[^/?#]*([^?#]*)", 1).alias("path"),
    ))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does; block wins equal rules."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text, r.verdict != "block"))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(ordered):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits per character of a text; 0 if it is empty."""
    each = lambda t: F.array_distinct(F.split(t, ""))
    total = lambda t: F.greatest(F.length(t), F.lit(1)).cast("double")
    return let(text, lambda t: F.aggregate(
        each(t), F.lit(0.0),
        lambda acc, c: acc - F.when(c == "", 0.0).otherwise(
            let((F.length(t) - F.length(F.replace(t, c, F.lit("")))) / total(t), lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0))
        ),
    ))


FEATURES = ("url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "params", "hyphens", "host_labels", "fragment", "suffix_share", "suffix_blocked")


def lexical(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule, ruled and the features that need no statistics. A null url counts as empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return (
        pages.select("page_id", "url", host_and_path(F.col("url")).alias("_at"))
        .select("page_id", "url", "_at.host", "_at.path")
        .withColumn("_rule", matching_rule(F.col("host"), F.col("path")))
        .select(
            "page_id", "url", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("ruled"),
            F.element_at(F.split("host", r"\."), -1).alias("suffix"),
            F.length(url).cast("double").alias("url_length"),
            F.length("host").cast("double").alias("host_length"),
            F.length("path").cast("double").alias("path_length"),
            count_of(F.col("path"), "/").cast("double").alias("depth"),
            (count_of(url, "0123456789") / F.greatest(F.length(url), F.lit(1))).cast("double").alias("digit_ratio"),
            _entropy(url).alias("entropy"),
            count_of(url, "=").cast("double").alias("params"),
            count_of(url, "-_").cast("double").alias("hyphens"),
            (count_of(F.col("host"), ".") + 1).cast("double").alias("host_labels"),
            F.contains(url, F.lit("#")).cast("double").alias("fragment"),
        )
    )


def suffix_features(stats: DataFrame, n: int, prior: float) -> DataFrame:
    """suffix, fold, its share of all n rows, and the share of blocked ones among the labels of other folds.

    stats: a row (n, labelled, blocked) for each suffix and fold; fold -1 holds the rows without a label.
    """
    whole = Window.partitionBy("suffix")  # FOLDS + 1 rows at most
    others = lambda c: F.sum(c).over(whole) - F.col(c)  # noqa: E731  # fold -1 has no labels to leave out
    return stats.select(
        "suffix", "fold", (F.sum("n").over(whole) / max(n, 1)).alias("suffix_share"),
        ((others("blocked") + PRIOR_WEIGHT * prior) / (others("labelled") + PRIOR_WEIGHT)).alias("suffix_blocked"),
    )


def filter_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict (and p_block) of every page.

    A rule's verdict stands; otherwise the trees decide. If the labelled urls hold one verdict only,
    that verdict is taken, and allow if there are none. Repeated rows are judged alike. Suffix
    statistics cover all rows and every suffix; a labelled url's are out of fold, so that its own label
    does not reach its features.
    """
    fold = F.when(F.col("ruled").isNull(), -1).otherwise(F.pmod(F.xxhash64("url"), F.lit(FOLDS))).cast("int")
    seen = lexical(pages.select("page_id", "url")).withColumn("fold", fold)
    blocked = (F.col("ruled") == "block").cast("double")
    stats = materialise(
        seen.groupBy("suffix", "fold").agg(
            F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"), F.coalesce(F.sum(blocked), F.lit(0.0)).alias("blocked")
        ), "suffixes",
    )
    n, known, bad = (x or 0 for x in stats.agg(F.sum("n"), F.sum("labelled"), F.sum("blocked")).first())
    prior = (bad + 1) / (known + 2)
    full = seen.join(suffix_features(stats, n, prior), ["suffix", "fold"])
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(full)
    plain = vectors.select("page_id", "host", "path", "rule", "ruled")
    if not 0 < bad < known:
        return plain.select(
            "page_id", "host", "path", "rule",
            F.coalesce("ruled", F.lit("block" if known and bad else "allow")).alias("verdict"),
            F.lit(float(bool(known and bad))).alias("p_block"),
        )
    order = F.xxhash64("url", "page_id")
    sample = (
        thinned(vectors.filter(F.col("ruled").isNotNull()), order, int(known), TRAINING_ROWS)
        .select("features", blocked.alias("label"), F.shiftrightunsigned(order, 12).alias("_order"), "url")
        .orderBy("_order", "url").limit(TRAINING_ROWS).select("features", "label")
    )
    model = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, seed=7).fit(sample)
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(vectors).withColumn("p_block", F.round(vector_to_array("probability")[1], 6))
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "p_block",
    )
