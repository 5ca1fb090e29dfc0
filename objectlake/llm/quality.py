"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document's measures. Expectation
maximisation over the counts of vote patterns (at most 3 ** rules of them, whatever the corpus)
estimates what each vote says about a document and the share of good ones; the verdict is the posterior
probability of good, not a conjunction of rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objectlake.session import materialise

from .expressions import BLANKS, call, count_of, let, text_or_empty
from .weak import estimate_outcomes

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
MIN_WORDS = 50
RULES = ("length", "word_size", "symbols", "symbol_density", "lines", "repeats", "capitals", "stops")
KEEP = 0.5


def _words(text: Column) -> Column:
    stripped = F.btrim(text, F.lit(BLANKS))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, "[ \\t-\\r]+"))


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, each word once.

    A window's hash and its place are packed into one long, so that a primitive sort brings equal
    windows together: the place takes as many low bits as the number of windows needs. Neighbours in
    that order are compared word by word, so a collision never counts as a repeat; one could hide a
    repeat only if it fell between two equal windows of the same document (below 1e-6 for 30,000 words).
    """

    def covered(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w).cast("long")))
        place = lambda x: x.bitwiseAND(call("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
        packed = F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: call("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")),
            )
        )

        def same(x: Column, y: Column) -> Column:
            i, j = place(x), place(y)
            return (
                (call("shiftright", x, bits) == call("shiftright", y, bits))
                & (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))
            )

        repeated = let(packed, lambda s: F.filter(
            s, lambda x, i: F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False))
        ))
        return let(F.sort_array(F.transform(repeated, place)), lambda at: F.aggregate(
            F.transform(at, lambda v, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), v - F.get(at, i - 1)))),
            F.lit(0), lambda total, v: total + v,
        ))

    return F.when(F.size(words) < 4, 0).otherwise(let(words, covered)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and helper counts.

    Null text has no words. Other columns of docs are not read.
    """
    text = F.col("_text")
    lines = let(F.split(text, "\n"), lambda all_: F.filter(all_, lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    return (
        docs.select("doc_id", text_or_empty().alias("_text"))
        .withColumn("_words", _words(text))
        .select(
            "doc_id",
            F.size("_words").cast("long").alias("n_words"),
            F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
            count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("_lines"),
            repeated_words(F.col("_words")).alias("n_repeat_words"),
            count_of(text, CAPITALS).cast("long").alias("n_capitals"),
            count_of(text, ".!?").cast("long").alias("n_stops"),
        )
        .withColumn("n_lines", F.col("_lines.n").cast("long"))
        .withColumn("n_dup_lines", F.col("_lines.dup").cast("long"))
        .drop("_lines")
    )


def votes() -> list[Column]:
    """One vote a rule: 1 good, -1 bad, 0 abstains. A document without words is voted bad by length only."""
    n, some = F.col("n_words"), F.col("n_words") > 0
    share = lambda c: F.col(c) / F.greatest(n, F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    size, capital = F.col("word_chars") / F.greatest(n, F.lit(1)), F.col("n_capitals") / chars
    return [
        vote(n < MIN_WORDS, n >= 2 * MIN_WORDS),
        vote(some & ((size < 2) | (size > 15)), some & size.between(3, 11)),
        vote(some & (share("n_symbols") > 0.1), some & (share("n_symbols") <= 0.02)),
        vote(F.col("n_symbols") / chars > 0.1, F.lit(False)),
        vote(F.col("n_dup_lines") > 0.3 * F.col("n_lines"), (F.col("n_lines") > 1) & (F.col("n_dup_lines") == 0)),
        vote(some & (share("n_repeat_words") > 0.5), (n >= MIN_WORDS) & (share("n_repeat_words") <= 0.1)),
        vote(some & (capital > 0.4), some & (capital <= 0.15)),
        vote(some & ((share("n_stops") > 0.8) | ((n >= MIN_WORDS) & (F.col("n_stops") == 0))), some & share("n_stops").between(0.01, 0.5)),
    ]


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, p_good and kept for every document.

    The measures are written once to the shared folder; the corpus is read once. Ties at p_good 0.5
    are kept. An empty table gives no rows.
    """
    measured = materialise(measures(docs).withColumn("_votes", F.array(*votes())), "quality")
    # Documents that fail the base rules anyway teach nothing about the others.
    counted = measured.filter(~_failed()).groupBy("_votes").count().collect()  # 3 ** len(RULES) rows at most
    prior, adds = estimate_outcomes(sorted((tuple(r["_votes"]), r["count"]) for r in counted), len(RULES))
    odds = F.lit(math.log(prior / (1 - prior)))
    for j, (against, for_) in enumerate(adds):
        odds = odds + F.when(F.col("_votes")[j] < 0, against).when(F.col("_votes")[j] > 0, for_).otherwise(0.0)
    failed = _failed()
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.round(1 / (1 + F.exp(-odds)), 6).alias("p_good"),
        (~failed & (odds >= math.log(KEEP / (1 - KEEP)))).alias("kept"),
    )
