"""Toxicity by a classifier chain.

The chain predicts one category after another and then toxicity itself. Each later linear model also
sees the earlier categories' probabilities; in training those are out-of-fold predictions, so that a
model learns how good the earlier ones are on texts they have not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objectlake.session import materialise

from .expressions import thinned, unused
from .memory import release, released

#: Labelled documents that the chain is fitted on, at most; chosen by hash of doc_id.
TRAINING_DOCS = 8_000
#: Words and beginnings of words that the models see: those that go most with the label.
VOCABULARY = 400
#: Lengths of the beginnings; they carry toxicity in languages that build long words.
STEMS = (4, 5, 6, 7)
FOLDS = 5
REJECT = 0.5
#: Documents whose terms are held at once.
BLOCK = 500
WORD = re.compile(r"[^\W\d_]+")
GAP = re.compile(r"[\W\d_]")
#: Characters whose words are listed at once.
SLICE = 1 << 20

# Words that mark a toxic document as belonging to a category.
CATEGORIES = {
    "insult": frozenset("idiot moron stupid fool dumb clown loser imbecile".split()),
    "contempt": frozenset("trash scum worthless pathetic disgusting filth vermin garbage".split()),
}
CHAIN = (*CATEGORIES, "toxic")


@dataclass(frozen=True)
class Chain:
    """The vocabulary, and weights by link of the chain: intercept, words, earlier probabilities."""

    words: tuple[str, ...]
    weights: tuple[np.ndarray, ...]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A column for each link."""
        p = np.zeros((len(x), 0))
        for w in self.weights:
            p = np.hstack([p, sigmoid(w[0] + np.hstack([x, p]) @ w[1:])[:, None]])
        return p


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def words_of(text: str) -> Iterator[list[str]]:
    """Words of a whole text, upper and lower case alike, in slices that cut no word."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + SLICE) if len(text) - at > SLICE else None
        end = gap.end() if gap else len(text)
        yield WORD.findall(text[at:end].lower())
        at = end


def terms(words: list[str]) -> Iterator[str]:
    """Words and the beginnings of longer ones."""
    yield from words
    for k in STEMS:
        yield from (w[:k] + "~" for w in words if len(w) > k)


def features(texts: list[str], vocabulary: tuple[str, ...]) -> np.ndarray:
    """log(1 + count) of each vocabulary term, and then its rate, which counts in full at one in twenty words."""
    n, place, known = len(vocabulary), {w: j for j, w in enumerate(vocabulary)}, frozenset(vocabulary)
    x = np.zeros((len(texts), 2 * n), "f4")
    for i, t in enumerate(texts):
        counted: Counter[str] = Counter()
        n_words = 0
        for words in words_of(t):
            n_words += len(words)
            counted.update(filter(known.__contains__, terms(words)))
        for w, count in counted.items():
            x[i, place[w]] = np.log1p(count)
            x[i, n + place[w]] = min(1.0, 20 * count / max(n_words, 20))
    return x


def fit_linear(x: np.ndarray, y: np.ndarray, l1: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; a constant if y is."""
    n, d = x.shape
    w, z, step_t = np.zeros(d + 1, x.dtype), np.zeros(d + 1, x.dtype), 1.0
    rate = (y.sum() + 0.5) / (n + 1)
    w[0] = z[0] = np.log(rate / (1 - rate))
    if not n:
        w[0] = -30.0  # no labels: nothing is predicted
    if not n or y.min() == y.max():
        return w
    ahead = lambda u: x @ u[1:] + u[0]
    back = lambda r: np.concatenate(([r.sum()], x.T @ r)).astype(x.dtype)
    v = np.ones(d + 1, x.dtype)
    for _ in range(20):  # the largest curvature
        v = back(ahead(v))
        v /= np.linalg.norm(v)
    step = 4 * n / np.linalg.norm(ahead(v)) ** 2
    for _ in range(rounds):
        new = (z - step * back(sigmoid(ahead(z)) - y) / n).astype(x.dtype)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * l1, 0)
        t = (1 + np.sqrt(1 + 4 * step_t**2)) / 2
        z, w, step_t = (new + (step_t - 1) / t * (new - w)).astype(x.dtype), new, t
    return w


def fit_chain(x: np.ndarray, targets: np.ndarray, folds: np.ndarray, words: tuple[str, ...]) -> Chain:
    """targets: a column for each link. The final models see all rows; what they are fed is out-of-fold."""
    fed, weights = np.zeros((len(x), 0), "f4"), []
    for link in range(targets.shape[1]):
        own, y = np.hstack([x, fed]), targets[:, link]
        weights.append(fit_linear(own, y))
        out = sigmoid(weights[-1][0] + own @ weights[-1][1:]).astype("f4")
        constant = not len(y) or y.min() == y.max()  # nothing to learn, and the same in every fold
        for k in range(FOLDS if link < targets.shape[1] - 1 and not constant else 0):
            at = folds == k
            w = fit_linear(own[~at], y[~at])
            out[at] = sigmoid(w[0] + own[at] @ w[1:])
        fed = np.hstack([fed, out[:, None]])
    return Chain(words, tuple(weights))


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """A chain from documents with labels (doc_id, toxic). Null labels are left out; of several for a document, toxic counts; of rows that share a doc_id the smallest text."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    order = F.xxhash64("doc_id")
    sample = (
        thinned(known, order, known.count(), TRAINING_DOCS).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.shiftrightunsigned(order, 12), "doc_id").limit(TRAINING_DOCS)
    )
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # One text for a label, so that rows that share a doc_id do not add to what reaches the driver.
    own = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    labelled = materialise(own.select("text", F.col("toxic").cast("int").alias("toxic")), "toxic")

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), BLOCK):
                seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
                for t, y in zip(f["text"][k : k + BLOCK], f["toxic"][k : k + BLOCK], strict=True):
                    seen[int(y > 0)].update(set(chain.from_iterable(map(terms, words_of(t)))))
                rows = [(w, seen[1][w], seen[0][w]) for w in seen[0].keys() | seen[1].keys()]
                yield pd.DataFrame(rows, columns=["word", "bad", "good"])

    n_bad, n_good = (labelled.filter(F.col("toxic") > 0).count(), labelled.filter(F.col("toxic") <= 0).count())
    lift = F.col("bad") / max(n_bad, 1) - F.col("good") / max(n_good, 1)
    spread = F.sqrt((F.col("bad") + F.col("good") + 1.0) / max(n_bad + n_good, 1))
    words = tuple(
        r["word"] for r in labelled.mapInPandas(lambda b: released(counted(b)), "word string, bad long, good long")
        .groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .filter("bad + good >= 3").orderBy(F.desc(F.abs(lift) / spread), "word").limit(VOCABULARY).collect()
    )

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole, k in ((f, k) for f in frames for k in range(0, len(f), BLOCK)):
            f = whole[k : k + BLOCK]
            own = [set(WORD.findall(t.lower())) for t in f["text"]]
            yield pd.DataFrame({
                "x": [v.tobytes() for v in features(list(f["text"]), words)],
                "y": [[int(y > 0 and bool(s & c)) for c in CATEGORIES.values()] + [int(y > 0)] for s, y in zip(own, f["toxic"], strict=True)],
                "fold": [crc32(t.encode()) % FOLDS for t in f["text"]],
            })

    rows = labelled.mapInPandas(lambda b: released(vectors(b)), "x binary, y array<int>, fold int").collect()  # TRAINING_DOCS rows at most
    x = np.frombuffer(b"".join(r["x"] for r in rows), "f4").reshape(len(rows), 2 * len(words))
    y = np.array([r["y"] for r in rows], "f4").reshape(len(rows), len(CHAIN))
    folds = np.array([r["fold"] for r in rows], int)
    del rows
    return fit_chain(x, y, folds, words)


def scored(docs: DataFrame, model: Chain, name: str) -> DataFrame:
    """docs with a struct of p_insult, p_contempt and p_toxic under a name. Null text counts as empty."""

    @F.pandas_udf(f"struct<{', '.join(f'p_{c}:double' for c in CHAIN)}>")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        own = [t or "" for t in texts]
        parts = [model.probabilities(features(own[k : k + BLOCK], model.words)) for k in range(0, len(own), BLOCK)]
        release()
        return pd.DataFrame(np.round(np.vstack([np.zeros((0, len(CHAIN))), *parts]), 6), columns=[f"p_{c}" for c in CHAIN])

    return docs.withColumn(name, predicted(F.col("text").cast("string")))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the chain's probabilities, toxic and kept (its opposite) of every document.

    Null and empty texts are judged by the intercepts. Without labels of both kinds the chain is
    constant. An empty table gives no rows; repeated rows are judged alike.
    """
    toxic = F.col("p.p_toxic") >= REJECT
    return scored(docs.select("doc_id", "text"), train(docs, labels), "p").select("doc_id", "p.*", toxic.alias("toxic"), (~toxic).alias("kept"))


def remove(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not judged toxic, with their own columns."""
    name = unused(docs, "p")
    return scored(docs, train(docs, labels), name).filter(F.col(f"{name}.p_toxic") < REJECT).drop(name)
