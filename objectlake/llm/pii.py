"""Personal data by weak supervision.

Strict patterns give the base spans, which always stay. Wider patterns give further candidates.
Regex, gazetteer and context labelers vote on every candidate; expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is for each kind; the posteriors are the
soft labels of a logistic span classifier, fitted on a bounded sample of candidates. The classifier
decides on the wider candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objectlake.session import materialise

from . import weak
from .expressions import thinned
from .memory import released

KINDS = ("email", "ip", "card", "phone")
#: Candidates that the classifier is fitted on, at most; chosen by a hash, in no order of the table.
TRAINING_SPANS = 20_000
#: Probability from which a wider candidate is taken.
ACCEPT = 0.9

# The contract's patterns, in forms that read each character a bounded number of times.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Wider candidates.
WIDE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]{1,63}){1,8}")
WIDE_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])00[1-9][0-9 ().-]{8,20}[0-9]")
WIDE_IP = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")
ANY = re.compile(r"[0-9@]|[\[(](?:at|AT)[\])]")

# Gazetteers and context words.
TOP_LEVELS = frozenset("com org net edu gov info io co uk de fr es it nl eu us ca au jp ch se no fi pl br in".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "64", "65", "81", "82", "86", "90", "91", "351", "353", "358", "420", "971")
CARD_ISSUERS = ("34", "35", "36", "37", "38", "4", "50", "51", "52", "53", "54", "55", "60", "62", "64", "65")
FOR_IT = {
    "email": ("mail", "contact", "write", "address", "reach"), "ip": ("ip", "host", "server", "address", "login", "from"),
    "card": ("card", "visa", "credit", "debit", "amex", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax", "contact", "whatsapp"),
}
AGAINST = ("version", "isbn", "issn", "order", "serial", "invoice", "sku", "doi", "token", "hash", "section", "chapter")
LABELERS = ("strict", "structure", "gazetteer", "context", "counter_context", "embedding")
N_FEATURES = 4 * (len(LABELERS) + 1) + 6 + 32


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches: each @ with the run of local characters before it, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strict patterns, in order."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def wide_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of further candidates, none overlapping a base span or an earlier candidate."""
    found = [(m.start(), k, m.end()) for k, p in ((0, WIDE_EMAIL), (1, WIDE_IP), (3, WIDE_PHONE)) for m in p.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(_digits(m[0])) <= 19]
    out, taken, at = [], sorted((s, e) for s, _, e in base), 0
    end = 0
    for s, k, e in sorted(found):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if s >= end and (at == len(taken) or taken[at][0] >= e):
            out.append((s, k, e))
            end = e
    return out


def votes(text: str, start: int, kind: int, end: int, strict: bool) -> list[int]:
    """One vote a labeler: 1 personal, -1 not, 0 abstains."""
    span, name = text[start:end], KINDS[kind]
    digits, before = _digits(span), text[max(0, start - 40) : start].lower()
    if name == "email":
        top = re.split(r"[.\])]", span)[-1].strip().lower()
        structure, gazetteer = (1 if 2 <= len(top) <= 10 and top.isalpha() else -1), (1 if top in TOP_LEVELS else 0)
    elif name == "ip":
        parts = span.split(".")
        four = len(parts) == 4 and all(p.isdigit() and len(p) < 4 for p in parts)
        structure = 1 if not four or max(map(int, parts)) <= 255 else -1
        gazetteer = (-1 if int(parts[0]) in (0, 127) or int(parts[0]) > 254 else 1) if four else 0
    elif name == "card":
        structure, gazetteer = (1 if luhn(digits) else -1), (1 if digits.startswith(CARD_ISSUERS) else -1)
    else:
        structure = 1 if 10 <= len(digits) <= 15 else -1
        code = digits[2:] if digits.startswith("00") else digits
        gazetteer = 1 if span[0] != "+" and digits[0] not in "01" or code.startswith(CALLING_CODES) else -1
    edge = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return [
        int(strict), structure, gazetteer,
        int(any(w in before for w in FOR_IT[name])), -int(any(w in before for w in AGAINST)), -1 if edge else 0,
    ]


def features(text: str, start: int, kind: int, end: int, cast: list[int]) -> list[float]:
    """Votes by kind, shape, and the word before, hashed."""
    out = [0.0] * N_FEATURES
    at, shape, span = kind * (len(LABELERS) + 1), 4 * (len(LABELERS) + 1), text[start:end]
    out[at] = 1.0
    out[at + 1 : at + 1 + len(cast)] = map(float, cast)
    n_digits = len(_digits(span))
    out[shape : shape + 6] = [
        min(end - start, 40) / 40, min(n_digits, 20) / 20, n_digits / (end - start),
        sum(not c.isalnum() for c in span[:64]) / 10, float(start == 0 or text[start - 1].isspace()), float(end == len(text) or text[end].isspace()),
    ]
    word = re.search(r"([^\W\d_]+)\W*\Z", text[max(0, start - 24) : start])
    if word:
        out[shape + 6 + crc32(word[1].lower().encode()) % 32] = 1.0
    return out


def candidates(text: str) -> list[tuple[int, int, int, bool, list[int], list[float]]]:
    """(start, kind, end, base?, votes, features) of every candidate of a text, in order."""
    if not ANY.search(text):
        return []
    base = base_spans(text)
    both = sorted([(*s, True) for s in base] + [(*s, False) for s in wide_spans(text, base)])
    return [(s, k, e, strict, v := votes(text, s, k, e, strict), features(text, s, k, e, v)) for s, k, e, strict in both]


@dataclass(frozen=True)
class SpanModel:
    """Weights of the classifier; the reliabilities it was taught by."""

    weights: tuple[float, ...]
    reliability: dict[str, tuple[float, list[float]]]

    def probability(self, x: np.ndarray) -> np.ndarray:
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-(x @ w[1:] + w[0])))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Newton's method with soft labels; the first weight is the intercept."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
    return w


FOUND = "doc_id long, found array<struct<start:int,kind:int,end:int,base:boolean,votes:array<int>,x:array<float>>>"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the candidates of its whole text. Null text is empty and has none."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "found": [
                [{"start": s, "kind": k, "end": e, "base": b, "votes": v, "x": x} for s, k, e, b, v, x in candidates(t)] for t in f["text"]
            ]})

    return _texts(docs).mapInPandas(lambda b: released(each(b)), FOUND)


def train(found: DataFrame) -> SpanModel:
    """Reliabilities by EM over all candidates' vote patterns; the classifier on a bounded sample."""
    spans = found.select(F.explode("found").alias("c")).select("c.*")
    counts = spans.groupBy("kind", "votes").count().collect()  # 4 * 3 ** len(LABELERS) rows at most
    learnt = {
        name: weak.estimate(sorted((tuple(r["votes"]), r["count"]) for r in counts if r["kind"] == k), len(LABELERS), prior=0.5, bounds=(0.05, 0.95))
        for k, name in enumerate(KINDS)
    }
    order = F.xxhash64("kind", "votes", "x", "start", "end")
    some = thinned(spans, order, sum(r["count"] for r in counts), TRAINING_SPANS)
    rows = some.select("kind", "votes", "x", F.shiftrightunsigned(order, 12).alias("_order")).orderBy("_order").limit(TRAINING_SPANS).collect()
    if not rows:
        return SpanModel((0.0,) * (N_FEATURES + 1), learnt)
    soft = np.array([weak.posterior(tuple(r["votes"]), *learnt[KINDS[r["kind"]]]) for r in rows])
    return SpanModel(tuple(fit_logistic(np.array([r["x"] for r in rows], float), soft)), learnt)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def decide(found: list, model: SpanModel) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base?) that stay: all base spans, and wider candidates the classifier accepts."""
    if not len(found):
        return []
    p = model.probability(np.array([c["x"] for c in found], float))
    return [(c["start"], c["kind"], c["end"], c["base"]) for c, q in zip(found, p, strict=True) if c["base"] or q >= ACCEPT]


def spans_of(found: DataFrame, model: SpanModel) -> DataFrame:
    """The digest of each document: counts and hash of the base spans, all spans, and how many were added."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc_id, own in zip(f["doc_id"], f["found"], strict=True):
                stay = decide(own, model)
                base = [x[:3] for x in stay if x[3]]
                n = [sum(k == j for _, k, _ in base) for j in range(4)]
                rows.append((doc_id, *n, sha256(joined(base).encode()).hexdigest(), joined([x[:3] for x in stay]), len(stay) - len(base)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return found.mapInPandas(lambda b: released(each(b)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def find(docs: DataFrame) -> DataFrame:
    """Personal data in every document: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base
    spans, spans (all, the added ones among them) and n_added.

    Places are code points, ends exclusive. Null and empty texts have no spans; repeated rows are
    treated alike; an empty table gives no rows; further columns are not read.
    """
    found = materialise(scan(docs), "pii")
    return spans_of(found, train(found))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, like [EMAIL]. Other columns stay, as does null text."""
    model = train(materialise(scan(docs).filter(F.size("found") > 0), "pii"))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else replaced(t, model))

    return docs.withColumn("text", cleaned(F.col("text")))


def replaced(text: str, model: SpanModel) -> str:
    found = [{"start": s, "kind": k, "end": e, "base": b, "x": x} for s, k, e, b, _, x in candidates(text)]
    out, at = [], 0
    for start, kind, end, _ in decide(found, model):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
