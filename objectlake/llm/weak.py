"""Weak supervision: expectation-maximisation over counts of vote patterns.

A labeler votes 1, -1 or abstains (0). Votes are taken as independent given the truth; each labeler
has one accuracy, kept above a coin's, so that a vote never counts against its own direction. The
input is a count for each distinct pattern, 3 ** labelers at most, so its size doesn't follow the corpus.
"""

from __future__ import annotations

import math

#: Bounds of an accuracy.
ACCURACY = (0.55, 0.99)

Patterns = list[tuple[tuple[int, ...], int]]


def log_odds(pattern: tuple[int, ...], prior: float, right: list[float]) -> float:
    return math.log(prior / (1 - prior)) + sum(v * math.log(a / (1 - a)) for v, a in zip(pattern, right, strict=True))


def posterior(pattern: tuple[int, ...], prior: float, right: list[float]) -> float:
    return 1 / (1 + math.exp(-log_odds(pattern, prior, right)))


#: Bounds of what a vote of -1 and one of 1 add to the log-odds.
AGAINST, FOR = (-5.0, -0.2), (0.0, 1.0)


def estimate_outcomes(patterns: Patterns, n_labelers: int, prior: float = 0.85, bounds: tuple[float, float] = (0.5, 0.97), rounds: int = 50) -> tuple[float, list[tuple[float, float]]]:
    """The share of positives, and for each labeler what its votes of -1 and of 1 add to the log-odds.

    Each vote has a probability of its own among positives and among negatives, so that a common vote
    which both draw says little and an alarm that positives hardly ever draw says much. An abstention
    says nothing. Without patterns the starting values come back.
    """
    adds, total = [(-2.5, 0.2)] * n_labelers, sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        positive, seen = 0.0, [{(v, c): 0.0 for v in (-1, 1) for c in (0, 1)} for _ in range(n_labelers)]
        for pattern, n in patterns:
            p = 1 / (1 + math.exp(-outcome_odds(pattern, prior, adds)))
            positive += n * p
            for j, v in enumerate(pattern):
                if v:
                    seen[j][v, 1] += n * p
                    seen[j][v, 0] += n * (1 - p)
        negative = total - positive
        ratio = lambda s, v: math.log((s[v, 1] + 0.5) / (positive + 1)) - math.log((s[v, 0] + 0.5) / (negative + 1))  # noqa: B023, E731
        adds = [(min(AGAINST[1], max(AGAINST[0], ratio(s, -1))), min(FOR[1], max(FOR[0], ratio(s, 1)))) for s in seen]
        prior = min(bounds[1], max(bounds[0], positive / total))
    return prior, adds


def outcome_odds(pattern: tuple[int, ...], prior: float, adds: list[tuple[float, float]]) -> float:
    return math.log(prior / (1 - prior)) + sum(a[v > 0] for v, a in zip(pattern, adds, strict=True) if v)


def estimate(patterns: Patterns, n_labelers: int, prior: float = 0.8, bounds: tuple[float, float] = (0.5, 0.95), rounds: int = 50) -> tuple[float, list[float]]:
    """The share of positives and each labeler's accuracy; the starting values if there are no votes."""
    right, total = [0.8] * n_labelers, sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        positive, hit, cast = 0.0, [0.0] * n_labelers, [0.0] * n_labelers
        for pattern, n in patterns:
            p = posterior(pattern, prior, right)
            positive += n * p
            for j, v in enumerate(pattern):
                if v:
                    hit[j] += n * (p if v > 0 else 1 - p)
                    cast[j] += n
        prior = min(bounds[1], max(bounds[0], positive / total))
        right = [min(ACCURACY[1], max(ACCURACY[0], (h + 0.8) / (c + 1))) for h, c in zip(hit, cast, strict=True)]
    return prior, right
