"""Watches over a stream of counts, with a key's history as state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FIRED = "condition string, user_id string, at timestamp, n long, verdict string"
#: What a watch remembers of a condition and user: the definition it was counted under, its last count and when, and what was last sent.
REMEMBERED = "definition string, n long, at timestamp, sent string"
#: State of this kind is kept by this provider only.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def verdict(n: int, was: int, threshold: int | None) -> str | None:
    """What a changed count says; None if nothing."""
    if n == was:
        return None
    if threshold is not None:
        return None if n <= threshold else "above" if was <= threshold else "still above"
    return f"gained {n - was}" if n > was else f"fell {was - n}"


class Watch(StatefulProcessor):
    """Compares each count of a condition and user with the one before.

    The first count says nothing, nor does the first one under another definition; both are remembered. A
    text equal to the last one sent isn't sent again. A count older than the last one, or as old, is left out.
    """

    def __init__(self, threshold: int | None):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", REMEMBERED)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("at", kind="stable")
        definition, was, seen, sent = self.last.get() if self.last.exists() else (None, None, None, None)
        fired = []
        for own, n, at in zip(new["definition"], new["n"], new["at"], strict=True):
            if seen is not None and at <= pd.Timestamp(seen):
                continue
            said = verdict(int(n), was, self.threshold) if was is not None and own == definition else None
            if said is not None and said != sent:
                fired.append((key[0], key[1], at, int(n), said))
                sent = said
            definition, was, seen = own, int(n), at
        self.last.update((definition, was, seen, sent))
        yield pd.DataFrame(fired, columns=["condition", "user_id", "at", "n", "verdict"]).astype({"at": "datetime64[ns]", "n": "int64"})

    def close(self) -> None:
        pass


def keeps_state(spark: SparkSession) -> SparkSession:
    """Select the state store that watches need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def watch_stream(counts: DataFrame, threshold: int | None = None) -> DataFrame:
    """Firings (condition, user_id, at, n, verdict) of a stream of counts: condition, user_id, definition, at, n.

    With a threshold: above when it is passed, still above when the count then changes; else gained or
    fell. Counts of a key must come in the order of at, which files read in their order do.
    """
    return counts.groupBy("condition", "user_id").transformWithStateInPandas(Watch(threshold), FIRED, "Update", "None")
