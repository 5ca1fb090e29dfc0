"""A keyed index over a growing log, merged batch by batch and rewritten only where keys change."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lake import Folder


@dataclass(frozen=True)
class KeyedIndex:
    """Of every key the row with the greatest order, in buckets of keys.

    schema: DDL of the rows; keys name a row, order says which of a key's rows is the last. A merge reads
    and writes the buckets that its rows fall into and leaves the others' files as they are; a manifest
    names the folder of each bucket, the last batch and the greatest order met (the position). As the
    greatest order wins, a row that comes late changes what it should and nothing else, and a batch that is
    replayed changes nothing; late rows are counted. buckets is fixed when the index is first written.
    """

    spark: SparkSession
    root: str
    schema: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int = 64

    @property
    def files(self) -> Folder:
        return Folder(self.spark, self.root)

    def state(self) -> dict:
        """The manifest: number, batch, position, rows and late rows of the last merge, buckets, and what they replaced."""
        names = sorted(n for n, _ in self.files.listing("_state"))
        if not names:
            return {"number": 0, "batch": -1, "position": None, "merged": 0, "late": 0, "of": self.buckets, "buckets": {}, "replaced": []}
        return json.loads(self.files.read(f"_state/{names[-1]}"))

    def _read(self, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(sorted(self.state()["buckets"].values()))

    def merge(self, rows: DataFrame, batch: int) -> dict:
        """Merge one batch; the new manifest. A batch that has been merged before is left alone."""
        before = self.state()
        if batch <= before["batch"]:
            return before
        names = self.spark.createDataFrame([], self.schema).columns
        others = [c for c in names if c not in self.keys and c not in self.order]
        at = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in self.order]))
        position = F.from_json(F.lit(before["position"]), "struct<" + ",".join(f"{c}:string" for c in self.order) + ">")
        typed = F.struct(*[position[c].cast(dict(rows.dtypes)[c]).alias(c) for c in self.order])
        own = F.struct(*self.order)
        late = F.count_if(own < typed) if before["position"] else F.lit(0)
        own_bucket = F.pmod(F.xxhash64(*self.keys), F.lit(before["of"]))
        seen = rows.groupBy(own_bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), late.alias("late"), F.max(F.struct(own.alias("o"), at.alias("at"))).alias("last")).collect()  # a row for each bucket
        number, folder = before["number"] + 1, f"data/{batch}-{uuid.uuid4().hex}"
        touched = sorted(r.bucket for r in seen)
        buckets, replaced = dict(before["buckets"]), [before["buckets"][str(b)] for b in touched if str(b) in before["buckets"]]
        if touched:
            both = self._read(replaced).unionByName(rows.select(names))
            last = both.groupBy(*self.keys).agg(F.max(F.struct(*self.order, *others)).alias("last")).select(*self.keys, *[F.col(f"last.{c}") for c in (*self.order, *others)])
            last.select(*names, own_bucket.alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
            buckets |= {str(b): f"{folder}/bucket={b}" for b in touched}
        furthest = max((r["last"] for r in seen), key=lambda r: tuple(r.o), default=None)
        after = before | {"number": number, "batch": batch, "merged": sum(r.n for r in seen), "late": sum(r.late for r in seen), "buckets": buckets, "replaced": replaced}
        if furthest is not None and not self._passed(before["position"], furthest["at"], rows):
            after["position"] = furthest["at"]
        if not self.files.create(f"_state/{number:012d}.json", json.dumps(after)):
            raise RuntimeError("another writer merges into this index")
        for gone in before["replaced"]:  # readers of the last manifest but one may still be at work
            self.files.delete(gone)
        for name, _ in sorted(self.files.listing("_state"))[:-2]:
            self.files.delete(f"_state/{name}")
        return after

    def _passed(self, position: str | None, at: str, rows: DataFrame) -> bool:
        """Is position at or beyond at?"""
        if position is None:
            return False
        kinds = "struct<" + ",".join(f"{c}:{k}" for c, k in rows.dtypes if c in self.order) + ">"
        own = lambda text: F.struct(*[F.from_json(F.lit(text), kinds)[c].alias(c) for c in self.order])
        return self.spark.range(1).select(own(position) >= own(at)).first()[0]
