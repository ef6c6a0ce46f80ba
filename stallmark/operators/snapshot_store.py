"""A stored snapshot of listings that a batch rewrites in part, once.

Listings lie in buckets by their id. The manifest of a version names for each bucket the folder that holds it, and the last
batch that was applied. A batch of summaries is resolved against the narrow columns of all listings; only the buckets of
listings that it names are read whole, brought up to date and written to a folder of the batch, next to the price points
it adds. The new manifest then takes its name in one rename: a reader sees a batch whole or not at all, a batch that
fails before has changed nothing, and one that comes again (its number is not above the last) does nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmark.operators.state import identified, upsert_identified
from stallmark.schema import LISTING, PRICE_HISTORY

KEYS = ["listing_id", "source", "external_id", "normalized_url"]


@dataclass
class Manifest:
    version: int = 0
    last_batch: int = -1
    buckets: dict[str, str] = field(default_factory=dict)
    history: list[str] = field(default_factory=list)


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        where = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def manifest(self) -> Manifest:
        """The latest version."""
        names = [n for n in self._names("manifests") if n.endswith(".json")]
        if not names:
            return Manifest()
        rows = self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first()
        return Manifest(**json.loads(rows.value))

    def _commit(self, m: Manifest) -> None:
        draft, final = self._hadoop(f"manifests/.v{m.version:012d}-{id(m):x}"), self._hadoop(f"manifests/v{m.version:012d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(m.__dict__).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {m.version} of {self.path} has been written by someone else")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], LISTING)
        return self.spark.read.schema(LISTING).parquet(*(f"{self.path}/{f}" for f in folders))

    def snapshot(self) -> DataFrame:
        return self._read(list(self.manifest().buckets.values()))

    def history(self) -> DataFrame:
        """(listing_id, observed_at, price): the price points of all batches."""
        folders = self.manifest().history
        return self.spark.read.schema(PRICE_HISTORY).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], PRICE_HISTORY)

    def apply(self, number: int, batch: DataFrame, as_of: datetime) -> list[int]:
        """Applies batch `number` (SUMMARY columns and category); the buckets it rewrote, none if it came before."""
        m = self.manifest()
        if number <= m.last_batch:
            return []
        known = self._read(list(m.buckets.values())).select(*KEYS) if m.buckets else None
        named = identified(batch, known)
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")
        touched = sorted(r.b for r in named.select(bucket(F.col("listing_id")).alias("b")).distinct().collect())
        if touched:
            old = self._read([m.buckets[str(b)] for b in touched if str(b) in m.buckets])
            new = upsert_identified(old, named, as_of).withColumn("bucket", bucket(F.col("listing_id")))
            folder = f"data/batch-{number:012d}-v{m.version + 1}"
            # each task of the join writes to all buckets: more files, but whole rows are not shuffled once more
            new.write.option("compression", "zstd").partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{folder}")
            points = self.spark.read.schema(new.drop("bucket").schema).parquet(f"{self.path}/{folder}").where("price_point is not null")
            points.select("listing_id", F.lit(as_of).alias("observed_at"), F.col("price_point").alias("price")).write.mode("overwrite").parquet(f"{self.path}/history/batch-{number:012d}-v{m.version + 1}")
            m.buckets |= {n.removeprefix("bucket="): f"{folder}/{n}" for n in self._names(folder) if n.startswith("bucket=")}
            m.history.append(f"history/batch-{number:012d}-v{m.version + 1}")
        m.version, m.last_batch = m.version + 1, number
        self._commit(m)
        return touched

    def vacuum(self) -> int:
        """Deletes folders of buckets that the latest version does not name; how many."""
        live = set(self.manifest().buckets.values())
        stale = [f"data/{d}/{b}" for d in self._names("data") for b in self._names(f"data/{d}") if b.startswith("bucket=") and f"data/{d}/{b}" not in live]
        return sum(bool(self._fs.delete(self._hadoop(f), True)) for f in stale)
