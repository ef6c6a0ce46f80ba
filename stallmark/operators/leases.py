"""Run leases under contention: what a log of calls makes of them, call by call.

Calls on one search are a serial order of (at, seq); the outcome of each depends on those before it. Rows are dealt by
search and sorted within tasks, and a task folds over them as they come: it holds the state of one search and one batch,
whatever the length of a log. What a caller gets is written at its own call, so retries of a task give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEASE_MINUTES = 30
OUTCOMES = "search_id string, seq long, outcome string, fence long, holder string, expires_at timestamp_ntz, last_run_at timestamp_ntz"
_OUT = pa.schema([("search_id", pa.string()), ("seq", pa.int64()), ("outcome", pa.string()), ("fence", pa.int64()), ("holder", pa.string()), ("expires_at", pa.timestamp("us")), ("last_run_at", pa.timestamp("us"))])


class Lease:
    """The lease of one search, in microseconds; fence counts its grants."""

    def __init__(self, active: bool, holder: str | None, expires: int | None, last_run: int | None, lasts: int):
        self.active, self.holder, self.expires, self.last_run, self.lasts, self.fence = active, holder, expires, last_run, lasts, 0

    def call(self, kind: str, at: int, lease_id: str, seen: int | None, fresh: bool = False) -> str:
        """acquire: granted where the search is active, its last run is the one the caller has seen (fresh: it has just read
        it), and no lease holds (one holds until the moment it expires); its own lease does not help a caller. renew: lasts anew for the holder, also
        past its end as long as nobody else took it, else it is lost. complete and fail give it back; only a completed run
        moves last_run. Other calls, and those of others, are missed."""
        if kind == "acquire":
            if not self.active or not fresh and self.last_run != seen or self.holder is not None and self.expires > at:
                return "refused"
            self.holder, self.expires, self.fence = lease_id, at + self.lasts, self.fence + 1
            return "granted"
        if self.holder is None or self.holder != lease_id:
            return "lost" if kind == "renew" else "missed"
        if kind == "renew":
            self.expires = at + self.lasts
            return "renewed"
        if kind not in ("complete", "fail"):
            return "missed"
        self.holder = self.expires = None
        if kind == "complete":
            self.last_run = at
        return "released"


def _fold(lasts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, lease = None, None
        for b in batches:
            out = []
            for search, seq, at, kind, lease_id, seen, fresh, first in zip(*(b[c].to_pylist() for c in ("search_id", "seq", "at", "kind", "lease_id", "seen", "fresh", "first")), strict=True):
                if search != name:
                    name, lease = search, Lease(first["active"], first["holder"], first["expires"], first["last_run"], lasts)
                outcome = lease.call(kind, at, lease_id, seen, fresh)
                out.append({"search_id": search, "seq": seq, "outcome": outcome, "fence": lease.fence, "holder": lease.holder, "expires_at": lease.expires, "last_run_at": lease.last_run})
            yield pa.RecordBatch.from_pylist(out, _OUT)

    return run


def replay(searches: DataFrame, calls: DataFrame, minutes: int = LEASE_MINUTES) -> DataFrame:
    """(search_id, seq, outcome, fence, holder, expires_at, last_run_at) after each of the calls (search_id, seq, at, kind,
    lease_id, seen_last_run_at, fresh) on the searches' rows. Calls on searches that are not there are left out."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    first = F.struct("active", F.col("run_lease_id").alias("holder"), micros("run_lease_expires_at").alias("expires"), micros("last_run_at").alias("last_run"))
    known = searches.select(F.col("search_id").cast("string").alias("search_id"), first.alias("first"))
    rows = calls.select(F.col("search_id").cast("string").alias("search_id"), F.col("seq").cast("long").alias("seq"), micros("at").alias("at"), "kind", F.col("lease_id").cast("string").alias("lease_id"), micros("seen_last_run_at").alias("seen"), F.coalesce("fresh", F.lit(False)).alias("fresh"))
    return rows.join(known, "search_id").repartition("search_id").sortWithinPartitions("search_id", "at", "seq").mapInArrow(_fold(minutes * 60_000_000), OUTCOMES)
