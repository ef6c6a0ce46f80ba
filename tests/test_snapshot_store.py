"""Stored snapshots: the rows of one upsert after the other, once each, with no more rewritten than a batch names."""

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stallmark.operators.snapshot_store import Manifest, SnapshotStore
from stallmark.operators.state import upsert_summaries
from stallmark.schema import LISTING, SUMMARY

DAYS = [datetime(2024, 1, d) for d in range(1, 6)]


def batch(spark, *rows):
    full = [(i, "olx", ext, title, price, "BRL", "Itajaí", url, None) for i, (ext, title, price, url) in enumerate(rows)]
    return spark.createDataFrame(full, SUMMARY).withColumn("category", F.lit("gpu"))


def url(n):
    return f"https://www.olx.com.br/item/a-{1000000 + n}"


def test_batches(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=16)
    assert store.snapshot().count() == 0 == store.history().count()
    first = batch(spark, *((str(n), f"Placa {n}", 100.0 + n, url(n)) for n in range(60)), (None, "Sem id", 5.0, url(99)))
    second = batch(spark, ("3", "Placa 3", 50.0, url(3)), ("4", "Placa 4", 104.0, url(4)), ("99", "Com id", 5.0, url(99)), ("1000", "Nova", 9.0, url(1000)))
    assert len(store.apply(1, first, DAYS[0])) == 16
    before = {p: p.stat().st_mtime_ns for p in Path(tmp_path / "s" / "data").rglob("*.parquet")}
    touched = store.apply(2, second, DAYS[1])
    assert 1 <= len(touched) <= 4
    written = sum(p.stat().st_size for p in Path(tmp_path / "s" / "data").rglob("*.parquet") if p not in before)
    assert all(p.stat().st_mtime_ns == t for p, t in before.items()) and written < 0.6 * sum(p.stat().st_size for p in before)
    want = upsert_summaries(upsert_summaries(spark.createDataFrame([], LISTING), first, DAYS[0]).drop("change", "price_point"), second, DAYS[1])
    rows = lambda df: sorted(str(r) for r in df.select(*(c for c in LISTING.fieldNames() if c != "attributes")).collect())
    assert rows(store.snapshot()) == rows(want)
    assert sorted((r.listing_id, r.price) for r in store.history().where(F.col("observed_at") == DAYS[1]).collect()) == [("olx:id:1000", 9.0), ("olx:id:3", 50.0)]
    after, points = rows(store.snapshot()), store.history().count()
    assert store.apply(2, batch(spark, ("3", "Placa 3", 1.0, url(3))), DAYS[2]) == [] == store.apply(1, first, DAYS[3])
    assert rows(store.snapshot()) == after and store.history().count() == points
    assert store.vacuum() == len(touched) and rows(store.snapshot()) == after
    assert store.apply(3, batch(spark), DAYS[4]) == [] and store.manifest().last_batch == 3 and rows(store.snapshot()) == after


def test_a_failed_batch_changes_nothing(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=4)
    store.apply(1, batch(spark, ("1", "Placa", 1.0, url(1))), DAYS[0])
    broken = batch(spark, ("1", "Placa", 2.0, url(1))).withColumn("price", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        store.apply(2, broken, DAYS[1])
    assert [r.price for r in store.snapshot().collect()] == [1.0] and store.manifest().last_batch == 1
    assert store.apply(2, batch(spark, ("1", "Placa", 3.0, url(1))), DAYS[1]) and [r.price for r in store.snapshot().collect()] == [3.0]
    with pytest.raises(RuntimeError, match="someone else"):
        store._commit(Manifest(version=2))
