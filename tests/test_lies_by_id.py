"""Tables that lie by listing_id meet where they lie, and only what is read of them is moved."""

import re

import __spark_entry__ as entry
from stallmark.operators import state
from stallmark.operators.snapshot_store import SnapshotStore
from stallmark.plans import views
from stallmark.schema import LISTING

SF = "/root/testdata/sf0.001"


def shuffled(df):
    """The shuffles by hash that the plan, as it ran, has written."""
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return [line for line in ran.splitlines() if re.search(r"- Exchange hashpartitioning", line)]


def test_a_fence_is_judged_where_the_rows_lie(spark):
    assert len(shuffled(entry.queries()["fenced_updates"](spark, SF))) == 1


def test_rows_by_id_are_those_of_listing(spark):
    a, b = views.listing(spark, SF).drop("dedup_key"), views.listing_by_id(spark, SF)
    assert a.schema == b.schema and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_an_upsert_moves_what_is_read(spark):
    """Neither the fingerprint nor other columns that nobody reads, and the stored side is not moved again."""
    found = shuffled(entry.queries()["upsert_snapshot"](spark, SF))
    assert len(found) == 2 and not any("struct" in x for x in found)


def test_a_name_of_two_listings_updates_both(spark):
    at, url = views.AS_OF, "https://www.example.com/item/1?v=1"
    kind = "seq long, source string, external_id string, title string, price double, currency string, location string, url string, image_url string, category string"
    batch = lambda *rows: spark.createDataFrame([(i, "olx", e, "Placa", p, "BRL", None, u, None, "gpu") for i, (e, u, p) in enumerate(rows)], kind)
    step = lambda s, b: state.upsert_summaries(s, b, at).drop("change", "price_point")
    one = step(spark.createDataFrame([], LISTING), batch((None, url, 1.0)))
    two = step(one, batch(("7", url, 2.0), ("7", url + "2", 3.0)))  # the first takes the id in, the second is new under it
    assert sorted((r.listing_id, r.external_id, r.price) for r in two.collect()) == [("olx:id:7", "7", 3.0), ("olx:url:https://example.com/item/1?v=1", "7", 2.0)]
    assert [r.price for r in step(two, batch(("7", url, 4.0))).collect()] == [4.0, 4.0]


def test_a_batch_is_written_where_it_was_joined(spark, tmp_path, monkeypatch):
    """Whole rows are shuffled to meet the stored ones, and not once more to be written; files are compressed well."""
    rows = ["id as seq", "'olx' as source", "string(id) as external_id", "'Placa' as title", "1D as price", "'BRL' as currency", "'Lages' as location", "concat('https://www.example.com/', id) as url", "string(null) as image_url", "'gpu' as category"]
    moved = []
    repartition = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, *a: (moved.append(a), repartition(self, *a))[1])
    store = SnapshotStore(spark, f"file://{tmp_path}/store", buckets=4)
    for number in (1, 2):
        assert store.apply(number, spark.range(500).selectExpr(*rows), views.AS_OF) == [0, 1, 2, 3]
    files = [str(f) for f in tmp_path.glob("store/data/*/*/*.parquet")]
    assert store.snapshot().count() == 500 and not moved and files and all(".zstd." in f for f in files)
