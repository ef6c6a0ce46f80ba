"""The driver contract, and the stream."""

import __spark_entry__ as entry

from stallmark.plans.registry import ORACLE_SQL, QUERIES


def test_contract(spark):
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_stream_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    a = {tuple(r) for r in entry.queries()["stream_price_changes"](spark, sf).select("listing_id", "seq", "price").collect()}
    b = {tuple(r) for r in entry.queries()["price_changes"](spark, sf).select("listing_id", "seq", "price").collect()}
    assert a == b


def test_outbox_takes_a_message_once(spark, tmp_path):
    from stallmark.streaming import prices

    for k in range(2):
        spark.createDataFrame([(i,) for i in range(k, k + 3)], "notification_id long").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("notification_id long").parquet(str(tmp_path / "in"))
        prices.write_outbox(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.notification_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3]


def test_first_within_watermark(spark, tmp_path):
    from stallmark.streaming import prices

    spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-01"), ("b", "2024-01-01")], "k string, at string").selectExpr("k", "cast(at as timestamp) at").write.parquet(str(tmp_path / "in"))
    out = prices.first_within(spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "in")), ["k"], "at", "1 hour")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
