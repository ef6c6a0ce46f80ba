"""Streams run to their end as queries."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmark.plans import views
from stallmark.shared import fresh_path
from stallmark.streaming import ordered, outbox, prices, scheduler
from stallmark.streaming.buckets import buckets_for

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Steps in which late rows arrive, and the share of the whole time span by which they are late at most.
STEPS, LATE = 3, 0.1


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_out(stream: DataFrame, where: str) -> None:
    """Runs a stream of files until none is left, into Parquet."""
    stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def stream_price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change points of the price observations, read as a stream of files until no file is left."""
    where = fresh_path(spark, "price-stream")
    views.price_obs(spark, sf_dir).select("listing_id", "seq", F.col("observed_at"), "price").write.parquet(f"{where}/in")
    kind = "listing_id string, seq long, observed_at timestamp_ntz, price double"
    n = spark.read.schema(kind).parquet(f"{where}/in").count()
    with rocksdb(spark):
        run_out(prices.price_changes(spark.readStream.schema(kind).parquet(f"{where}/in"), buckets_for(n)), where)
    return spark.read.schema(prices.CHANGE).parquet(f"{where}/out")


def _micros(time: str = "observed_at") -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time))


def _time(micros: str) -> Column:
    return F.timestamp_add("MICROSECOND", F.col(micros), F.lit("1970-01-01").cast("timestamp_ntz"))


def stream_late_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same change points where observations come in three steps, each late by up to a tenth of the whole time: what a
    step lacks of its time comes with the next. A last message far ahead ends the stream."""
    where = fresh_path(spark, "late-prices")
    rows = views.price_obs(spark, sf_dir).select("listing_id", "seq", _micros().alias("micros"), "price")
    first, last, many = rows.agg(F.min("micros"), F.max("micros"), F.count("*")).first()
    late = int((last - first) * LATE) + 1
    arrival = F.col("micros") + F.pmod(F.xxhash64("seq"), F.lit(late))
    step = F.floor((arrival - first) * STEPS / (last - first + late + 1))
    rows.withColumn("step", step).write.partitionBy("step").parquet(f"{where}/all")
    kind = "listing_id string, seq long, micros long, price double"
    end = spark.createDataFrame([("", -1, last + 2 * late + 2_000_000, None)], kind)
    with rocksdb(spark):
        for n in range(STEPS):
            batch = spark.read.schema(kind).parquet(f"{where}/all/step={n}")
            (batch.unionByName(end) if n == STEPS - 1 else batch).write.mode("append").parquet(f"{where}/in")
            run_out(ordered.ordered_price_changes(spark.readStream.schema(kind).parquet(f"{where}/in"), f"{late + 1000} microseconds", buckets=buckets_for(many)), where)
    out = spark.read.schema(ordered.CHANGE).parquet(f"{where}/out")
    return out.select("listing_id", "seq", _time("micros").alias("observed_at"), "price")


def stream_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of all purchases, two to a number, that come in two steps: what reaches the outbox, each number once."""
    where = fresh_path(spark, "outbox")
    e = views.table(spark, sf_dir, "events").where("event_type = 'purchase'")
    message = F.floor(F.col("event_id") / 4).alias("notification_id")
    rows = e.select(message, F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 2).alias("step"))
    kind = "notification_id long, at timestamp"
    for n in (0, 1):
        rows.where(F.col("step") == n).drop("step").write.mode("append").parquet(f"{where}/in")
        outbox.fill_outbox(spark.readStream.schema(kind).parquet(f"{where}/in"), f"{where}/out", f"{where}/checkpoint", "notification_id", "at", "400 days").awaitTermination()
    return outbox.read_outbox(spark, f"{where}/out", kind).select("notification_id")


STREAM_OUTBOX = "SELECT DISTINCT event_id // 4 AS notification_id FROM events WHERE event_type = 'purchase'"


def stream_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticks at which searches start: a user's search is defined a second before the first event, purchases complete a
    run and errors fail it. Messages come in two steps, late by up to a tenth of the whole time."""
    where, u = fresh_path(spark, "schedule"), F.col("user_id")
    e = views.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", _micros("ts").alias("micros"))
    none, second = (lambda kind: F.lit(None).cast(kind)), 1_000_000
    define = e.groupBy("user_id").agg((F.min("micros") - second).alias("micros")).select(u.cast("string").alias("search_id"), "micros", F.lit(-1).cast("long").alias("seq"), F.lit("define").alias("kind"), (60 + u % 5 * 60).alias("interval_minutes"), (u % 7 != 0).alias("active"), none("long").alias("last_run_micros"))
    finish = e.where(F.col("event_type").isin("purchase", "error")).select(u.cast("string").alias("search_id"), "micros", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "complete").otherwise("fail").alias("kind"), none("long").alias("interval_minutes"), none("boolean").alias("active"), none("long").alias("last_run_micros"))
    rows = define.unionByName(finish)
    first, last = e.agg(F.min("micros") - second, F.max("micros")).first()
    late = -(-int((last - first) * LATE) // scheduler.MINUTE) + 1
    arrival = F.col("micros") + F.pmod(F.xxhash64("seq", "search_id"), F.lit((late - 1) * scheduler.MINUTE + 1))
    rows.withColumn("step", (arrival > (first + last) // 2).cast("int")).write.partitionBy("step").parquet(f"{where}/all")
    kind = f"search_id string, {scheduler.MESSAGE}"
    end = spark.createDataFrame([("", (-(-last // scheduler.MINUTE) + late) * scheduler.MINUTE, -2, "define", 1, False, None)], kind)
    with rocksdb(spark):
        for n in (0, 1):
            batch = spark.read.schema(kind).parquet(f"{where}/all/step={n}")
            (batch.unionByName(end) if n else batch).write.mode("append").parquet(f"{where}/in")
            run_out(scheduler.schedule(spark.readStream.schema(kind).parquet(f"{where}/in"), f"{late} minutes"), where)
    return spark.read.schema(scheduler.STARTS).parquet(f"{where}/out").select("search_id", _time("due_micros").alias("due_at"))


_TICK = "date_trunc('minute', {0}) + CASE WHEN date_trunc('minute', {0}) < {0} THEN INTERVAL 1 MINUTE ELSE INTERVAL 0 MINUTE END"
STREAM_SCHEDULE = f"""WITH RECURSIVE d AS (SELECT user_id, min(ts) - INTERVAL 1 SECOND AS t0, (60 + user_id % 5 * 60)::INT AS iv, user_id % 7 <> 0 AS active FROM events GROUP BY user_id), m AS (SELECT max(ts) AS ts FROM events), z AS (SELECT {_TICK.format("ts")} + INTERVAL 1 MICROSECOND AS ts FROM m),
 x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, ts, done FROM (SELECT user_id, ts, event_id, event_type = 'purchase' AS done FROM events WHERE event_type IN ('purchase', 'error') UNION ALL SELECT user_id, z.ts, NULL, NULL FROM d, z)),
 s AS (SELECT user_id, 0::BIGINT AS n, false AS open, NULL::TIMESTAMP AS last, {_TICK.format("t0")} AS due, NULL::TIMESTAMP AS start FROM d UNION ALL
 SELECT user_id, n, is_open AND NOT ends, new_last, CASE WHEN ends THEN {_TICK.format("greatest(ts, coalesce(new_last + to_minutes(iv), ts))")} ELSE due END, CASE WHEN fired THEN due END
 FROM (SELECT *, CASE WHEN is_open AND done THEN ts ELSE last END AS new_last, is_open AND done IS NOT NULL AS ends FROM (SELECT x.*, iv, s.last, s.due, d.active AND NOT s.open AND s.due < x.ts AS fired, s.open OR d.active AND s.due < x.ts AS is_open FROM s JOIN x ON x.user_id = s.user_id AND x.n = s.n + 1 JOIN d ON d.user_id = s.user_id)))
 SELECT user_id::VARCHAR AS search_id, start AS due_at FROM s WHERE start IS NOT NULL"""


from stallmark.plans.pricing import PRICE_CHANGES as STREAM_PRICE_CHANGES  # noqa: E402, F401  the same rows as the batch query

STREAM_LATE_PRICES = STREAM_PRICE_CHANGES
