"""First-wins deduplication and keep-one rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallmark.functions.urls import normalize_url


def identity_key(source: Column, external_id: Column, url: Column) -> Column:
    """source:id:… where there is an id, else source:url:…; the two never meet."""
    by_id = F.concat(source, F.lit(":id:"), external_id)
    return F.coalesce(by_id, F.concat(source, F.lit(":url:"), normalize_url(url)))


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """One row of each key: the first in order. Spark keeps one row a key and task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def deduplicate_listings(df: DataFrame, order: list[Column | str] = ["seq"]) -> DataFrame:  # noqa: B006
    keyed = df.withColumn("dedup_key", identity_key(F.col("source"), F.col("external_id"), F.col("url")))
    return keep_first(keyed, ["dedup_key"], order)


def union_batches(batches: list[DataFrame], order: list[Column | str] = ["seq"]) -> DataFrame:  # noqa: B006
    """The batches of all providers, each deduplicated and then all together."""
    out = None
    for b in batches:
        b = deduplicate_listings(b, order).drop("dedup_key")
        out = b if out is None else out.unionByName(b)
    return deduplicate_listings(out, order)


def latest_analyses(analyses: DataFrame, notified: DataFrame) -> DataFrame:
    """One analysis for each listing, search and input: a notified one first, then the newest, then the largest id."""
    flag = notified.select("analysis_id").distinct().withColumn("_notified", F.lit(True))
    joined = analyses.join(flag, "analysis_id", "left")
    order = [F.coalesce("_notified", F.lit(False)).desc(), F.col("created_at").desc_nulls_first(), F.col("analysis_id").desc()]
    return keep_first(joined, ["listing_id", "search_id", "input_hash"], order).drop("_notified")


def canonical_pairs(matches: DataFrame) -> DataFrame:
    """Each unordered pair once, a < b: highest confidence, then last update, then largest id."""
    pair = matches.withColumn("_a", F.least("a", "b")).withColumn("_b", F.greatest("a", "b")).where("_a <> _b")
    order = [F.col("confidence").desc_nulls_first(), F.col("updated_at").desc_nulls_first(), F.col("match_id").desc()]
    kept = keep_first(pair, ["_a", "_b"], order)
    return kept.withColumn("a", F.col("_a")).withColumn("b", F.col("_b")).drop("_a", "_b")


def one_notification(notifications: DataFrame) -> DataFrame:
    """One row for each analysis and channel: unsent first (a null time sorts before all), then last sent, largest id."""
    return keep_first(notifications, ["analysis_id", "channel"], [F.col("sent_at").desc_nulls_first(), F.col("notification_id").desc()])


def resolve_identity(batch: DataFrame, snapshot: DataFrame) -> DataFrame:
    """batch with the listing_id it belongs to (null: new): by (source, external_id), else by normalized URL among
    rows of the snapshot that have no external id."""
    by_id = snapshot.where("external_id is not null").select("source", "external_id", F.col("listing_id").alias("_by_id"))
    by_url = snapshot.where("external_id is null").select("source", "normalized_url", F.col("listing_id").alias("_by_url"))
    joined = batch.join(by_id, ["source", "external_id"], "left").join(by_url, ["source", "normalized_url"], "left")
    return joined.withColumn("listing_id", F.coalesce("_by_id", "_by_url")).drop("_by_id", "_by_url")
