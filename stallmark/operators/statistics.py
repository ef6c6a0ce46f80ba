"""Exact price statistics, by source and over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallmark.functions.numbers import valid_price


def confidence(n: Column) -> Column:
    """How far a reference from n prices can be trusted."""
    return F.when(n >= 10, "high").when(n >= 5, "medium").otherwise("low")


def percentile(value: Column | str, p: float) -> Column:
    """Exact, linear between neighbours at p / 100 * (n - 1)."""
    if not 0 <= p <= 100:
        raise ValueError(f"percentile {p} is not within 0 and 100")
    return F.percentile(value, p / 100)


def price_aggregates(price: str = "price") -> list[Column]:
    """Aggregates over prices that are valid; sample_size 0 and nulls where there is none."""
    p = F.percentile(price, F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75, 0.9))))
    return [
        F.count(price).alias("sample_size"),
        confidence(F.count(price)).alias("confidence"),
        p[1].alias("median_price"),
        F.avg(price).alias("mean_price"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        p[0].alias("p25"),
        p[2].alias("p75"),
        p[3].alias("p90"),
    ]


def price_statistics(df: DataFrame, keys: list[str], price: str = "price") -> DataFrame:
    return df.withColumn(price, valid_price(F.col(price))).groupBy(*keys).agg(*price_aggregates(price))


def market_statistics(df: DataFrame, keys: list[str], source: str = "source", price: str = "price") -> DataFrame:
    """One row for each key and source, and one for each key over all sources (scope `combined`), in one pass."""
    clean = df.withColumn(price, valid_price(F.col(price))).where(F.col(price).isNotNull())
    by = [F.col(k) for k in keys]
    sets = clean.groupingSets([[*by, F.col(source)], by], *by, F.col(source))
    out = sets.agg(*price_aggregates(price), F.grouping(source).alias("_all"))
    return out.select(*keys, F.when(F.col("_all") == 1, "combined").otherwise(F.col(source)).alias("scope"), *(c for c in out.columns if c not in (*keys, source, "_all")))


def market_maps(df: DataFrame, keys: list[str]) -> DataFrame:
    """market_statistics folded to one row for each key: combined, and by_source as a map."""
    names = [c for c in market_statistics(df, keys).columns if c not in (*keys, "scope")]
    rows = market_statistics(df, keys).withColumn("stats", F.struct(*names))
    pairs = F.collect_list(F.when(F.col("scope") != "combined", F.struct("scope", "stats")))
    return rows.groupBy(*keys).agg(F.max(F.when(F.col("scope") == "combined", F.col("stats"))).alias("combined"), F.map_from_entries(F.array_sort(pairs)).alias("by_source"))
