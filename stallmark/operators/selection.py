"""Exact percentiles of groups of any size, by counted radix histograms.

`percentile` gathers all distinct values of a group in one task. Here equal values of a group are counted first; groups
with few distinct values then take that way, with counts. In the others each percentile asks for the values of two ranks.
A pass counts the rows of every 16-bit slice of the values' ordered bits, and each rank keeps the slice in which it falls
and how many rows come before it; what lies in no such slice leaves. Four passes end with one value each. A pass holds at
most 65,536 counts for a slice of the pass before, whatever its rows; tasks count their own rows before the shuffle, so
half of all rows in one group are spread as any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallmark.shared import stored

#: Distinct values up to which a group is left to one task, and the most asked slices that are broadcast.
FEW, MOST_ASKED = 100_000, 100_000
_FLIP = (1 << 63) - 1


def ordered_bits(value: Column) -> Column:
    """A double as a long of the same order; -0.0 counts as 0.0."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(_FLIP))).otherwise(bits)


def from_ordered_bits(bits: Column) -> Column:
    raw = F.when(bits < 0, bits.bitwiseXOR(F.lit(_FLIP))).otherwise(bits)
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its counted rows allow it; else Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= MOST_ASKED else df


def at_ranks(counted: DataFrame, asked: DataFrame) -> DataFrame:
    """(k, rank, value) for rows (k, v, n) of distinct values with counts, and asked (k, rank), ranks from 0."""
    rows = stored(counted.select("k", "n", ordered_bits(F.col("v")).alias("bits")), "percentile-rows")
    asked = asked.select("k", "rank", F.lit(0).cast("long").alias("slice"), F.lit(0).cast("long").alias("before"))
    for shift in (48, 32, 16, 0):
        parent = F.lit(0).cast("long") if shift == 48 else F.shiftright("bits", shift + 16)
        mine = rows.withColumn("parent", parent)
        if shift < 48:
            mine = mine.join(_small(asked.select("k", F.col("slice").alias("parent")).distinct()), ["k", "parent"])
        slices = mine.groupBy("k", "parent", F.shiftright("bits", shift).alias("next")).agg(F.sum("n").alias("c"))
        within = F.sum("c").over(Window.partitionBy("k", "parent").orderBy("next"))
        slices = slices.withColumn("upto", within)
        met = asked.join(slices, (asked.k == slices.k) & (F.col("slice") == F.col("parent")) & (F.col("rank") >= F.col("before") + F.col("upto") - F.col("c")) & (F.col("rank") < F.col("before") + F.col("upto")))
        asked = stored(met.select(asked.k, "rank", F.col("next").alias("slice"), (F.col("before") + F.col("upto") - F.col("c")).alias("before")), "percentile-ranks")
    return asked.select("k", "rank", from_ordered_bits(F.col("slice")).alias("value"))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], few: int = FEW) -> DataFrame:
    """keys, n (the values that count) and `percentiles`, an array with the value at each share (0 to 1), linear between
    neighbours at share * (n - 1): what F.percentile gives, to the last digit. Null and NaN values are left out; groups
    without any other have no row. Null keys are keys."""
    if not all(0 <= p <= 1 for p in shares):
        raise ValueError(f"{shares} are not all within 0 and 1")
    v = F.col(value).cast("double")
    counted = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(F.struct(*keys).alias("k"), (v + F.lit(0.0)).alias("v")).agg(F.count("*").alias("n"))
    counted = stored(counted, "percentile-values")
    sizes = stored(counted.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")), "percentile-groups")
    large = sizes.where(F.col("distinct") > few)
    weights = F.percentile("v", F.array(*map(F.lit, shares)), F.col("n"))
    out = counted.join(_small(large.select("k")), "k", "left_anti").groupBy("k").agg(F.sum("n").alias("n"), weights.alias("percentiles"))
    places = F.array(*(F.lit(p) * (F.col("n") - 1) for p in shares))
    ranks = F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(F.floor(p), F.ceil(p)))))
    found = at_ranks(counted.join(_small(large.select("k")), "k", "left_semi"), large.select("k", F.explode(ranks).alias("rank")))
    known = found.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")).join(large, "k")

    def between(p: Column) -> Column:
        low, high = F.floor(p), F.ceil(p)
        a, b = F.col("at")[low], F.col("at")[high]
        return F.when(a == b, a).otherwise((high - p) * a + (p - low) * b)

    out = out.unionByName(known.select("k", "n", F.transform(places, between).alias("percentiles")))
    return out.select(*(F.col("k")[k].alias(k) for k in keys), "n", "percentiles")
