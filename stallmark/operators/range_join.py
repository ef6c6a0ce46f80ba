"""Pairs whose values lie near each other in several dimensions, found by equal cells.

A dimension is cut into bins as wide as its reach. Where the reach grows in proportion to the target's value, bins grow in
proportion too, from the value on at which the proportion takes over, so that a target meets three or four bins whatever
its value. A candidate lies in one bin; a target probes those that its reach touches, and the bin of unknown values. A
target whose own value is unknown meets all candidates: these also lie in one cell for all values, which only such targets
probe. So a target meets a candidate in one cell at most, no pair comes twice, and the rows that meet are in proportion to
those that are given back. Cells with many candidates are split, and the targets that probe them are copied to the parts.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallmark.shared import stored

UNKNOWN, ANY = -(1 << 62), -(1 << 62) + 1
#: Rows of split cells that are broadcast at most; beyond, they are shuffled.
MOST_SPLIT = 100_000


@dataclass(frozen=True)
class Near:
    """|candidate - target| <= max(reach, share * target); an unknown value on either side is near every value."""

    column: str
    reach: float
    share: float = 0.0

    def __post_init__(self):
        if self.reach <= 0 or self.share < 0:
            raise ValueError("a reach is positive and a share is not negative")

    def radius(self, target: Column) -> Column:
        return F.greatest(F.lit(float(self.reach)), target * self.share)

    def holds(self, target: Column, candidate: Column) -> Column:
        return F.coalesce(F.abs(target - candidate) <= self.radius(target), F.lit(True))

    def bin(self, value: Column) -> Column:
        """Grows with the value, never falls."""
        even = F.floor(value / self.reach)
        if not self.share:
            return even
        knee = self.reach / self.share
        return F.when(value < knee, even).otherwise(ceil(knee / self.reach) + F.floor(F.log(value / knee) / log(1 + self.share)))

    def probes(self, target: Column) -> Column:
        r = self.radius(target)
        known = F.concat(F.sequence(self.bin(target - r), self.bin(target + r)), F.array(F.lit(UNKNOWN)))
        return F.when(target.isNull(), F.array(F.lit(ANY))).otherwise(known)

    def seen_from(self, candidate: Column) -> tuple[Column, Column]:
        """The first and last bin of targets whose reach may touch the candidate."""
        if self.share >= 1:
            return self.bin(F.least(candidate - self.reach, candidate / (1 + self.share))), F.lit(1 << 62)
        return self.bin(F.least(candidate - self.reach, candidate / (1 + self.share))) - 1, self.bin(F.greatest(candidate + self.reach, candidate / (1 - self.share))) + 1

    def lies_in(self, candidate: Column, any_too: bool) -> Column:
        own = F.coalesce(self.bin(candidate), F.lit(UNKNOWN))
        return F.array(own, F.lit(ANY)) if any_too else F.array(own)


def near_pairs(targets: DataFrame, pool: DataFrame, keys: list[str], near: list[Near], id_col: str = "listing_id", most: int = 20_000) -> DataFrame:
    """(target, candidate): structs of the rows of both tables with equal keys, different ids and values that are near in
    every dimension. A null key meets nothing. NaN counts as unknown."""
    clean = {n.column: F.when(F.isnan(F.col(n.column).cast("double")), None).otherwise(F.col(n.column).cast("double")) for n in near}
    named = {f"_v{i}": clean[n.column] for i, n in enumerate(near)}
    t = targets.select(*keys, F.struct(*targets.columns).alias("target"), *(v.alias(c) for c, v in named.items()))
    c = pool.select(*keys, F.struct(*pool.columns).alias("candidate"), *(v.alias(c) for c, v in named.items()))
    lacking = t.agg(*(F.coalesce(F.bool_or(F.col(f"_v{i}").isNull()), F.lit(False)) for i in range(len(near)))).first()
    for i, n in enumerate(near):
        t = t.withColumn(f"_c{i}", F.explode(n.probes(F.col(f"_v{i}"))))
        c = c.withColumn(f"_c{i}", F.explode(n.lies_in(F.col(f"_v{i}"), lacking[i])))
    cell = [*keys, *(f"_c{i}" for i in range(len(near)))]
    split = c.groupBy(*cell).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts")).where("_parts > 1").cache()
    try:
        many = split.count()
        side = F.broadcast(split) if many <= MOST_SPLIT else split
        if many:
            t = t.join(side, cell, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
            c = c.join(side, cell, "left").withColumn("_part", F.pmod(F.xxhash64(F.col(f"candidate.{id_col}")), F.coalesce("_parts", F.lit(1))).cast("int"))
            t, c, cell = t.drop("_parts"), c.drop("_parts"), [*cell, "_part"]
    finally:
        split.unpersist()
    values = [f"_v{i}" for i in range(len(near))]
    met = t.join(c.select(*cell, "candidate", *(F.col(v).alias(f"{v}c") for v in values)), cell)
    fits = F.col(f"target.{id_col}") != F.col(f"candidate.{id_col}")
    for i, n in enumerate(near):
        fits &= n.holds(F.col(f"_v{i}"), F.col(f"_v{i}c"))
    return met.where(fits).select("target", "candidate")


#: Comparisons that are held in memory at once.
AT_ONCE = 4 << 20


def near_medians(targets: DataFrame, pool: DataFrame, keys: list[str], near: list[Near], value: str, id_col: str, most: int = 4_000) -> DataFrame:
    """The targets that meet any row of near_pairs, with n, how many, and median, that of their values: no pair is written.
    A target lies in one cell, and a candidate is copied to the cells whose targets may reach it, at most one for each bin
    of values, so that what is shuffled grows with the rows and not with the pairs. Cells with many targets are split.
    id_col is a long. targets are read twice."""
    clean = {f"_v{i}": F.when(F.isnan(F.col(n.column).cast("double")), None).otherwise(F.col(n.column).cast("double")) for i, n in enumerate(near)}
    values, bins = list(clean), [f"_c{i}" for i in range(len(near))]
    own = targets.dropna(subset=keys).withColumns(clean).withColumns({b: F.coalesce(n.bin(F.col(v)), F.lit(ANY)) for b, n, v in zip(bins, near, values, strict=True)})
    cells = own.groupBy(*keys, *bins).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))
    cells = stored(cells.withColumn("_cell", F.monotonically_increasing_id()), "cells")
    part = F.pmod(F.xxhash64(id_col), F.col("_parts")).cast("int").alias("_part")
    t = own.join(cells, [*keys, *bins]).select("_cell", part, *targets.columns, *values)
    c = pool.select(*keys, F.col(id_col).alias("_id"), F.col(value).cast("double").alias("_value"), *(v.alias(k) for k, v in clean.items()))
    for i, n in enumerate(near):
        low, high = n.seen_from(F.col(f"_v{i}"))
        c = c.withColumns({f"_l{i}": low, f"_h{i}": high})
    reached = F.lit(True)
    for i in range(len(near)):
        at = F.col(f"_c{i}")
        reached &= F.col(f"_v{i}").isNull() | (at == ANY) | at.between(F.col(f"_l{i}"), F.col(f"_h{i}"))
    c = c.join(cells.withColumnRenamed("_cell", "_to"), keys).where(reached).select(F.col("_to").alias("_cell"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_id", "_value", *values)
    columns = targets.columns

    def meet(t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("_value", na_position="last")
        worth, place = c["_value"].to_numpy(), {k: i for i, k in enumerate(c["_id"])}
        theirs = [c[v].to_numpy(dtype=float) for v in values]
        n, median = np.zeros(len(t), dtype=np.int64), np.full(len(t), np.nan)
        step = max(1, AT_ONCE // max(1, len(c)))
        for at in range(0, len(t), step):
            some = t.iloc[at : at + step]
            fits = np.ones((len(some), len(c)), dtype=bool)
            for b, v, other in zip(near, values, theirs, strict=True):
                mine = some[v].to_numpy(dtype=float)[:, None]
                fits &= ~(np.abs(mine - other) > np.fmax(float(b.reach), mine * b.share))
            for i, k in enumerate(some[id_col]):
                if k in place:
                    fits[i, place[k]] = False
                met = worth[fits[i]]
                n[at + i], known = len(met), len(met) - np.isnan(met).sum()
                if known:
                    median[at + i] = met[(known - 1) // 2] * 0.5 + met[known // 2] * 0.5
        return t[columns].assign(n=n, median=median)[n > 0]

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in targets.schema.fields)
    out = t.groupBy("_cell", "_part").cogroup(c.groupBy("_cell", "_part")).applyInPandas(meet, f"{kind}, n long, median double")
    return out.withColumn("median", F.when(~F.isnan("median"), F.col("median")))
