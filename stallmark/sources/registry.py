"""Providers: named readers of captured batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmark.operators.dedup import deduplicate_listings
from stallmark.operators.validation import gate
from stallmark.sources.parsers import within_prices

Reader = Callable[[SparkSession, "Criteria"], DataFrame]


@dataclass(frozen=True)
class Criteria:
    """What a search asks of a provider. limit is at most 200."""

    query: str
    min_price: float | None = None
    max_price: float | None = None
    location: str | None = None
    radius_km: int | None = None
    limit: int = 50

    def __post_init__(self):
        if not self.query.strip() or not 1 <= self.limit <= 200:
            raise ValueError("a search needs a query and a limit of 1 to 200")


@dataclass
class ProviderRegistry:
    """Readers by source name. A second reader of a name is refused, a missing one is an error. Some providers' sites know
    a range of prices and their readers give only what is in it; of the others, `priced`, the range is asked here."""

    readers: dict[str, Reader] = field(default_factory=dict)
    priced: set[str] = field(default_factory=set)

    def register(self, name: str, reader: Reader, filter_prices: bool = False) -> None:
        if name in self.readers:
            raise ValueError(f"a provider {name} is registered")
        self.readers[name] = reader
        if filter_prices:
            self.priced.add(name)

    def get(self, name: str) -> Reader:
        if name not in self.readers:
            raise KeyError(f"no provider {name}")
        return self.readers[name]

    def has(self, name: str) -> bool:
        return name in self.readers

    def list(self) -> list[str]:
        return sorted(self.readers)

    def close(self) -> None:
        self.readers.clear()
        self.priced.clear()

    def search(self, spark: SparkSession, name: str, criteria: Criteria) -> tuple[DataFrame, DataFrame]:
        """(summaries, rejected) of one provider: checked, deduplicated (the first arrival of an identity stands for it, also
        where its price is out of range), then held against the range of prices where the site does not do that (no price
        is within every range), and only then limited, in order of arrival."""
        good, bad = gate(self.get(name)(spark, criteria), F.lit(name))
        rows = deduplicate_listings(good)
        if name in self.priced:
            rows = within_prices(rows, criteria.min_price, criteria.max_price)
        return rows.orderBy("seq").limit(criteria.limit), bad


def paged_items(df: DataFrame, item_schema: str, page: int = 50, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of API pages (keys of a search, offset, body as JSON with results and paging.total) as items with seq = their
    place. Pages of a search from its first empty one on, or past its total, give nothing."""
    body = F.from_json("body", f"results array<{item_schema}>, paging struct<total:bigint>")
    rows = df.withColumn("b", body)
    empty = F.min(F.when(F.size("b.results") == 0, F.col("offset")))
    ends = rows.groupBy(*keys).agg(F.least(empty, F.max("b.paging.total")).alias("end"))
    kept = rows.join(ends, list(keys)) if keys else rows.crossJoin(F.broadcast(ends))
    items = kept.where(F.coalesce(F.col("offset") < F.col("end"), F.lit(True))).select(*keys, "offset", F.posexplode(F.slice("b.results", 1, page)).alias("at", "item"))
    return items.select(*keys, (F.col("offset") + F.col("at")).alias("seq"), "item.*")
