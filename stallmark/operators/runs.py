"""What a run counts while it runs: observations in the flow, without a second pass or a stage of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stallmark.functions.urls import is_marketplace_url
from stallmark.operators.dedup import deduplicate_listings
from stallmark.operators.validation import reasons, summary_reasons, trimmed_summary

#: Why a run turns a summary away.
REASONS = ["source", "external_id", "title", "price", "currency", "location", "url", "image_url", "provider", "host"]
COUNTERS = "stage string, counter string, n long"


class Counters:
    """Counts of stages. A stage's counts are there once the flow has run to its end in an action; one action, one count."""

    def __init__(self):
        self.stages: list[tuple[str, Observation]] = []

    def at(self, df: DataFrame, stage: str, **conditions: Column) -> DataFrame:
        """df, whose rows are counted as they pass: all of them, and those for which each condition holds."""
        seen = Observation(stage)
        self.stages.append((stage, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(n) for n, c in conditions.items()))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(stage, counter, n) for stage, seen in self.stages for counter, n in seen.get.items()]
        return spark.createDataFrame(rows, COUNTERS)


def counted_run(df: DataFrame, provider: Column, analyse, counters: Counters) -> DataFrame:
    """What a search's run makes of the arrivals of its providers: summaries that are turned away are counted by reason, what
    is left is deduplicated by source (discovered), and analyse(rows) gives the analysed ones."""
    own = reasons(provider=F.col("source") == provider, host=is_marketplace_url(F.col("source"), F.trim("url")))
    tagged = df.withColumn("_reasons", F.concat(summary_reasons(), own))
    tagged = counters.at(tagged, "received", rejected=F.size("_reasons") > 0, **{f"rejected_{r}": F.array_contains("_reasons", r) for r in REASONS})
    found = deduplicate_listings(trimmed_summary(tagged.where(F.size("_reasons") == 0).drop("_reasons")))
    return counters.at(analyse(counters.at(found, "discovered")), "analysed")
