"""Row checks. Each gives an array of reasons; a row is valid if it is empty. Invalid rows are kept apart, not dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallmark.analyzers.registry import CATEGORIES
from stallmark.functions.text import made_once
from stallmark.functions.urls import is_http_url, is_marketplace_url
from stallmark.schema import SOURCES, STATUSES, VERDICTS


def reasons(**checks: Column) -> Column:
    """Names of the checks that do not hold; a check on nulls counts as failed."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda r: r.isNotNull())


def optional(value: Column, ok: Column) -> Column:
    return value.isNull() | ok


def text_between(value: Column, low: int, high: int) -> Column:
    return F.length(F.trim(value)).between(low, high)


def summary_reasons(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return reasons(
        source=c("source").isin(SOURCES),
        external_id=optional(c("external_id"), text_between(c("external_id"), 1, 300)),
        title=text_between(c("title"), 1, 1000),
        price=optional(c("price"), (c("price") >= 0) & (c("price") < float("inf"))),
        currency=optional(c("currency"), F.trim(c("currency")).rlike("^[A-Za-z]{3}$")),
        location=optional(c("location"), text_between(c("location"), 1, 500)),
        url=text_between(c("url"), 1, 4096) & is_http_url(F.trim(c("url"))),
        image_url=optional(c("image_url"), (F.length(F.trim(c("image_url"))) <= 4096) & is_http_url(F.trim(c("image_url")))),
    )


def details_reasons() -> Column:
    extra = reasons(
        description=optional(F.col("description"), F.length("description") <= 100_000),
        seller_name=optional(F.col("seller_name"), F.length(F.trim("seller_name")) <= 500),
        images=(F.size("images") <= 50) & F.forall("images", is_http_url),
        attributes=F.size(F.map_keys("attributes")) <= 200,
    )
    return F.concat(summary_reasons(), extra)


def search_reasons() -> Column:
    c = F.col
    money = lambda x: optional(x, x.between(0, 999_999_999_999.99))
    year = lambda x: optional(x, x.between(1900, 2200))
    words = F.transform("forbidden_words", lambda w: F.length(F.trim(w)))
    return reasons(
        name=text_between(c("name"), 1, 120),
        query=text_between(c("query"), 1, 300),
        category=c("category").isin(CATEGORIES),
        providers=(F.size("providers") >= 1) & F.forall("providers", lambda p: p.isin(SOURCES)),
        min_price=money(c("min_price")) & optional(c("min_price"), c("max_price").isNull() | (c("min_price") <= c("max_price"))),
        max_price=money(c("max_price")),
        min_year=year(c("min_year")) & optional(c("min_year"), c("max_year").isNull() | (c("min_year") <= c("max_year"))),
        max_year=year(c("max_year")),
        location=optional(c("location"), text_between(c("location"), 1, 200)),
        radius_km=optional(c("radius_km"), c("radius_km").between(1, 2000) & c("location").isNotNull()),
        minimum_score=c("minimum_score").between(0, 100),
        interval_minutes=c("interval_minutes").between(1, 525_600),
        forbidden_words=(F.size("forbidden_words") <= 50) & F.forall(words, lambda n: n.between(1, 100)),
    )


def normal_searches(df: DataFrame) -> DataFrame:
    """Valid definitions as they are stored: text trimmed, providers and forbidden words without repeats, in order."""
    words = F.array_distinct(F.transform("forbidden_words", lambda w: F.trim(w)))
    return df.withColumns({"name": F.trim("name"), "query": F.trim("query"), "location": F.trim("location"), "providers": F.array_distinct("providers"), "forbidden_words": words})


def trimmed_summary(df: DataFrame) -> DataFrame:
    """Text fields trimmed and the currency in capitals, as valid rows are stored."""
    out = {n: F.trim(n) for n in ("external_id", "title", "location", "url", "image_url") if n in df.columns}
    return df.withColumns(out | {"currency": F.upper(F.trim("currency"))})


def split_valid(df: DataFrame, why: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reasons)."""
    checked = df.withColumn("reasons", made_once(why))
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def gate_reasons(provider: Column) -> Column:
    """What speaks against taking a row from a provider."""
    return F.concat(summary_reasons(), reasons(provider=F.col("source") == provider, host=is_marketplace_url(F.col("source"), F.trim("url"))))


def gate(df: DataFrame, provider: Column) -> tuple[DataFrame, DataFrame]:
    """What a run takes from a provider: well formed, of that provider, and under the source's own hosts."""
    good, bad = split_valid(df, gate_reasons(provider))
    return trimmed_summary(good), bad


def matching_details(summaries: DataFrame, details: DataFrame, on: str = "seq") -> DataFrame:
    """Details that belong to their summary: same source, same id unless the summary has none, own host."""
    s = summaries.select(on, F.col("source").alias("_source"), F.col("external_id").alias("_id"))
    same = (F.col("source") == F.col("_source")) & (F.col("_id").isNull() | (F.col("external_id") == F.col("_id")))
    return details.join(s, on).where(same & is_marketplace_url(F.col("source"), F.col("url"))).drop("_source", "_id")


def number_or_error(text: Column) -> Column:
    """(value, error): nothing gives null; text that is no finite number is an error."""
    value = F.trim(text).try_cast("double")
    bad = (F.trim(text) != "") & (value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")))
    return F.struct(F.when(~F.coalesce(bad, F.lit(False)), value).alias("value"), F.coalesce(bad, F.lit(False)).alias("error"))


def category_data(json: Column, schema: str) -> Column:
    """Stored fields of a category by its declared schema: unknown keys go, a misfit gives null."""
    parsed = F.from_json(json, schema, {"mode": "PERMISSIVE"})
    return F.when(F.try_parse_json(json).isNotNull() & parsed.isNotNull(), parsed)


def table_checks(searches: DataFrame, analyses: DataFrame, matches: DataFrame, notifications: DataFrame) -> DataFrame:
    """(rule, broken): how many rows break each standing rule of the stored tables."""
    c = F.col
    lease = c("run_lease_id").isNull() == c("run_lease_expires_at").isNull()
    sent = ((c("status") == "sent") == c("sent_at").isNotNull()) & ((c("status") != "sending") | c("claimed_at").isNotNull())
    rules = [
        (searches, "search_definition", F.size(search_reasons()) == 0),
        (searches, "search_lease", lease),
        (analyses, "analysis_score", c("score").between(0, 100) & c("deterministic_score").between(0, 90)),
        (analyses, "analysis_verdict", c("verdict").isin(VERDICTS)),
        (matches, "match_pair", (c("a") < c("b")) & c("confidence").between(0, 1)),
        (notifications, "notification_status", c("status").isin(STATUSES) & sent),
    ]
    out = None
    for df, name, ok in rules:
        row = df.agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("broken")).select(F.lit(name).alias("rule"), "broken")
        out = row if out is None else out.unionByName(row)
    return out


def clean_legacy_searches(df: DataFrame) -> DataFrame:
    """Old rows made to fit: text trimmed to null or cut, numbers out of range nulled or clamped, inverted ranges
    swapped, arrays distinct and sorted."""
    c = F.col
    money = lambda n: F.when(c(n).between(0, 999_999_999_999.99), c(n))
    year = lambda n: F.when(c(n).between(1900, 2200), c(n))
    words = F.array_sort(F.array_distinct(F.filter(F.transform("forbidden_words", lambda w: F.left(F.trim(w), F.lit(100))), lambda w: w != "")))
    out = df.withColumns(
        {
            "name": F.left(F.coalesce(F.nullif(F.trim("name"), F.lit("")), c("search_id")), F.lit(120)),
            "location": F.left(F.nullif(F.trim("location"), F.lit("")), F.lit(200)),
            "min_price": money("min_price"), "max_price": money("max_price"), "min_year": year("min_year"), "max_year": year("max_year"),
            "minimum_score": F.least(F.lit(100), F.greatest(F.lit(0), c("minimum_score"))),
            "interval_minutes": F.least(F.lit(525_600), F.greatest(F.lit(1), c("interval_minutes"))),
            "forbidden_words": F.slice(words, 1, 50),
        }
    )
    out = out.withColumns({"min_price": F.when(c("min_price").isNotNull(), F.least("min_price", F.coalesce("max_price", "min_price"))), "max_price": F.when(c("max_price").isNotNull(), F.greatest("max_price", F.coalesce("min_price", "max_price"))), "_lo": c("min_year"), "_hi": c("max_year")})
    out = out.withColumns({"min_year": F.when(c("_lo").isNotNull(), F.least("_lo", F.coalesce("_hi", "_lo"))), "max_year": F.when(c("_hi").isNotNull(), F.greatest("_hi", F.coalesce("_lo", "_hi")))}).drop("_lo", "_hi")
    return out.withColumn("radius_km", F.when(c("location").isNotNull() & c("radius_km").between(1, 2000), c("radius_km")))
