"""Projections for people: recent listings, searches, deal notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallmark.functions.text import bullets, escape_html, money, truncate
from stallmark.functions.urls import short_url
from stallmark.operators.dedup import keep_first


def latest_analysis(analyses: DataFrame) -> DataFrame:
    """The newest analysis of each listing (ties: the larger id)."""
    return keep_first(analyses, ["listing_id"], [F.col("created_at").desc(), F.col("analysis_id").desc()])


def recent_listings(listings: DataFrame, analyses: DataFrame, limit: int = 30) -> DataFrame:
    """The newest live listings, each with its newest analysis if it has one."""
    if not 1 <= limit <= 200:
        raise ValueError("a report shows 1 to 200 listings")
    top = listings.where("suppressed_at is null").orderBy(F.col("last_seen_at").desc(), "listing_id").limit(limit)
    a = latest_analysis(analyses).select("listing_id", "score", "verdict")
    out = top.join(a, "listing_id", "left").orderBy(F.col("last_seen_at").desc(), "listing_id")
    return out.select("listing_id", "source", "title", "price", "location", "last_seen_at", "score", "verdict")


def search_list(searches: DataFrame) -> DataFrame:
    """Searches, newest first, with their sources joined and their ranges as text."""
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    span = lambda a, b: F.concat(dash(a), F.lit("–"), dash(b))
    return searches.orderBy(F.col("created_at").desc(), "search_id").select("search_id", "name", "query", "category", F.array_join("providers", ", ").alias("providers"), span("min_price", "max_price").alias("price"), span("min_year", "max_year").alias("years"), "minimum_score", "interval_minutes", "active")


def criteria(search: Column) -> Column:
    """What a search asks for, without what only runs it; arrays sorted."""
    plain = ["query", "category", "min_price", "max_price", "min_year", "max_year", "location", "radius_km", "minimum_score"]
    return F.struct(*(search[n].alias(n) for n in plain), F.array_sort(search["providers"]).alias("providers"), F.array_sort(search["forbidden_words"]).alias("forbidden_words"))


def deal_notice(listing: Column, score: Column, advantages: Column, risks: Column, medians: Column, combined: Column, difference: Column, sources: list[str]) -> Column:
    """The text of a notice. medians: map of source to median; combined: struct of median_price, sample_size and
    confidence."""
    currency = listing["currency"]
    bold = lambda c: F.concat(F.lit("<b>"), c, F.lit("</b>"))
    lines = F.filter(F.array(*(F.when(F.try_element_at(medians, F.lit(s)).isNotNull(), F.concat(F.lit(f"{s}: "), bold(money(F.try_element_at(medians, F.lit(s)), currency)))) for s in sources)), lambda x: x.isNotNull())
    place = F.coalesce(F.concat(F.lit(" — "), escape_html(truncate(listing["location"], 160))), F.lit(""))
    url = short_url(listing["source"], listing["url"])
    link = F.coalesce(F.concat(F.lit('<a href="'), escape_html(url), F.lit('">Abrir anúncio</a>')), F.lit("Link do anúncio indisponível"))
    far = F.when(difference.isNull(), "n/d").otherwise(F.concat(F.format_string("%.1f", difference), F.lit("%")))
    head = F.array(F.concat(F.lit("🔥 <b>OPORTUNIDADE — "), score.cast("string"), F.lit("/100</b>")), F.lit(""), escape_html(truncate(listing["title"], 240)), bold(money(listing["price"], currency)), F.lit(""), F.concat(F.lit("📍 "), escape_html(F.upper(listing["source"])), place), F.lit(""), F.lit("📊 <b>PREÇO DE MERCADO</b>"))
    tail = F.array(
        F.concat(F.lit("Mediana combinada: "), bold(money(combined["median_price"], currency))),
        F.concat(F.lit("Amostra: "), combined["sample_size"].cast("string"), F.lit(" ("), combined["confidence"], F.lit(")")),
        F.concat(F.lit("Diferença: "), bold(far)),
        F.lit(""), F.lit("✅ <b>Pontos positivos</b>"), bullets(advantages, "Nenhum ponto adicional informado"),
        F.lit(""), F.lit("⚠️ <b>Verificar</b>"), bullets(risks, "Verificar condição e procedência"),
        F.lit(""), link,
    )
    return F.array_join(F.concat(head, lines, tail), "\n")
