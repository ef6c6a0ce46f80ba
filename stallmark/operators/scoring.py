"""Deterministic scores of 0 to 90, a model's share on top, and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallmark.functions.numbers import clamp, percentage_difference, round_half_up

#: Fixed value: what an analysis without a model says of itself.
FALLBACK_REASON = "Score calculado por regras determinísticas; análise LLM não executada."


def price_vs_market(difference: Column) -> Column:
    return F.when(difference.isNull(), 0).when(difference <= -25, 35).when(difference <= -15, 30).when(difference <= -8, 24).when(difference <= 0, 17).when(difference <= 10, 8).otherwise(0)


def absolute_price(price: Column, budget: Column) -> Column:
    return F.when(price.isNull() | budget.isNull(), 5).when(price <= budget * 0.8, 10).when(price <= budget, 7).otherwise(0)


def listing_quality(description: Column, images: Column, attributes: Column) -> Column:
    """Long description 4, three pictures 3 and fewer 1, any attribute 3."""
    text = F.when(F.length(F.coalesce(description, F.lit(""))) >= 80, 4).otherwise(0)
    return text + F.when(images >= 3, 3).otherwise(1) + F.when(attributes > 0, 3).otherwise(0)


def confidence_score(confidence: Column) -> Column:
    return F.when(confidence == "high", 5).when(confidence == "medium", 3).otherwise(1)


def deterministic_score(price: Column, median: Column, confidence: Column, budget: Column, description: Column, images: Column, attributes: Column, features: Column, risks: Column) -> Column:
    """(score, components, difference_percent); images and attributes are their numbers."""
    difference = percentage_difference(price, median)
    parts = {
        "price_vs_market": price_vs_market(difference),
        "absolute_price": absolute_price(price, budget),
        "features": clamp(features, 0, 15),
        "listing_quality": listing_quality(description, images, attributes),
        "risks": clamp(risks, 0, 15),
        "statistical_confidence": confidence_score(confidence),
    }
    total = round_half_up(sum((p.cast("double") for p in parts.values()), F.lit(0.0))).cast("int")
    return F.struct(total.alias("score"), F.struct(*(p.cast("int").alias(n) for n, p in parts.items())).alias("components"), difference.alias("difference_percent"))


def combine_scores(deterministic: Column, model: Column) -> Column:
    """A tenth of the model's score, at most 10 points, on top."""
    return round_half_up(clamp(deterministic.cast("double") + clamp(model.cast("double") / 10, 0, 10), 0, 100)).cast("int")


def verdict(score: Column) -> Column:
    return F.when(score >= 85, "excellent_deal").when(score >= 70, "good").when(score >= 50, "fair").when(score >= 30, "weak").otherwise("bad")


def merged_points(own: Column, model: Column, most: int = 10) -> Column:
    """The rules' points first, then the model's that are new, at most ten."""
    return F.slice(F.array_distinct(F.concat(own, F.coalesce(model, F.array().cast("array<string>")))), 1, most)
