"""Declared schemas of the tables that the operators exchange. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampNTZType, VariantType

SOURCES = ["facebook", "olx", "mercadolivre"]
VERDICTS = ["bad", "weak", "fair", "good", "excellent_deal"]
STATUSES = ["pending", "sending", "sent", "failed"]


def _fields(**kinds) -> list[StructField]:
    return [StructField(k, v, True) for k, v in kinds.items()]


_S, _D, _T, _B, _I, _L, _A = StringType(), DoubleType(), TimestampNTZType(), BooleanType(), IntegerType(), LongType(), ArrayType(StringType())

SUMMARY = StructType(_fields(seq=_L, source=_S, external_id=_S, title=_S, price=_D, currency=_S, location=_S, url=_S, image_url=_S))
DETAILS = StructType([*SUMMARY.fields, *_fields(description=_S, seller_name=_S, images=_A, attributes=MapType(_S, _S), published_at=_T, raw_data=VariantType())])
LISTING = StructType(
    _fields(
        listing_id=_S, source=_S, category=_S, external_id=_S, fingerprint=_S, title=_S, description=_S, price=_D, currency=_S, location=_S, seller_name=_S, url=_S, normalized_url=_S, image_url=_S,
        images=_A, attributes=MapType(_S, _S), published_at=_T, first_seen_at=_T, last_seen_at=_T, last_checked_at=_T, active=_B, suppressed_at=_T, content_hash=_S,
    )
)
SEARCH = StructType(
    _fields(
        search_id=_S, name=_S, query=_S, category=_S, providers=_A, min_price=_D, max_price=_D, min_year=_I, max_year=_I, location=_S, radius_km=_I, minimum_score=_I, interval_minutes=_I, forbidden_words=_A,
        active=_B, last_run_at=_T, created_at=_T, run_lease_id=_S, run_lease_expires_at=_T,
    )
)
PRICE_HISTORY = StructType(_fields(listing_id=_S, observed_at=_T, price=_D))
MATCH = StructType([*_fields(a=_S, b=_S, confidence=_D), StructField("reasons", _A)])
ANALYSIS = StructType(
    _fields(
        analysis_id=_S, listing_id=_S, search_id=_S, input_hash=_S, score=_I, deterministic_score=_I, verdict=_S, market_median_price=_D, price_difference_percent=_D, advantages=_A, risks=_A, reason=_S,
        analysis_model=_S, llm_attempted_at=_T, created_at=_T,
    )
)
NOTIFICATION = StructType(_fields(notification_id=_S, listing_id=_S, search_id=_S, analysis_id=_S, channel=_S, status=_S, attempts=_I, claimed_at=_T, sent_at=_T, last_error=_S))
