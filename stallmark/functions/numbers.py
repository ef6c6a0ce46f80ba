"""Prices, mileages and arithmetic over Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallmark.functions.text import once


def parse_price(text: Column) -> Column:
    """Brazilian price text. With a comma, points part thousands and the first comma is the decimal point; points
    before groups of three digits part thousands. What is no number, or negative, is null."""
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?U)\s", ""), r"(?i)R\$", ""), r"[^\d,.-]", "")
    grouped = F.regexp_replace(digits, r"\.", "")
    comma = F.regexp_replace(grouped, r"^([^,]*),", "$1.")
    plain = F.when(F.contains(digits, F.lit(",")), comma).when(digits.rlike(r"^-?\d{1,3}(\.\d{3})+$"), grouped).otherwise(digits)
    value = F.when(plain.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))
    return F.when(value >= 0, value)


def valid_price(value: Column) -> Column:
    """A numeric price that is finite and not negative, else null."""
    return F.when((value >= 0) & (value < float("inf")), value.cast("double"))


def round_half_up(value: Column) -> Column:
    """floor(x + 0.5): halves go up, below zero too."""
    return F.floor(value + 0.5)


def parse_mileage(text: Column) -> Column:
    """Kilometres as a whole number; `mil` or `k` after a number under 1,000 is a thousand."""
    return once(F.regexp_replace(F.lower(text), r"(?U)\s", ""), lambda flat: once(F.nullif(F.regexp_extract(flat, r"([\d.,]+)", 1), F.lit("")), lambda found: _mileage(flat, found)))


def _mileage(flat: Column, found: Column) -> Column:
    both = F.contains(found, F.lit(",")) & F.contains(found, F.lit("."))
    bare = F.regexp_replace(found, r"\.", "")
    point = lambda c: F.regexp_replace(c, r"^([^,]*),", "$1.")
    plain = F.when(both, point(bare)).when(found.rlike(r"^\d{1,3}(\.\d{3})+$"), bare).otherwise(point(found))
    number = once(plain, lambda plain: F.when(plain.rlike(r"^(\d+\.?\d*|\.\d+)$"), plain.try_cast("double")))
    many = flat.rlike(r"^[\d.,]+(?:mil|k)(?:km)?$")
    return once(number, lambda value: round_half_up(F.when((value < 1000) & many, value * 1000).otherwise(value)).cast("long"))


def percentage_difference(value: Column, reference: Column) -> Column:
    """100 * (value - reference) / reference; null where the reference is null or 0."""
    return (value - reference) / F.nullif(reference, F.lit(0.0)) * 100


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def optional_number(text: Column) -> Column:
    """A number, or null for nothing; text that is no number is an error of its own (see operators.validation)."""
    return F.trim(text).try_cast("double")


def plain_number(value: Column) -> Column:
    """Digits of a price without exponent or needless zeros, for hashes: 69900.0 is 69900, 0.50 is 0.5."""
    text = value.cast("decimal(24,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
