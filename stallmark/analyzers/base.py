"""What an analyzer is: extract (scalar), comparable (join predicate) and analyze (scalar), all as Columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallmark.functions.text import listing_text, once


@dataclass(frozen=True)
class Listing:
    """The columns an extraction reads; text is the normalized whole, raw the lower-cased one."""

    title: Column
    description: Column
    attributes: Column

    @property
    def text(self) -> Column:
        return listing_text(self.title, self.description, self.attributes)

    @property
    def raw(self) -> Column:
        values = F.coalesce(F.array_join(F.map_values(self.attributes), " "), F.lit(""))
        return F.lower(F.concat_ws(" ", self.title, F.coalesce(self.description, F.lit("")), values))


def reading(listing: Listing, use: Callable[[Column, Column], Column]) -> Column:
    """use(text, raw) of a listing, each made once for all fields."""
    return once(F.struct(listing.text.alias("text"), listing.raw.alias("raw")), lambda x: use(x["text"], x["raw"]))


class Analyzer(Protocol):
    category: str

    def extract(self, listing: Listing) -> Column:
        """A struct: the category's fields and extraction_confidence."""

    def key(self, data: Column) -> Column:
        """What two comparable listings have in common; null compares with nothing."""

    def comparable(self, a: Column, b: Column) -> Column:
        """Whether b is comparable to a, given equal keys; not symmetric everywhere."""

    def analyze(self, data: Column) -> Column:
        """A struct: feature_score, risk_score, advantages, risks."""


def present(*items: tuple[Column, str]) -> Column:
    """The texts whose condition holds, in order."""
    every = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in items))
    return F.filter(every, lambda x: x.isNotNull())


def known(*values: Column) -> Column:
    return sum((v.isNotNull().cast("int") for v in values), F.lit(0))


def unknown_or_equal(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def analysis(features: Column, risk: Column, advantages: Column, risks: Column) -> Column:
    return F.struct(features.cast("int").alias("feature_score"), risk.cast("int").alias("risk_score"), advantages.alias("advantages"), risks.alias("risks"))
