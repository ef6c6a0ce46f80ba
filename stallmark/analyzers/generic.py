"""Anything else; electronics differ by name only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallmark.analyzers.base import Listing, analysis, present, unknown_or_equal
from stallmark.analyzers.gpu import WARRANTY
from stallmark.functions.text import contains_defect, first_term, match, model_signature, normalize_title, once

#: Names, patterns and notices, lists tried in their order.
BRANDS = ["apple", "samsung", "sony", "lg", "dell", "lenovo", "asus", "acer", "motorola", "xiaomi"]
AS_NEW, REFURBISHED, USED = "novo|lacrado|sem uso", "recondicionado", "usado"
SAYS_DEFECT = "O anúncio menciona defeito ou avaria"
SAYS_SOUND = "Nenhum defeito explícito foi identificado no texto"
STOP_WORDS = ["aparelho", "caixa", "com", "estado", "excelente", "lacrado", "novo", "produto", "seminovo", "usado", "venda", "vendo"]


def infer_model(title: Column, brand: Column) -> Column:
    """The first five words of the title that are neither the brand nor fill words."""
    own = F.coalesce(F.split(brand, " "), F.array().cast("array<string>"))
    words = once(own, lambda own: F.filter(F.split(normalize_title(title), " "), lambda t: ~t.isin(STOP_WORDS) & ~F.array_contains(own, t)))
    return once(words, lambda words: F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 5), " ")))


class GenericAnalyzer:
    def __init__(self, category: str = "generic"):
        self.category = category

    def extract(self, listing: Listing) -> Column:
        return once(listing.text, lambda text: self._fields(listing, text))

    def _fields(self, listing: Listing, text: Column) -> Column:
        brand, defect = first_term(text, BRANDS), contains_defect(text)
        condition = F.when(defect, "damaged").when(text.rlike(AS_NEW), "new").when(text.rlike(REFURBISHED), "refurbished").when(text.rlike(USED), "used").otherwise("unknown")
        return F.struct(
            brand.alias("brand"),
            infer_model(listing.title, brand).alias("model"),
            condition.alias("condition"),
            F.trim(match(text, WARRANTY)).alias("warranty"),
            present((defect, SAYS_DEFECT)).alias("defects"),
            F.array().cast("array<string>").alias("features"),
            F.when(brand.isNotNull(), 0.65).otherwise(0.4).alias("extraction_confidence"),
        )

    def key(self, data: Column) -> Column:
        return model_signature(data["model"])

    def comparable(self, a: Column, b: Column) -> Column:
        return unknown_or_equal(a["brand"], b["brand"])

    def analyze(self, data: Column) -> Column:
        risks = data["defects"]
        gains = present((F.size(risks) == 0, SAYS_SOUND))
        return analysis(F.when(data["extraction_confidence"] >= 0.6, 9).otherwise(5), F.when(F.size(risks) > 0, 3).otherwise(11), gains, risks)
