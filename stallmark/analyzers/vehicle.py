"""Cars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallmark.analyzers.base import Listing, analysis, known, present, reading
from stallmark.functions.numbers import parse_mileage
from stallmark.functions.text import contains_defect, first_term, match, once

#: Names, patterns and notices, lists tried in their order.
BRANDS = ["bmw", "chevrolet", "fiat", "ford", "honda", "hyundai", "jeep", "kia", "mercedes benz", "nissan", "peugeot", "renault", "toyota", "volkswagen", "volvo"]
MODELS = ["t cross", "renegade", "compass", "corolla", "cruze", "civic", "creta", "amarok", "ranger", "hilux", "golf", "320i", "polo", "onix", "hb20", "nivus", "gol"]
TRANSMISSIONS = [(r"\bcvt\b", "cvt"), ("automatizad|dualogi|i motion", "automated"), ("automatic", "automatic"), ("manual", "manual")]
FUELS = [("hibrid", "hybrid"), ("eletric", "electric"), ("diesel", "diesel"), ("flex", "flex"), ("etanol|alcool", "ethanol"), ("gasolina", "gasoline")]
NO_AUCTION = "nunca (?:foi )?de leilao|nao (?:e|foi) de leilao|sem leilao"
NO_ACCIDENT = "nunca (?:foi )?batid|sem sinistro|nao (?:e|foi) sinistrad"
YEAR = r"\b(19[5-9]\d|20[0-3]\d)\b"
MILEAGE = r"([\d.,]+\s*(?:mil|k)?\s*(?:km|quil[oô]metros?))"
AUCTION, ACCIDENT = "leilao", "sinistro|batid|colisao"
TRADE, FINANCING = "aceito troca|troco", "financi"
UNUSED = r"\b(?:0\s*km|zero\s*km)\b"
SAYS_AUCTION = "Há menção a leilão"
SAYS_NO_AUCTION = "Ausência de leilão é apenas alegação do vendedor; consulte laudo e histórico"
SAYS_ACCIDENT = "Há menção a sinistro ou colisão"
SAYS_NO_ACCIDENT = "Ausência de sinistro é apenas alegação do vendedor; consulte laudo e histórico"
SAYS_DAMAGED = "O anúncio menciona problema ou avaria"
SAYS_MAINTENANCE = "O anúncio menciona manutenção ou revisões"
MAINTENANCE = r"\b(?:revisad[oa]|revisoes? (?:feitas?|em dia)|manutencao (?:feita|em dia)|oleo trocado)\b"


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: str = "unknown") -> Column:
    return F.coalesce(*(F.when(text.rlike(p), F.lit(v)) for p, v in rules), F.lit(otherwise))


class VehicleAnalyzer:
    category = "vehicle"

    def extract(self, listing: Listing) -> Column:
        return reading(listing, self._fields)

    def _fields(self, text: Column, raw: Column) -> Column:
        facts = F.struct(first_term(text, BRANDS).alias("brand"), first_term(text, MODELS).alias("model"), match(text, YEAR).cast("int").alias("year"), parse_mileage(match(raw, MILEAGE)).alias("mileage"))
        return once(facts, lambda facts: self._data(text, *(facts[c] for c in ("brand", "model", "year", "mileage"))))

    def _data(self, text: Column, brand: Column, model: Column, year: Column, mileage: Column) -> Column:
        return F.struct(
            brand.alias("brand"),
            model.alias("model"),
            F.lit(None).cast("string").alias("version"),
            year.alias("year"),
            mileage.alias("mileage"),
            first_rule(text, TRANSMISSIONS).alias("transmission"),
            first_rule(text, FUELS).alias("fuel"),
            text.rlike(MAINTENANCE).alias("maintenance_mentioned"),
            text.rlike(AUCTION).alias("auction_mentioned"),
            text.rlike(NO_AUCTION).alias("seller_claims_no_auction"),
            text.rlike(ACCIDENT).alias("accident_mentioned"),
            text.rlike(NO_ACCIDENT).alias("seller_claims_no_accident"),
            text.rlike(TRADE).alias("trade_accepted"),
            text.rlike(FINANCING).alias("financing_available"),
            F.when(contains_defect(text), "damaged").when(text.rlike(UNUSED), "new").otherwise("used").alias("condition"),
            (F.lit(0.35) + known(brand, model, year, mileage) * F.lit(0.14)).alias("extraction_confidence"),
        )

    def key(self, data: Column) -> Column:
        return F.concat(data["brand"], F.lit("|"), data["model"])

    def comparable(self, a: Column, b: Column) -> Column:
        years = F.coalesce(F.abs(a["year"] - b["year"]) <= 2, F.lit(True))
        far = F.abs(a["mileage"] - b["mileage"])
        return years & F.coalesce(far <= F.greatest(F.lit(30000.0), a["mileage"] * 0.35), F.lit(True))

    def analyze(self, data: Column) -> Column:
        risks = present(
            (data["auction_mentioned"] & ~data["seller_claims_no_auction"], SAYS_AUCTION),
            (data["seller_claims_no_auction"], SAYS_NO_AUCTION),
            (data["accident_mentioned"] & ~data["seller_claims_no_accident"], SAYS_ACCIDENT),
            (data["seller_claims_no_accident"], SAYS_NO_ACCIDENT),
            (data["condition"] == "damaged", SAYS_DAMAGED),
        )
        gains = present((data["maintenance_mentioned"], SAYS_MAINTENANCE))
        return analysis(F.least(F.lit(15), 8 + F.size(gains) * 3), F.greatest(F.lit(0), 14 - F.size(risks) * 3), gains, risks)
