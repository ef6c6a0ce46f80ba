"""Graphics cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallmark.analyzers.base import Listing, analysis, present, unknown_or_equal
from stallmark.functions.text import contains_defect, first_term, match, once

#: Names, patterns and notices, lists tried in their order.
BOARD_BRANDS = ["asus", "msi", "gigabyte", "galax", "zotac", "evga", "palit", "pny", "sapphire", "powercolor", "xfx"]
NO_MINING = "nunca (?:foi )?usad[ao] (?:em|para) mineracao|nao (?:foi )?usad[ao] (?:em|para) mineracao|sem mineracao"
GTX_NUMBERS = "^(?:10(?:50|60|70|80)|16(?:30|50|60))$"
RTX_NUMBERS = "^(?:20(?:50|60|70|80)|[3-9]0(?:50|60|70|80|90))$"
NAMED = r"\b(RTX|GTX|GT)\s*-?\s*(\d{3,4})\s*(TI|SUPER)?\b"
IMPLIED = r"\b(\d{3,4})\s*(TI|SUPER)\b"
AFTER_GEFORCE = r"\bGEFORCE\s*-?\s*(\d{3,4})\s*(TI|SUPER)?\b"
RADEON = r"\bRX\s*-?\s*(\d{3,4})\s*(XT|XTX)?\b"
ARC = r"\bARC\s+(A\d{3})\b"
WITH_BOX, WITHOUT_BOX = "com caixa|caixa original", "sem caixa"
AS_NEW, USED = r"\b(?:nova|lacrada|sem uso)\b", r"\b(?:usada|tempo de uso)\b"
VRAM = r"\b(\d{1,2})\s*gb\b"
USAGE = r"(\d+\s*(?:meses?|anos?)\s*(?:de uso)?)"
MINING, REPAIRS = "mineracao|mining", "reparo|reball|consert"
SAYS_DEFECT = "O anúncio menciona defeito ou problema"
SAYS_MINING = "Há menção a mineração; o histórico deve ser verificado"
SAYS_NO_MINING = "Ausência de mineração é apenas alegação do vendedor; verifique o histórico de uso"
SAYS_REPAIR = "O anúncio menciona reparo"
SAYS_DAMAGED = "A placa aparenta ter defeito ou avaria"
SAYS_WARRANTY, SAYS_BOX = "O anúncio menciona garantia", "Inclui caixa"
WARRANTY = r"garantia\s+(?:de\s+)?([\w\s]{1,30})"


def nvidia_family(number: Column, qualifier: Column) -> Column:
    """Series of a bare model number; an unknown one under 2000 with a qualifier is a GTX."""
    return (
        F.when(number == "1030", "GT")
        .when(number.rlike(GTX_NUMBERS), "GTX")
        .when(number.rlike(RTX_NUMBERS), "RTX")
        .when(qualifier.isNotNull() & (number.cast("int") < 2000), "GTX")
    )


def gpu_model(text: Column) -> Column:
    """(vendor, model, normalized) of the card a text names; the most explicit way of naming wins."""
    upper = F.upper(text)
    bare = F.regexp_replace(F.regexp_replace(upper, "GEFORCE|RADEON", ""), r"\s+", " ")
    more = lambda c: F.coalesce(F.concat(F.lit(" "), c), F.lit(""))
    explicit = F.concat(match(bare, NAMED, 1), F.lit(" "), match(bare, NAMED, 2), more(match(bare, NAMED, 3)))
    has = match(bare, IMPLIED, 1).isNotNull()
    number = F.when(has, match(bare, IMPLIED, 1)).otherwise(match(upper, AFTER_GEFORCE, 1))
    qualifier = F.when(has, match(bare, IMPLIED, 2)).otherwise(match(upper, AFTER_GEFORCE, 2))
    guessed = F.concat(nvidia_family(number, qualifier), F.lit(" "), number, more(qualifier))
    amd = F.concat(F.lit("RX "), match(bare, RADEON, 1), more(match(bare, RADEON, 2)))
    intel = match(bare, ARC, 1)
    nvidia = F.coalesce(explicit, guessed)
    return F.struct(
        F.when(nvidia.isNotNull(), "NVIDIA").when(amd.isNotNull(), "AMD").when(intel.isNotNull(), "Intel").alias("vendor"),
        F.coalesce(nvidia, amd, F.concat(F.lit("Arc "), intel)).alias("model"),
        F.coalesce(F.concat(F.lit("NVIDIA GeForce "), nvidia), F.concat(F.lit("AMD Radeon "), amd), F.concat(F.lit("Intel Arc "), intel)).alias("normalized"),
    )


class GpuAnalyzer:
    category = "gpu"

    def extract(self, listing: Listing) -> Column:
        return once(listing.text, self._fields)

    def _fields(self, text: Column) -> Column:
        model, defect = gpu_model(text), contains_defect(text)
        box = F.when(text.rlike(WITH_BOX), True).when(text.rlike(WITHOUT_BOX), False)
        condition = F.when(defect, "damaged").when(text.rlike(AS_NEW), "new").when(text.rlike(USED), "used").otherwise("unknown")
        return F.struct(
            model["vendor"].alias("gpu_vendor"),
            model["model"].alias("model"),
            model["normalized"].alias("normalized_model"),
            first_term(text, BOARD_BRANDS).alias("board_brand"),
            match(text, VRAM).cast("int").alias("vram_gb"),
            condition.alias("condition"),
            match(text, USAGE).alias("usage_time"),
            F.trim(match(text, WARRANTY)).alias("warranty"),
            box.alias("has_box"),
            text.rlike(MINING).alias("mining_mentioned"),
            text.rlike(NO_MINING).alias("seller_claims_no_mining"),
            present((defect, SAYS_DEFECT)).alias("defects"),
            text.rlike(REPAIRS).alias("repairs_mentioned"),
            F.when(model["normalized"].isNotNull(), 0.9).otherwise(0.35).alias("extraction_confidence"),
        )

    def key(self, data: Column) -> Column:
        return data["normalized_model"]

    def comparable(self, a: Column, b: Column) -> Column:
        return unknown_or_equal(a["vram_gb"], b["vram_gb"])

    def analyze(self, data: Column) -> Column:
        risks = present(
            (data["mining_mentioned"] & ~data["seller_claims_no_mining"], SAYS_MINING),
            (data["seller_claims_no_mining"], SAYS_NO_MINING),
            (data["repairs_mentioned"], SAYS_REPAIR),
            (data["condition"] == "damaged", SAYS_DAMAGED),
        )
        gains = present((F.length(data["warranty"]) > 0, SAYS_WARRANTY), (data["has_box"], SAYS_BOX))
        return analysis(F.least(F.lit(15), 8 + F.size(gains) * 2), F.greatest(F.lit(0), 13 - F.size(risks) * 4), gains, risks)
