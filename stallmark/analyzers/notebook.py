"""Notebooks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallmark.analyzers.base import Listing, analysis, known, present, unknown_or_equal
from stallmark.analyzers.gpu import gpu_model
from stallmark.functions.text import contains_defect, first_term, match, once

#: Names, patterns and notices, lists tried in their order.
MAKERS = ["apple", "dell", "lenovo", "asus", "acer", "samsung", "hp", "positivo", "avell", "lg"]
CPU = r"\b(i[3579][ -]?\d{4,5}[a-z0-9]{0,3}|ryzen\s*[3579]\s*\d{4}[a-z]{0,2}|m[1-5](?:\s*(?:pro|max|ultra))?)\b"
STORAGE = r"\b(\d{3,4})\s*gb\s*(ssd|hd|hdd)?\b|\b(\d)\s*tb\s*(ssd|hd|hdd)?\b"
INTEL = r"i[3579][ -]?(\d{4,5})"
RAM = r"\b(\d{1,2})\s*gb\s*(?:de\s*)?ram\b"
SSD, HDD = r"\bssd\b", r"\bhdd?\b"
INCHES = r'(\d{2}(?:[.,]\d)?)\s*(?:polegadas|pol|")'
RESOLUTION = r"\b(\d{3,4}\s*x\s*\d{3,4}|full hd|4k|qhd)\b"
BATTERY = r"bateria\s+([\w\s%]{1,30})"
AS_NEW, USED = "novo|lacrado|sem uso", "usado"
SAYS_DEFECT = "O anúncio menciona defeito ou avaria"
HAS_SSD = "Possui armazenamento SSD"
NO_BATTERY = "Estado da bateria não informado"


def intel_generation(cpu: Column) -> Column:
    """10 to 14 from the first two digits of the model number, else its first digit."""
    digits = match(cpu, INTEL)
    two = F.left(digits, F.lit(2)).cast("int")
    return F.when(two.between(10, 14), two).otherwise(F.left(digits, F.lit(1)).cast("int"))


class NotebookAnalyzer:
    category = "notebook"

    def extract(self, listing: Listing) -> Column:
        return once(listing.text, lambda text: self._fields(listing, text))

    def _fields(self, listing: Listing, text: Column) -> Column:
        raw = F.lower(F.concat_ws(" ", listing.title, F.coalesce(listing.description, F.lit(""))))
        cpu, defect = match(text, CPU), contains_defect(text)
        ram = match(text, RAM).cast("int")
        storage = F.coalesce(match(text, STORAGE, 1).cast("int"), match(text, STORAGE, 3).cast("int") * 1024)
        maker = first_term(text, MAKERS)
        return F.struct(
            maker.alias("manufacturer"),
            F.lit(None).cast("string").alias("model"),
            cpu.alias("cpu"),
            intel_generation(cpu).alias("cpu_generation"),
            ram.alias("ram_gb"),
            storage.alias("storage_gb"),
            F.when(text.rlike(SSD), "ssd").when(text.rlike(HDD), "hdd").otherwise("unknown").alias("storage_type"),
            gpu_model(text)["normalized"].alias("gpu"),
            F.replace(match(raw, INCHES), F.lit(","), F.lit(".")).cast("double").alias("screen_inches"),
            match(text, RESOLUTION).alias("resolution"),
            F.trim(match(text, BATTERY)).alias("battery"),
            F.when(defect, "damaged").when(text.rlike(AS_NEW), "new").when(text.rlike(USED), "used").otherwise("unknown").alias("condition"),
            present((defect, SAYS_DEFECT)).alias("defects"),
            (F.lit(0.35) + known(maker, cpu, ram, storage) * F.lit(0.14)).alias("extraction_confidence"),
        )

    def key(self, data: Column) -> Column:
        return data["cpu"]

    def comparable(self, a: Column, b: Column) -> Column:
        return unknown_or_equal(a["manufacturer"], b["manufacturer"]) & unknown_or_equal(a["ram_gb"], b["ram_gb"]) & unknown_or_equal(a["storage_gb"], b["storage_gb"])

    def analyze(self, data: Column) -> Column:
        risks = F.concat(data["defects"], present((data["battery"].isNull() | (data["battery"] == ""), NO_BATTERY)))
        gains = present((data["storage_type"] == "ssd", HAS_SSD))
        return analysis(F.least(F.lit(15), 8 + F.size(gains) * 3), F.greatest(F.lit(0), 13 - F.size(risks) * 3), gains, risks)
