"""Which analyzer reads a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallmark.analyzers.base import Analyzer
from stallmark.analyzers.generic import GenericAnalyzer
from stallmark.analyzers.gpu import GpuAnalyzer
from stallmark.analyzers.notebook import NotebookAnalyzer
from stallmark.analyzers.vehicle import VehicleAnalyzer
from stallmark.functions.text import normalize_title, once

CATEGORIES = ["vehicle", "gpu", "notebook", "electronics", "generic"]
#: Patterns over normalized title and description, tried in this order.
RULES = [
    ("notebook", [r"\b(notebook|laptop|macbook|ultrabook)\b"]),
    ("gpu", [r"\b(rtx|gtx|radeon rx|geforce|placa de video|gpu)\b"]),
    ("vehicle", [r"\b(carro|veiculo|km|automatico|manual|flex|diesel)\b", r"\b(19\d{2}|20\d{2})\b"]),
    ("electronics", [r"\b(tv|televisao|smartphone|celular|console|camera)\b"]),
]


def detect_category(title: Column, description: Column, configured: Column | None = None) -> Column:
    """A configured category other than generic; else the first whose patterns all match; else generic."""
    tried = lambda text: F.coalesce(*(F.when(all_match(text, ps), F.lit(c)) for c, ps in RULES), F.lit("generic"))
    found = once(normalize_title(F.concat_ws(" ", title, F.coalesce(description, F.lit("")))), tried)
    return found if configured is None else F.coalesce(F.when(configured != "generic", configured), found)


def all_match(text: Column, patterns: list[str]) -> Column:
    out = text.rlike(patterns[0])
    for p in patterns[1:]:
        out = out & text.rlike(p)
    return out


class AnalyzerRegistry:
    """Analyzers by category; a second one of a category is refused, a missing one is the generic one."""

    def __init__(self, analyzers: list[Analyzer]):
        self._by_category: dict[str, Analyzer] = {}
        for a in analyzers:
            self.register(a)

    def register(self, analyzer: Analyzer) -> None:
        if analyzer.category in self._by_category:
            raise ValueError(f"an analyzer for {analyzer.category} is registered")
        self._by_category[analyzer.category] = analyzer

    def get(self, category: str) -> Analyzer:
        return self._by_category.get(category) or self._by_category["generic"]

    def list(self) -> list[str]:
        return sorted(self._by_category)


def default_registry() -> AnalyzerRegistry:
    return AnalyzerRegistry([VehicleAnalyzer(), GpuAnalyzer(), NotebookAnalyzer(), GenericAnalyzer("electronics"), GenericAnalyzer()])
