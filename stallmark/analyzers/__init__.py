"""One analyzer per product category, each made of Column expressions, and the registry that picks one by row."""

from stallmark.analyzers.base import Analyzer, Listing
from stallmark.analyzers.registry import CATEGORIES, AnalyzerRegistry, default_registry, detect_category

__all__ = ["CATEGORIES", "Analyzer", "AnalyzerRegistry", "Listing", "default_registry", "detect_category"]
