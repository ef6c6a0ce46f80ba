"""Stallmark: marketplace-listing analytics on the PySpark DataFrame API."""
