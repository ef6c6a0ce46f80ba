"""Hashes that tell whether a listing, or what an analysis rests on, has changed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallmark.functions.numbers import plain_number
from stallmark.functions.text import normalize_title


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical_map(entries: Column) -> Column:
    """A map as an array of its entries by key, so that equal maps serialize alike."""
    return F.array_sort(F.map_entries(entries))


def fingerprint(source: Column, title: Column, price: Column, location: Column) -> Column:
    """Of the normalized summary: source|title|price|location, nothing for null."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return sha256(F.concat_ws("|", empty(source), empty(normalize_title(title)), empty(plain_number(price)), empty(normalize_title(location))))


def content_hash(title: Column, description: Column, price: Column, attributes: Column, images: Column) -> Column:
    """Of what a buyer reads; not of URL, place or currency."""
    body = F.struct(canonical_map(attributes).alias("attributes"), description.alias("description"), images.alias("images"), plain_number(price).alias("price"), title.alias("title"))
    return sha256(F.to_json(body, {"ignoreNullFields": "false"}))


def input_hash(**parts: Column) -> Column:
    """Of all that an analysis rests on, by name; arrays whose order means nothing must come sorted."""
    body = F.struct(*(parts[k].alias(k) for k in sorted(parts)))
    return sha256(F.to_json(body, {"ignoreNullFields": "false"}))
