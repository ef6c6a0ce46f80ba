"""License scan with built-in functions only: MinHash bands over overlapping windows, then exact containment.

Texts and templates are lower-cased and cut at everything that is neither letter nor digit. The `width`-word shingles
of a text are hashed once. Windows of `span` words, every `span / 2` words, get a MinHash signature of `bands` bands of `rows`
rows: the smallest shingle hashes under bands * rows orders, each band hashed to one value. Templates get those of their
windows at every offset, so a window of the text meets its like whatever its offset. Two windows of Jaccard similarity s
meet in one band or more with probability 1 - (1 - s ** rows) ** bands: for windows of 32 words 0.998 at s = 0.8 and 0.82 at 0.5,
for each of the windows that a template fills. Templates too short for two of these use windows of 8 words, of which a
statement of five words is one shingle of four, a similarity of 0.25: no bands of several rows would meet, so the
signature keeps the whole window (four shingles, four bands of one row) and meets with probability 1.
Templates use the largest span that fits in them twice. Bands are joined with the bounded template bands by broadcast. The
hits are written down, so that their size is known: documents meet them again by id and text hash, by broadcast where
they are few and by shuffle else. A template counts when `percent` of its shingles stand in the stretch of text that
can hold it around a hit.

Templates are an argument: at most MOST_WORDS words in all, so what is broadcast is bounded. The default ones are
statements and openings of well-known licenses.

Defined results: null or empty texts match nothing; texts and templates need `width` words (a shorter template is
refused); rows that repeat an id and a text are reported once, other texts of an id on their own; rows without id
are reported under null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallmark.llm.kernels import picked
from stallmark.llm.scratch import materialize

MOST_WORDS = 200_000
#: Span of the windows in words, bands and rows of each.
SCALES = ((8, 4, 1), (32, 6, 2))
#: Wording of public licenses.
TEMPLATES = {
    "Apache-2.0 statement": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT statement": "Released under the MIT License",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0 statement": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0 statement": "Licensed under CC BY-NC 4.0",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, also where lambdas use it for every element."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(text: Column, width: int) -> Column:
    """Hash of every width-word shingle, in order; an empty array for shorter texts."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))
    return once(words, lambda w: F.when(F.size(w) >= width, hashed(w)).otherwise(F.array().cast("array<long>")))


def signature(window: Column, size: int, bands: int, rows: int) -> Column:
    """Values of the bands of an array of hashes. Orders are the hashes under different exclusive ors; where there are as
    many bands of one row as shingles, the bands are the shingles."""
    if rows == 1 and bands >= size:
        return F.transform(window, lambda x: F.xxhash64(F.lit(size), x))

    def least(order: int) -> Column:
        mask = (order * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 63)
        return F.array_min(F.transform(window, lambda x: x.bitwiseXOR(F.lit(mask))))

    return F.array(*(F.xxhash64(F.lit(size), F.lit(band), *(least(band * rows + i) for i in range(rows))) for band in range(bands)))


def windows(hashes: Column, span: int, bands: int, rows: int, step: int, width: int) -> Column:
    """Array of (start, band values) of the windows of span words, step words apart; starts count shingles."""
    size = span - width + 1
    starts = lambda h: F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0)), F.lit(step))
    values = lambda h, s: once(F.slice(h, s + 1, size), lambda w: signature(w, size, bands, rows))
    return once(hashes, lambda h: F.when(F.size(h) > 0, F.transform(starts(h), lambda s: F.struct(s.alias("start"), values(h, s).alias("values")))))


def template_table(df: DataFrame, templates: dict[str, str], width: int) -> DataFrame:
    """(license, shingles, n) of the templates."""
    if sum(len(t.split()) for t in templates.values()) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} template words")
    spark = df.sparkSession
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string").select("license", F.array_distinct(shingle_hashes(F.col("text"), width)).alias("shingles"))
    rows = rows.withColumn("n", F.size("shingles"))
    return rows.withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("template under the shingle width: "), "license")).cast("int")))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, word): each template found in a document, the share of its shingles and the
    word number where the first window that found it begins."""
    known = template_table(docs, templates or TEMPLATES, width)
    rows = picked(docs, id=id_col, text=text_col).where("text is not null").select("id", F.col("text").cast("string").alias("text"))
    bands = None
    for i, (span, keep, lines) in enumerate(SCALES):
        longer = SCALES[i + 1][0] * 2 - width + 1 if i + 1 < len(SCALES) else 1 << 30
        fits = known.where((F.col("n") < longer) & (F.lit(i == 0) | (F.col("n") >= span * 2 - width + 1)))
        own = fits.select("license", F.explode(windows(F.col("shingles"), span, keep, lines, 1, width)).alias("w")).select("license", F.explode("w.values").alias("value"))
        bands = own if bands is None else bands.unionByName(own)
    every = once(shingle_hashes(F.col("text"), width), lambda h: F.concat(*(windows(h, span, keep, lines, span // 2, width) for span, keep, lines in SCALES)))
    seen = rows.select("id", F.xxhash64("text").alias("of_text"), F.explode(every).alias("w")).select("id", "of_text", "w.start", F.explode("w.values").alias("value"))
    hits = seen.join(F.broadcast(bands.distinct()), "value").select("id", "of_text", "start", "license")
    hits = hits.groupBy("id", "of_text", "license").agg(F.collect_set("start").alias("starts"))
    met = materialize(hits.groupBy("id", "of_text").agg(F.collect_list(F.struct("license", "starts")).alias("found")), "license-hits")
    again = rows.withColumn("of_text", F.xxhash64("text"))
    met = met.withColumnsRenamed({"id": "i", "of_text": "t"})
    texts = again.join(met, F.col("id").eqNullSafe(F.col("i")) & (F.col("of_text") == F.col("t"))).select("id", "of_text", shingle_hashes(F.col("text"), width).alias("h"), F.explode("found").alias("f"))
    texts = texts.select("id", "of_text", "h", "f.license", "f.starts").join(F.broadcast(known), "license")
    reach = SCALES[-1][0]
    share = F.transform("starts", lambda s: F.struct((F.size(F.array_intersect(F.slice("h", F.greatest(s - F.col("n") + 1, F.lit(1)), 2 * F.col("n") + reach), F.col("shingles"))) / F.col("n")).alias("containment"), F.negate(s).alias("from")))
    best = texts.withColumn("best", F.array_max(share)).where(F.col("best.containment") * 100 >= percent)
    return best.select(F.col("id").alias("doc_id"), "license", F.col("best.containment").alias("containment"), (-F.col("best.from")).cast("long").alias("word")).distinct()
