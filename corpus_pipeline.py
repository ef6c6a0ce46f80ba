"""A corpus pipeline of five stages over documents.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept, and all but the last return the columns of
documents. run() writes each stage's result to the shared folder as Parquet and reads it again for the next, so a
lost executor repeats one stage at most.

* quality_classifier: learns from the labels that may teach and drops documents it predicts to be of quality 0.
* line_dedup: removes lines, of any length, that an equal or nearly equal line precedes. A document that had words and keeps none
  goes: an earlier document holds all its lines.
* ngram_jaccard: keeps one document, that with the smallest id, of each group of near copies; documents without id stay.
  Every row is judged on its own text: of rows that repeat an id only those go that are near copies of another row.
* mixing: takes words of each source to its target; a document taken twice comes twice, one cut to the words taken
  has these as its text; one of which nothing is taken goes. n_chars follows the text.
* packing: the pieces of token sequences, with their ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmark.llm import line_dedup, mixing, ngram_join, packing, quality
from stallmark.llm.scratch import materialize
from stallmark.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = r"[^\x20\x09-\x0D]"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where(~quality.held_out()))
    return quality.score(docs.select(COLUMNS), model).where("predicted = 1").select(COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs.select(COLUMNS))
    kept = out.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_rows(docs.select(COLUMNS)).where("doc = component and of_text = keeper")
    keep = materialize(found.groupBy("doc", "of_text").agg(F.count("*").alias("copies")), "pipeline-keep")
    rows = docs.select(*COLUMNS, F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_of_text"))
    in_group = F.col("_doc").isNotNull() & F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    kept = lambda copies: rows.where(in_group).join(keep.where(copies).select(F.col("doc").alias("_doc"), F.col("of_text").alias("_of_text")), ["_doc", "_of_text"])
    repeated = kept("copies > 1").dropDuplicates(["_doc", "_of_text"])
    return rows.where(~in_group).select(COLUMNS).unionByName(kept("copies = 1").select(COLUMNS)).unionByName(repeated.select(COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = materialize(mixing.measured(docs, keep=["lang"]), "mixing-sizes")
    plan = mixing.plan_for(rows)
    out = mixing.texts(docs, rows, plan)
    return out.select(F.col("id").alias("doc_id"), "text", "kept.lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


def shipped(stage: Stage) -> Stage:
    """stage in a session whose Python workers find the package and get bounded batches."""
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES = [(name, shipped(stage)) for name, stage in (("quality_classifier", quality_classifier), ("line_dedup", line_dedup_stage), ("ngram_jaccard", ngram_jaccard), ("mixing", mixing_stage), ("packing", packing_stage))]

#: A trained model, tokenizers and seeded draws are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
