"""Queries over the names that advertisements give to goods, and over what is asked of and answered by a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmark.analyzers.generic import BRANDS, STOP_WORDS, infer_model
from stallmark.analyzers.gpu import gpu_model
from stallmark.functions.text import error_message, first_term, normalize_title, once, truncate_after
from stallmark.operators import filters, reports, scoring
from stallmark.plans import views

_MIXED = "(p_partkey * 7919 + p_size * 104729 + cast(floor(p_retailprice) AS BIGINT) * 31) % 1000003"
#: Ways in which a title names a card, and the vendor and model that it then has: both in the expressions of both engines.
_EXPLICIT, _BARE, _QUALIFIER = "CASE x % 3 WHEN 0 THEN 'RTX' WHEN 1 THEN 'gtx' ELSE 'GT' END", "CASE x % 7 WHEN 0 THEN '1030' WHEN 1 THEN '1660' WHEN 2 THEN '3070' WHEN 3 THEN '970' WHEN 4 THEN '2500' WHEN 5 THEN '2080' ELSE '650' END", "CASE x % 5 WHEN 0 THEN ' Ti' WHEN 1 THEN ' SUPER' ELSE '' END"
_TITLE = f"""CASE x % 8 WHEN 0 THEN concat('Placa de vídeo ', {_EXPLICIT}, ' ', {_BARE}, {_QUALIFIER}, ' usada') WHEN 1 THEN concat('Vendo ', {_EXPLICIT}, '-', {_BARE}) WHEN 2 THEN concat('Placa ', {_BARE}, CASE WHEN x % 2 = 0 THEN ' TI' END, CASE WHEN x % 2 = 1 THEN 'super' ELSE '' END, ' 8gb')
 WHEN 3 THEN concat('GeForce ', {_BARE}, {_QUALIFIER}) WHEN 4 THEN concat('Radeon RX ', 4 + x % 5, '80', CASE x % 3 WHEN 0 THEN ' XT' ELSE '' END) WHEN 5 THEN concat('Intel Arc A', 3 + x % 5, '50') WHEN 6 THEN concat('Placa de rede ', p_brand) ELSE concat('GeForce 9999 ou rx-', 5 + x % 3, '70 xt') END"""
_FAMILY = f"CASE WHEN {_BARE} = '1030' THEN 'GT' WHEN {_BARE} = '1660' THEN 'GTX' WHEN {_BARE} IN ('3070', '2080') THEN 'RTX' WHEN {_QUALIFIER} <> '' AND {_BARE} IN ('970', '650') THEN 'GTX' END"
_SECOND = f"CASE WHEN {_BARE} = '1030' THEN 'GT' WHEN {_BARE} = '1660' THEN 'GTX' WHEN {_BARE} IN ('3070', '2080') THEN 'RTX' WHEN {_BARE} IN ('970', '650') THEN 'GTX' END"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.dealt(views.table(spark, sf_dir, "part"), "p_partkey").withColumn("x", F.expr(_MIXED))


def card_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card that each title names, if any: by series and number, by number and qualifier, by maker, or by a rival's name."""
    rows = _parts(spark, sf_dir).withColumn("title", F.expr(_TITLE.replace("concat('Placa ',", "concat_ws('', 'Placa ',")))
    m = F.col("m")
    rows = rows.select("p_partkey", once(normalize_title(F.col("title")), gpu_model).alias("m"))
    return rows.select("p_partkey", m["vendor"].alias("vendor"), m["model"].alias("model"), m["normalized"].alias("normalized"))


CARD_MODELS = f"""WITH rows AS (SELECT *, {_MIXED} AS x FROM part),
 n AS (SELECT p_partkey, x, CASE x % 8 WHEN 0 THEN concat(upper({_EXPLICIT}), ' ', {_BARE}, upper({_QUALIFIER})) WHEN 1 THEN concat(upper({_EXPLICIT}), ' ', {_BARE}) WHEN 2 THEN {_SECOND} || ' ' || {_BARE} || CASE WHEN x % 2 = 0 THEN ' TI' ELSE ' SUPER' END WHEN 3 THEN {_FAMILY} || ' ' || {_BARE} || upper({_QUALIFIER}) END AS nvidia,
 CASE x % 8 WHEN 4 THEN concat('RX ', 4 + x % 5, '80', CASE x % 3 WHEN 0 THEN ' XT' ELSE '' END) WHEN 7 THEN concat('RX ', 5 + x % 3, '70 XT') END AS amd, CASE WHEN x % 8 = 5 THEN concat('A', 3 + x % 5, '50') END AS intel FROM rows)
 SELECT p_partkey, CASE WHEN nvidia IS NOT NULL THEN 'NVIDIA' WHEN amd IS NOT NULL THEN 'AMD' WHEN intel IS NOT NULL THEN 'Intel' END AS vendor, coalesce(nvidia, amd, 'Arc ' || intel) AS model,
 coalesce('NVIDIA GeForce ' || nvidia, 'AMD Radeon ' || amd, 'Intel Arc ' || intel) AS normalized FROM n"""

_GOODS = "concat_ws(' ', CASE x % 4 WHEN 0 THEN 'Vendo' WHEN 1 THEN 'Produto NOVO,' END, CASE x % 12 WHEN 0 THEN 'Apple' WHEN 1 THEN 'sony' WHEN 2 THEN 'LG' WHEN 3 THEN 'Xiaomi' END, CASE WHEN x % 17 > 0 THEN p_name END, CASE WHEN x % 17 > 0 THEN p_type END, CASE WHEN x % 5 = 0 THEN 'em excelente estado!' END)"


def inferred_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that a title of any goods is taken to name: its first five words but the brand and fill words."""
    rows = _parts(spark, sf_dir).withColumn("title", F.expr(_GOODS))
    rows = rows.select("p_partkey", "title", first_term(normalize_title(F.col("title")), BRANDS).alias("brand"))
    return rows.select("p_partkey", "brand", infer_model(F.col("title"), F.col("brand")).alias("model"))


INFERRED_MODELS = f"""WITH rows AS (SELECT *, {_MIXED} AS x FROM part), t AS (SELECT p_partkey, string_split(trim(regexp_replace(lower({_GOODS}), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM rows),
 b AS (SELECT *, list_filter({BRANDS}, lambda y: list_contains(w, y))[1] AS brand FROM t), m AS (SELECT *, list_filter(w, lambda y: y IS DISTINCT FROM brand AND NOT list_contains({STOP_WORDS}, y))[1:5] AS own FROM b)
 SELECT p_partkey, brand, CASE WHEN len(own) > 0 THEN array_to_string(own, ' ') END AS model FROM m"""

_OWN = "CASE x % 4 WHEN 0 THEN '' WHEN 1 THEN 'barato' WHEN 2 THEN 'barato|com caixa' ELSE 'a|b|c|d|e|f|g|h|i' END"
_THEIRS = "CASE x % 5 WHEN 0 THEN NULL WHEN 1 THEN 'barato|raro' WHEN 2 THEN 'com caixa' WHEN 3 THEN 'i|j|k|l' ELSE '' END"
_ERROR = "concat('telegram_http_error:', 400 + x % 100, ' ', repeat(p_name, CASE WHEN x % 9 = 0 THEN 120 ELSE 1 END))"


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of a model's answer beside the rules' own points, whether a search may ask again, the error that is stored of
    a failed delivery, and how much of a listing a prompt holds."""
    split = lambda c: F.when(F.col(c) != "", F.split(c, r"\|")).when(F.col(c) == "", F.array().cast("array<string>"))
    rows = _parts(spark, sf_dir).select("p_partkey", "x", "p_name", F.expr(_OWN).alias("own"), F.expr(_THEIRS).alias("theirs"), F.expr(_ERROR).alias("error"), F.concat(F.lit('{"title":"'), F.repeat("p_name", (F.col("x") % 6).cast("int")), F.lit('"}')).alias("prompt"))
    ago = lambda n: F.lit(views.AS_OF) - F.make_dt_interval(mins=(F.col("x") % n).cast("int"))
    again = filters.may_retry(views.AS_OF, F.when(F.col("x") % 3 != 0, ago(120)), ago(90), F.when(F.col("x") % 7 == 0, "model"))
    stored = error_message(F.col("error"))
    return rows.select("p_partkey", F.array_join(scoring.merged_points(split("own"), split("theirs")), "|").alias("points"), again.alias("may_retry"), F.length(stored).alias("stored"), F.left(stored, F.lit(40)).alias("error"), truncate_after(F.col("prompt"), 80, "\\n[conteúdo truncado]").alias("prompt"))


MODEL_RUNS = f"""WITH rows AS (SELECT *, {_MIXED} AS x FROM part), r AS (SELECT *, string_split(NULLIF({_OWN}, ''), '|') AS own, string_split(NULLIF({_THEIRS}, ''), '|') AS theirs, {_ERROR} AS error, concat('{{"title":"', repeat(p_name, (x % 6)::INT), '"}}') AS prompt FROM rows)
 SELECT p_partkey, array_to_string(list_concat(coalesce(own, []), list_filter(coalesce(theirs, []), lambda y: NOT list_contains(coalesce(own, []), y)))[1:10], '|') AS points, x % 7 <> 0 AND (CASE WHEN x % 3 <> 0 THEN x % 120 ELSE x % 90 END) >= 60 AS may_retry,
 least(length(error), 2000)::INT AS stored, error[:40] AS error, CASE WHEN length(prompt) <= 80 THEN prompt ELSE concat(prompt[:80], chr(10), '[conteúdo truncado]') END AS prompt FROM r"""


def search_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What searches ask for, as it goes into a model's prompt and into the hash of an analysis."""
    k = F.col("search_id")
    rows = views.search(spark, sf_dir).select("*", F.lit(None).cast("int").alias("min_year"), F.when(k % 3 == 0, 2000 + k % 20).cast("int").alias("max_year"), (k % 200 + 1).cast("int").alias("radius_km"), F.when(k % 2 == 0, F.array(F.lit("olx"), F.lit("facebook"))).otherwise(F.array(F.lit("mercadolivre"))).alias("providers"), F.array(F.lit("leilao"), F.concat(F.lit("b"), (k % 3).cast("string"))).alias("forbidden_words"))
    c = reports.criteria(F.struct(*rows.columns))
    return rows.select("search_id", c["query"].alias("query"), c["max_year"].alias("max_year"), c["radius_km"].alias("radius_km"), c["minimum_score"].alias("minimum_score"), F.array_join(c["providers"], ",").alias("providers"), F.array_join(c["forbidden_words"], ",").alias("forbidden_words"))


SEARCH_CRITERIA = f"""WITH {views.SEARCH} SELECT search_id, query, CASE WHEN search_id % 3 = 0 THEN (2000 + search_id % 20)::INT END AS max_year, (search_id % 200 + 1)::INT AS radius_km, minimum_score,
 CASE WHEN search_id % 2 = 0 THEN 'facebook,olx' ELSE 'mercadolivre' END AS providers, concat('b', search_id % 3, ',leilao') AS forbidden_words FROM search"""
