"""Queries over text functions: titles, URLs, prices as text, extraction, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmark.analyzers import Listing, detect_category
from stallmark.analyzers.generic import GenericAnalyzer
from stallmark.analyzers.gpu import GpuAnalyzer
from stallmark.analyzers.notebook import NotebookAnalyzer
from stallmark.analyzers.vehicle import VehicleAnalyzer
from stallmark.functions import hashing, numbers, text, urls
from stallmark.operators.filters import listing_facts, reasons_of_pairs, search_facts
from stallmark.plans import views

_PLAIN = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"


def normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts, normalized."""
    return views.table(spark, sf_dir, "documents").select("doc_id", text.normalize_title(F.col("text")).alias("title"))


NORMALIZE_TITLE = f"SELECT doc_id, {_PLAIN.format('text')} AS title FROM documents"


def nullable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", F.length(text.nullable_text(F.col("text"))).cast("long").alias("chars"))


NULLABLE_TEXT = "SELECT doc_id, length(nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '')) AS chars FROM documents"


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts with secrets blanked."""
    return views.table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.redact(F.col("text")), 256).alias("sha"))


REDACT_TEXT = r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '(?i)\bBearer\s+[A-Za-z0-9._~+/-]+=*', 'Bearer [REDACTED]', 'g'), '\bbot\d+:[A-Za-z0-9_-]{20,}\b', 'bot[REDACTED]', 'g'), '\b\d+:[A-Za-z0-9_-]{20,}\b', '[REDACTED_TELEGRAM_TOKEN]', 'g'),
 '\bsk-[A-Za-z0-9_-]{16,}\b', '[REDACTED_API_KEY]', 'g'), '(?i)(postgres(?:ql)?://[^:\s/]+:)[^@\s]+@', '\1[REDACTED]@', 'g')) AS sha FROM documents"""


def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url"), urls.is_http_url(F.col("url")).alias("is_http"))


NORMALIZE_URL = r"""WITH u AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages),
 p AS (SELECT page_id, lower(regexp_extract(bare, '^([A-Za-z]+)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(bare, '^[A-Za-z]+://([^/?]*)', 1)), '^www\.', '') AS host,
 regexp_replace(regexp_extract(bare, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/+$', '') AS path, regexp_extract(bare, '\?(.*)$', 1) AS query FROM u),
 q AS (SELECT *, list_filter(string_split(query, '&'), lambda x: x <> '' AND string_split(x, '=')[1] NOT IN ('utm_source','utm_medium','utm_campaign','utm_content','utm_term','fbclid','gclid')) AS kept FROM p),
 s AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(kept, lambda x, i: {'n': string_split(x, '=')[1], 'i': i, 'x': CASE WHEN contains(x, '=') THEN x ELSE concat(x, '=') END})), lambda y: y.x), '&') AS args FROM q)
 SELECT page_id, concat(scheme, '://', host, CASE WHEN path = '' THEN '/' ELSE path END, CASE WHEN args = '' THEN '' ELSE concat('?', args) END) AS url, scheme IN ('http', 'https') AS is_http FROM s"""


def _price_text():
    whole, cents = F.floor(F.col("l_extendedprice")).cast("long"), F.pmod(F.col("l_partkey") * 7, F.lit(100))
    dotted = F.regexp_replace(F.format_number(whole, 0), ",", ".")
    kind = F.col("l_orderkey") % 4
    return F.when(kind == 0, F.concat(F.lit("R$ "), dotted, F.lit(","), F.lpad(cents.cast("string"), 2, "0"))).when(kind == 1, F.concat(F.lit("R$ "), dotted)).when(kind == 2, F.concat(whole.cast("string"), F.lit("."), F.lpad(cents.cast("string"), 2, "0"))).otherwise("Consulte")


def parse_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in four ways and read back."""
    li = views.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", numbers.parse_price(_price_text()).alias("price"))


PARSE_PRICE = """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE l_orderkey % 4 WHEN 0 THEN (floor(l_extendedprice)::BIGINT::VARCHAR || '.' || lpad((l_partkey * 7 % 100)::VARCHAR, 2, '0'))::DOUBLE
 WHEN 1 THEN floor(l_extendedprice) WHEN 2 THEN (floor(l_extendedprice)::BIGINT::VARCHAR || '.' || lpad((l_partkey * 7 % 100)::VARCHAR, 2, '0'))::DOUBLE ELSE NULL END AS price FROM lineitem"""


def mileage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mileages written as `92.000 km`, `92 mil km` and `92k`, read back."""
    p = views.table(spark, sf_dir, "part")
    n = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 3
    said = F.when(kind == 0, F.concat(n, F.lit(".000 km"))).when(kind == 1, F.concat(n, F.lit(" mil km"))).otherwise(F.concat(n, F.lit("k")))
    return p.select("p_partkey", numbers.parse_mileage(said).alias("km"))


MILEAGE = "SELECT p_partkey, p_size * 1000 AS km FROM part"


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.listing(spark, sf_dir)
    return f.select("listing_id", hashing.fingerprint(F.col("source"), F.col("title"), F.floor("price").cast("double"), F.col("location")).alias("fingerprint"))


FINGERPRINT = f"""WITH {views.LISTING} SELECT listing_id, sha256(concat(source, '|', {_PLAIN.format("title")}, '|', coalesce(floor(price)::BIGINT::VARCHAR, ''), '|', coalesce({_PLAIN.format("location")}, ''))) AS fingerprint FROM listing"""


def content_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many listings have an equal body: title, description and price, whatever place or source."""
    f = views.listing(spark, sf_dir)
    none = F.create_map().cast("map<string,string>")
    h = hashing.content_hash(F.col("title"), F.lit(None).cast("string"), F.col("price"), none, F.array().cast("array<string>"))
    return f.withColumn("h", h).groupBy("h").agg(F.min("listing_id").alias("listing_id"), F.count("*").alias("n")).select("listing_id", "n")


CONTENT_CHANGE = f"WITH {views.LISTING} SELECT min(listing_id) AS listing_id, count(*) AS n FROM listing GROUP BY title, price"


def token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard of each part's title with that of the next part."""
    p = views.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("t").alias("t_"))
    return p.join(q, "p_partkey").select("p_partkey", F.round(text.token_similarity(F.col("t"), F.col("t_")), 6).alias("similarity"))


TOKEN_SIMILARITY = f"""WITH p AS (SELECT p_partkey, list_distinct(string_split({_PLAIN.format("concat(p_name, ' ', p_type, ' ', p_brand)")}, ' ')) AS t FROM part)
 SELECT a.p_partkey, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS similarity FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City and state of customers placed in Brazilian towns written in three ways."""
    c = views.dealt(views.table(spark, sf_dir, "customer"), "c_custkey")
    k = F.col("c_custkey") % 3
    said = F.when(k == 0, F.concat("c_name", F.lit(", SC"))).when(k == 1, F.concat("c_name", F.lit(" Santa Catarina"))).otherwise(F.concat("c_name", F.lit(" - São Paulo")))
    return c.select("c_custkey", text.state_of(said).alias("state"), text.city_of(said).alias("city"))


PLACES = f"""SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN 'SP' ELSE 'SC' END AS state, {_PLAIN.format("c_name")} AS city FROM customer"""


def model_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    return p.select("p_partkey", text.model_signature(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.lit("GB"), "p_type")).alias("signature"))


MODEL_SIGNATURE = f"""SELECT p_partkey, array_to_string(list_sort(list_filter(string_split(regexp_replace({_PLAIN.format("concat(p_name, ' ', p_size::VARCHAR, ' GB ', p_type)")}, '\\b(\\d+)\\s+(gb|tb)\\b', '\\1\\2', 'g'), ' '), lambda x: x <> '')), ' ') AS signature FROM part"""


#: Titles of four kinds that the extractions read, made from the parts.
def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.dealt(views.table(spark, sf_dir, "part"), "p_partkey")
    k, n = F.col("p_partkey"), F.col("p_size")
    year = (1990 + n % 35).cast("string")
    car = F.concat(F.lit("Carro Volkswagen Golf "), year, F.lit(" flex automático "), n.cast("string"), F.lit(".000 km revisado"))
    gpu = F.concat(F.lit("Placa de vídeo Galax RTX "), (20 + n % 3 * 10).cast("string"), F.lit("60 Ti 8GB garantia de 12 meses"))
    book = F.concat(F.lit("Notebook Dell i5-1135G7 16GB RAM "), F.when(n % 2 == 0, "512GB SSD").otherwise("1TB HD"), F.lit(" usado"))
    other = F.concat(F.lit("Celular Samsung "), "p_name", F.when(n % 5 == 0, " com defeito").otherwise(" novo lacrado"))
    title = F.when(k % 4 == 0, car).when(k % 4 == 1, gpu).when(k % 4 == 2, book).otherwise(other)
    return p.select("p_partkey", "p_name", "p_size", title.alias("title"), F.lit(None).cast("string").alias("description"), F.create_map().cast("map<string,string>").alias("attributes"))


def _read(spark: SparkSession, sf_dir: str, analyzer) -> DataFrame:
    """All ads of the analyzer's category, with the struct that it extracts as d, and its analysis as a."""
    rows = ads(spark, sf_dir)
    found = text.made_once(detect_category(F.col("title"), F.col("description")))
    rows = rows.select("*", found.alias("category")).where(F.col("category") == analyzer.category)
    rows = rows.withColumn("d", analyzer.extract(Listing(F.col("title"), F.col("description"), F.col("attributes"))))
    return rows.withColumn("a", analyzer.analyze(F.col("d")))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ads(spark, sf_dir).select("p_partkey", detect_category(F.col("title"), F.col("description")).alias("category"))


CATEGORIES = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'vehicle' WHEN 1 THEN 'gpu' WHEN 2 THEN 'notebook' ELSE 'electronics' END AS category FROM part"


def extract_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _read(spark, sf_dir, VehicleAnalyzer())
    return r.select("p_partkey", "d.brand", "d.model", "d.year", "d.mileage", "d.transmission", "d.fuel", "d.maintenance_mentioned", "d.condition", F.round("d.extraction_confidence", 4).alias("confidence"), "a.feature_score", "a.risk_score")


EXTRACT_VEHICLE = """SELECT p_partkey, 'volkswagen' AS brand, 'golf' AS model, 1990 + p_size % 35 AS year, p_size * 1000 AS mileage, 'automatic' AS transmission, 'flex' AS fuel, true AS maintenance_mentioned,
 'used' AS condition, 0.91::DOUBLE AS confidence, 11 AS feature_score, 14 AS risk_score FROM part WHERE p_partkey % 4 = 0"""


def extract_gpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _read(spark, sf_dir, GpuAnalyzer())
    return r.select("p_partkey", "d.normalized_model", "d.board_brand", "d.vram_gb", "d.usage_time", "d.warranty", "d.condition", "d.extraction_confidence", "a.feature_score", "a.risk_score")


EXTRACT_GPU = """SELECT p_partkey, concat('NVIDIA GeForce RTX ', (20 + p_size % 3 * 10)::VARCHAR, '60 TI') AS normalized_model, 'galax' AS board_brand, 8 AS vram_gb, '12 meses' AS usage_time, '12 meses' AS warranty,
 'unknown' AS condition, 0.9::DOUBLE AS extraction_confidence, 10 AS feature_score, 13 AS risk_score FROM part WHERE p_partkey % 4 = 1"""


def extract_notebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _read(spark, sf_dir, NotebookAnalyzer())
    return r.select("p_partkey", "d.manufacturer", "d.cpu", "d.cpu_generation", "d.ram_gb", "d.storage_gb", "d.storage_type", "d.condition", F.round("d.extraction_confidence", 4).alias("confidence"), "a.feature_score", "a.risk_score")


EXTRACT_NOTEBOOK = """SELECT p_partkey, 'dell' AS manufacturer, 'i5 1135g7' AS cpu, 11 AS cpu_generation, 16 AS ram_gb, CASE WHEN p_size % 2 = 0 THEN 512 ELSE 1024 END AS storage_gb, CASE WHEN p_size % 2 = 0 THEN 'ssd' ELSE 'hdd' END AS storage_type,
 'used' AS condition, 0.91::DOUBLE AS confidence, CASE WHEN p_size % 2 = 0 THEN 11 ELSE 8 END AS feature_score, 10 AS risk_score FROM part WHERE p_partkey % 4 = 2"""


def extract_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _read(spark, sf_dir, GenericAnalyzer("electronics"))
    return r.select("p_partkey", "d.brand", "d.condition", F.size("d.defects").alias("defects"), "d.extraction_confidence", "a.feature_score", "a.risk_score")


EXTRACT_GENERIC = """SELECT p_partkey, 'samsung' AS brand, CASE WHEN p_size % 5 = 0 THEN 'damaged' ELSE 'new' END AS condition, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS defects, 0.65::DOUBLE AS extraction_confidence,
 9 AS feature_score, CASE WHEN p_size % 5 = 0 THEN 3 ELSE 11 END AS risk_score FROM part WHERE p_partkey % 4 = 3"""


def filter_reason_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every active search against the recent listings of its brand, with all reasons against each."""
    r = views.recent(spark, sf_dir).withColumn("description", F.lit(None).cast("string"))
    s = views.search(spark, sf_dir).where("active")
    blank = {n: F.lit(None).cast(t) for n, t in (("min_year", "int"), ("max_year", "int"), ("radius_km", "int"), ("forbidden_words", "array<string>"))}
    wanted = F.struct("category", "query", "min_price", "max_price", "min_year", "max_year", "location", "radius_km", "forbidden_words")
    s = s.withColumns(blank).withColumn("forbidden_words", F.array(F.lit("steel"))).withColumn("s", wanted).select(F.col("query").alias("key"), "search_id", search_facts(F.col("s")).alias("s"))
    r = r.select(F.col("brand").alias("key"), "listing_id", F.split("category", " ")[0].alias("category"), F.col("size").alias("year"), listing_facts(F.col("title"), F.col("description"), F.col("price"), F.col("location")).alias("l"))
    return reasons_of_pairs(r, s)


FILTER_REASON_LISTS = f"""WITH {views.RECENT}, {views.SEARCH}, j AS (SELECT s.search_id, r.listing_id, r.title, r.price, r.location AS place, r.category AS kind, s.category, s.query, s.min_price, s.max_price, s.location AS wanted FROM recent r JOIN search s ON r.brand = s.query WHERE s.active),
 n AS (SELECT *, {_PLAIN.format("title")} AS t, string_split({_PLAIN.format("query")}, ' ') AS words, {_PLAIN.format("place")} AS p, {_PLAIN.format("wanted")} AS w FROM j),
 l AS (SELECT search_id, listing_id, list_filter([CASE WHEN price < min_price THEN 'below_minimum_price' END, CASE WHEN price > max_price THEN 'over_budget' END, CASE WHEN string_split(kind, ' ')[1] <> category THEN 'category_mismatch' END,
 CASE WHEN len(list_filter(words, lambda x: length(x) >= 2 AND NOT contains(t, x) AND NOT contains(replace(t, ' ', ''), x))) > 0 THEN 'query_mismatch' END, CASE WHEN contains(t, 'steel') THEN 'forbidden_word:steel' END,
 CASE WHEN place IS NULL THEN 'location_unknown' END, CASE WHEN place IS NOT NULL AND NOT contains(p, w) THEN 'location_mismatch' END], lambda x: x IS NOT NULL) AS r FROM n)
 SELECT search_id, listing_id, coalesce(array_to_string(r, ','), '') AS reasons, len(r) = 0 AS passed FROM l"""
