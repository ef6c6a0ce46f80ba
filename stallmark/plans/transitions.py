"""Queries over state machines: snapshots, stored results, claims, leases, matches; and comparables by category."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallmark.analyzers import Listing
from stallmark.analyzers.generic import GenericAnalyzer
from stallmark.analyzers.gpu import GpuAnalyzer
from stallmark.analyzers.notebook import NotebookAnalyzer
from stallmark.analyzers.registry import detect_category
from stallmark.analyzers.vehicle import VehicleAnalyzer
from stallmark.functions.hashing import input_hash
from stallmark.functions.text import made_once
from stallmark.operators import leases, matching, state, validation
from stallmark.operators.comparables import comparable_pairs, eligible
from stallmark.operators.snapshot_store import SnapshotStore
from stallmark.plans import texts, views
from stallmark.schema import LISTING, VERDICTS
from stallmark.shared import fresh_path, stored

_AT = "TIMESTAMP '2001-11-05 00:00:00'"


def _k() -> Column:
    return F.col("l_orderkey") + F.col("l_linenumber")


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All listings in the stored form; every seventh (by order and line) is a tombstone."""
    rows = views.listing_by_id(spark, sf_dir)
    given = {
        "images": F.array().cast("array<string>"), "attributes": F.create_map().cast("map<string,string>"), "first_seen_at": F.col("seen_at"), "last_seen_at": F.col("seen_at"), "fingerprint": F.col("title"), "content_hash": F.concat("title", F.col("quantity").cast("int").cast("string")),
        "suppressed_at": F.when(_k() % 7 == 0, F.lit(views.AS_OF)),
    }
    cell = lambda f: given[f.name] if f.name in given else F.col(f.name) if f.name in rows.columns else F.lit(None)
    return rows.select(*(cell(f).cast(f.dataType).alias(f.name) for f in LISTING), _k().alias("k"))


def _table(spark: SparkSession, sf_dir: str, of: str, /, **columns: Column) -> DataFrame:
    return views.table(spark, sf_dir, of).select(*(c.alias(n) for n, c in columns.items()))


def fenced_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates whose fence is that of the live row are accepted; of a third the hash, of a fifth the time has moved."""
    rows = snapshot(spark, sf_dir).withColumn("updated_at", F.col("last_seen_at"))
    fence = F.struct(F.when(F.col("k") % 5 == 0, F.lit(views.AS_OF)).otherwise(F.col("updated_at")).alias("updated_at"), "fingerprint", F.when(F.col("k") % 3 == 0, "moved").otherwise(F.col("content_hash")).alias("content_hash"))
    updates = rows.select("listing_id", fence.alias("fence"))
    return state.fenced(rows, updates).select("listing_id", "accepted")


FENCED_UPDATES = f"WITH {views.LISTING}, r AS (SELECT listing_id, l_orderkey + l_linenumber AS k, seen_at FROM listing) SELECT listing_id, k % 7 <> 0 AND (k % 5 <> 0 OR seen_at = {_AT}) AND k % 3 <> 0 AS accepted FROM r"


def updated_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot after details of every second listing; tombstones stay as they are."""
    rows = snapshot(spark, sf_dir)
    details = rows.where("k % 2 = 0").select("listing_id", F.concat("title", F.lit(" (novo)")).alias("title"), F.lit("como novo").alias("description"), F.lit(99.5).alias("price"), F.lit("BRL").alias("currency"), "location", F.lit("Ana").alias("seller_name"), "url", F.lit("https://img.example/1").alias("image_url"), F.array(F.lit("https://img.example/1")).alias("images"), "attributes", "published_at")
    out = state.update_details(rows.drop("k"), details, views.AS_OF)
    return out.select("listing_id", "title", "description", "price", "currency", "seller_name", F.size("images").alias("images"), "last_checked_at", "last_seen_at", (F.length("content_hash") == 64).alias("rehashed"), F.col("suppressed_at").isNotNull().alias("gone"))


UPDATED_DETAILS = f"""WITH {views.LISTING}, r AS (SELECT *, l_orderkey + l_linenumber AS k FROM listing), h AS (SELECT *, k % 2 = 0 AND k % 7 <> 0 AS hit FROM r)
 SELECT listing_id, CASE WHEN hit THEN concat(title, ' (novo)') ELSE title END AS title, CASE WHEN hit THEN 'como novo' END AS description, CASE WHEN hit THEN 99.5 ELSE price END AS price, CASE WHEN hit THEN 'BRL' ELSE currency END AS currency,
 CASE WHEN hit THEN 'Ana' END AS seller_name, hit::INT AS images, CASE WHEN hit THEN {_AT} END AS last_checked_at, CASE WHEN hit THEN {_AT} ELSE seen_at END AS last_seen_at, hit AS rehashed, k % 7 = 0 AS gone FROM h"""


def saved_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions stored for two thirds of the parts meet those of a run for four fifths; a failed attempt does not
    overwrite what a model found in the same content."""
    k, text = F.col("p_partkey"), lambda c: F.lit(c).cast("string")
    p = views.table(spark, sf_dir, "part")
    stored = p.where(k % 3 != 0).select(k.alias("listing_id"), F.lit("gpu").alias("category"), F.concat(F.lit("h"), k % 2).alias("content_hash"), F.when(k % 4 != 0, "m1").alias("model"), text(None).alias("attempt_model"), F.lit(None).cast("timestamp_ntz").alias("attempted_at"), F.lit("old").alias("data"))
    failed = k % 2 == 0
    incoming = p.where(k % 5 != 0).select(k.alias("listing_id"), F.when(k % 11 == 0, "car").otherwise("gpu").alias("category"), F.when(k % 7 == 0, "h9").otherwise(F.concat(F.lit("h"), k % 2)).alias("content_hash"), F.when(~failed, "m2").alias("model"), F.lit("m2").alias("attempt_model"), F.lit(views.AS_OF).alias("attempted_at"), F.lit("new").alias("data"))
    return state.save_extractions(stored, incoming)


SAVED_EXTRACTIONS = f"""WITH s AS (SELECT p_partkey AS k, concat('h', p_partkey % 2) AS h, CASE WHEN p_partkey % 4 <> 0 THEN 'm1' END AS model FROM part WHERE p_partkey % 3 <> 0),
 i AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'car' ELSE 'gpu' END AS category, CASE WHEN p_partkey % 7 = 0 THEN 'h9' ELSE concat('h', p_partkey % 2) END AS h, CASE WHEN p_partkey % 2 <> 0 THEN 'm2' END AS model FROM part WHERE p_partkey % 5 <> 0),
 j AS (SELECT coalesce(s.k, i.k) AS k, s.h AS sh, i.h AS ih, s.model AS sm, i.model AS im, i.category AS ic, i.k IS NULL OR coalesce(i.model IS NULL AND s.model IS NOT NULL AND s.h = i.h AND i.category = 'gpu', false) AS keep, i.k IS NOT NULL AS ran FROM s FULL JOIN i ON s.k = i.k)
 SELECT k AS listing_id, CASE WHEN keep THEN 'gpu' ELSE ic END AS category, CASE WHEN keep THEN sh ELSE ih END AS content_hash, CASE WHEN keep THEN sm ELSE im END AS model, CASE WHEN ran THEN 'm2' END AS attempt_model, CASE WHEN ran THEN {_AT} END AS attempted_at, CASE WHEN keep THEN 'old' ELSE 'new' END AS data FROM j"""


def saved_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored analyses meet those of a run: only a model's result replaces one, a failed attempt leaves its time."""
    k, text = F.col("p_partkey"), lambda c: F.lit(c).cast("string")
    p = views.table(spark, sf_dir, "part").select(k, k.cast("string").alias("listing_id"), (k % 10).cast("string").alias("search_id"), F.lit("i").alias("input_hash"))
    key = ["listing_id", "search_id", "input_hash"]
    stored = p.where(k % 3 != 0).select(*key, F.concat(F.lit("a"), k).alias("analysis_id"), F.lit(50).alias("score"), text(None).alias("analysis_model"), F.lit(None).cast("timestamp_ntz").alias("llm_attempted_at"))
    incoming = p.where(k % 5 != 0).select(*key, F.concat(F.lit("b"), k).alias("analysis_id"), F.lit(80).alias("score"), F.when(k % 2 == 0, "m").alias("analysis_model"), F.when(k % 7 == 0, F.lit(views.AS_OF)).alias("llm_attempted_at"))
    return state.save_analyses(stored, incoming)


SAVED_ANALYSES = f"""WITH j AS (SELECT p_partkey AS k, p_partkey % 3 <> 0 AS old, p_partkey % 5 <> 0 AS new, p_partkey % 2 = 0 AS ran, p_partkey % 7 = 0 AS tried FROM part)
 SELECT k::VARCHAR AS listing_id, (k % 10)::VARCHAR AS search_id, 'i' AS input_hash, CASE WHEN old THEN concat('a', k) ELSE concat('b', k) END AS analysis_id, CASE WHEN new AND (NOT old OR ran) THEN 80 ELSE 50 END AS score,
 CASE WHEN new AND ran THEN 'm' END AS analysis_model, CASE WHEN new AND tried THEN {_AT} END AS llm_attempted_at FROM j WHERE old OR new"""


def reused_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings whose analysis can be used again: the hash of all that it rests on is that of a stored one."""
    k = F.col("p_partkey")
    p = views.table(spark, sf_dir, "part")
    stored = p.where(k % 4 != 0).select(k.alias("listing_id"), input_hash(title=F.col("p_name"), price=F.col("p_retailprice"), market=F.col("p_brand"), reasons=F.array("p_type")).alias("input_hash"), F.col("p_size").alias("score"))
    now = p.select(k.alias("listing_id"), input_hash(title=F.col("p_name"), price=F.col("p_retailprice") + F.when(k % 3 == 0, 1).otherwise(0), market=F.when(k % 5 == 0, "other").otherwise(F.col("p_brand")), reasons=F.array("p_type")).alias("input_hash"))
    return state.reusable(now, stored, ["listing_id"]).select("listing_id", "reused", "score")


REUSED_ANALYSES = "WITH j AS (SELECT p_partkey AS k, p_size, p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 AND (p_partkey % 5 <> 0 OR p_brand = 'other') AS reused FROM part) SELECT k AS listing_id, reused, CASE WHEN reused THEN p_size END AS score FROM j"


def settled_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed notifications after delivery: outcomes of an older claim change nothing."""
    k, none = F.col("c_custkey"), F.lit(None).cast("timestamp_ntz")
    at = F.lit(views.AS_OF)
    notes = _table(spark, sf_dir, "customer", notification_id=k, status=F.when(k % 4 == 0, "sending").when(k % 4 == 1, "failed").when(k % 4 == 2, "pending").otherwise("sent"), attempts=(k % 3).cast("int"), claimed_at=F.when(k % 4 == 0, at), sent_at=F.when(k % 4 == 3, at).otherwise(none), last_error=F.when(k % 4 == 1, "e"))
    outcomes = notes.where("notification_id % 5 <> 0").select("notification_id", at.alias("claimed_at"), (F.col("attempts") + F.when(F.col("notification_id") % 7 == 0, 1).otherwise(0)).alias("attempts"), (F.col("notification_id") % 8 == 0).alias("ok"), F.lit("timeout").alias("why"))
    return state.settle(notes, outcomes, F.col("why"), views.AS_OF)


SETTLED_NOTIFICATIONS = f"""WITH n AS (SELECT c_custkey AS k, c_custkey % 4 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AS hit, c_custkey % 8 = 0 AS ok FROM customer)
 SELECT k AS notification_id, (k % 3)::INT AS attempts, CASE WHEN hit AND ok THEN 'sent' WHEN hit THEN 'failed' ELSE CASE k % 4 WHEN 0 THEN 'sending' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' ELSE 'sent' END END AS status,
 CASE WHEN NOT hit AND k % 4 = 0 THEN {_AT} END AS claimed_at, CASE WHEN hit AND ok OR k % 4 = 3 THEN {_AT} END AS sent_at, CASE WHEN hit AND NOT ok THEN 'timeout' WHEN k % 4 = 1 THEN 'e' END AS last_error FROM n"""


def leased_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases taken where free, expired or one's own, of active searches that were asked for; then those of one run
    given back, which ran now."""
    k, at = F.col("c_custkey"), F.lit(views.AS_OF)
    rows = _table(spark, sf_dir, "customer", search_id=k, active=k % 7 != 0, run_lease_id=F.when(k % 3 == 1, "other").when(k % 3 == 2, "mine"), run_lease_expires_at=F.when(k % 3 != 0, at + F.make_dt_interval(mins=F.when(k % 2 == 0, 5).otherwise(-5))), last_run_at=F.lit(None).cast("timestamp_ntz"))
    out = state.lease(rows, rows.where("search_id % 5 <> 0").select("search_id"), "mine", views.AS_OF)
    back = state.release(out, "mine", views.AS_OF, True)
    return out.select("search_id", "run_lease_id", "run_lease_expires_at").join(back.select("search_id", F.col("run_lease_id").alias("left"), "last_run_at"), "search_id")


LEASED_SEARCHES = f"""WITH s AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 1 THEN 'other' WHEN 2 THEN 'mine' END AS id, CASE WHEN c_custkey % 3 <> 0 THEN {_AT} + CASE WHEN c_custkey % 2 = 0 THEN INTERVAL 5 MINUTE ELSE INTERVAL (-5) MINUTE END END AS until FROM customer),
 l AS (SELECT *, k % 5 <> 0 AND k % 7 <> 0 AND (id IS NULL OR until <= {_AT} OR id = 'mine') AS ok FROM s), o AS (SELECT k, CASE WHEN ok THEN 'mine' ELSE id END AS id, CASE WHEN ok THEN {_AT} + INTERVAL 30 MINUTE ELSE until END AS until FROM l)
 SELECT k AS search_id, id AS run_lease_id, until AS run_lease_expires_at, CASE WHEN id <> 'mine' THEN id END AS "left", CASE WHEN id = 'mine' THEN {_AT} END AS last_run_at FROM o"""


def lease_contention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a call of one of three workers on its user's search: sign-ups and clicks want the lease, views renew it,
    purchases complete a run and errors fail it. Every fourth caller last read the search when someone last bought."""
    e, u = views.table(spark, sf_dir, "events"), F.col("user_id")
    before = F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    kind = F.when(F.col("event_type") == "view", "renew").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").otherwise("acquire")
    calls = e.select(u.alias("search_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), kind.alias("kind"), F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")).alias("lease_id"), before.alias("seen_last_run_at"), (F.col("event_id") % 4 != 0).alias("fresh"))
    held = u % 3 == 1
    rows = e.groupBy("user_id").agg(F.min("ts").alias("ts")).select(u.alias("search_id"), (u % 7 != 0).alias("active"), F.when(held, "w1").alias("run_lease_id"), F.when(held, F.col("ts") + F.make_dt_interval(hours=F.lit(40))).alias("run_lease_expires_at"), F.lit(None).cast("timestamp_ntz").alias("last_run_at"))
    return leases.replay(rows, calls, minutes=1200)


LEASE_CONTENTION = """WITH RECURSIVE c AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN 'renew' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'acquire' END AS kind, concat('w', event_id % 3) AS w, event_id % 4 <> 0 AS fresh,
 max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, min(ts) OVER (PARTITION BY user_id) AS t0 FROM events),
 s AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS outcome, 0::BIGINT AS fence, CASE WHEN user_id % 3 = 1 THEN 'w1' END AS holder, CASE WHEN user_id % 3 = 1 THEN t0 + INTERVAL 40 HOUR END AS expires, NULL::TIMESTAMP AS last_run FROM c WHERE n = 1 UNION ALL
 SELECT user_id, n, event_id, o, fence + (o = 'granted')::INT, CASE o WHEN 'granted' THEN w WHEN 'released' THEN NULL ELSE holder END, CASE WHEN o IN ('granted', 'renewed') THEN ts + INTERVAL 1200 MINUTE WHEN o = 'released' THEN NULL ELSE expires END, CASE WHEN o = 'released' AND kind = 'complete' THEN ts ELSE last_run END
 FROM (SELECT c.*, s.fence, s.holder, s.expires, s.last_run, CASE WHEN kind = 'acquire' THEN CASE WHEN c.user_id % 7 = 0 OR NOT fresh AND last_run IS DISTINCT FROM seen OR holder IS NOT NULL AND expires > ts THEN 'refused' ELSE 'granted' END
 WHEN holder IS DISTINCT FROM w THEN CASE WHEN kind = 'renew' THEN 'lost' ELSE 'missed' END WHEN kind = 'renew' THEN 'renewed' ELSE 'released' END AS o FROM s JOIN c ON c.user_id = s.user_id AND c.n = s.n + 1))
 SELECT user_id::VARCHAR AS search_id, seq, outcome, fence, holder, expires AS expires_at, last_run AS last_run_at FROM s WHERE n > 0"""


def snapshot_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored snapshot after a batch of all even lines and, a day later, one of some odd and some cheaper even lines, which
    then comes once more with other prices: every listing with its price, first and last sight and price points."""
    n, order = F.col("l_linenumber"), F.col("l_orderkey")
    one, two = n % 2 == 0, (n % 2 == 1) & (order % 64 == 1) | (n % 4 == 2) & (order % 64 == 3)
    rows = stored(views.listing(spark, sf_dir).where(one | two).select("listing_id", "source", "external_id", "title", "price", "currency", "location", "url", "category", "l_linenumber", "l_orderkey"), "listings")
    batch = lambda df, price: df.select(F.xxhash64("listing_id").alias("seq"), "source", "external_id", "title", price.alias("price"), "currency", "location", "url", F.lit(None).cast("string").alias("image_url"), "category")
    store = SnapshotStore(spark, fresh_path(spark, "snapshot"), buckets=32)
    store.apply(1, batch(rows.where(one), F.col("price")), views.AS_OF)
    for cut in (1.0, 500.0):
        store.apply(2, batch(rows.where(two), F.col("price") - cut), views.AS_OF + timedelta(days=1))
    points = store.history().groupBy("listing_id").agg(F.count("*").alias("points"))
    out = store.snapshot().join(points, "listing_id", "left")
    return out.select("listing_id", F.round("price", 2).alias("price"), "first_seen_at", "last_seen_at", F.coalesce("points", F.lit(0)).alias("points"))


SNAPSHOT_BATCHES = f"""WITH {views.LISTING}, a AS (SELECT listing_id, price FROM listing WHERE l_linenumber % 2 = 0),
 b AS (SELECT listing_id, price - 1 AS price FROM listing WHERE l_linenumber % 2 = 1 AND l_orderkey % 64 = 1 OR l_linenumber % 4 = 2 AND l_orderkey % 64 = 3)
 SELECT listing_id, round(CASE WHEN b.listing_id IS NULL THEN a.price ELSE b.price END, 2) AS price, CASE WHEN a.listing_id IS NULL THEN {_AT} + INTERVAL 1 DAY ELSE {_AT} END AS first_seen_at,
 CASE WHEN b.listing_id IS NULL THEN {_AT} ELSE {_AT} + INTERVAL 1 DAY END AS last_seen_at, (a.price IS NOT NULL)::BIGINT + (b.price IS NOT NULL)::BIGINT AS points FROM a FULL JOIN b USING (listing_id)"""


def saved_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match table after a run: pairs put in order, of live listings, the newest confidence for each."""
    k, name = F.col("p_partkey"), lambda c: F.lpad(c.cast("string"), 9, "0")
    p = views.table(spark, sf_dir, "part")
    pair = lambda a, b, c, r: (name(a).alias("a"), name(b).alias("b"), F.lit(c).alias("confidence"), F.array(F.lit(r)).alias("reasons"))
    known = p.where(k % 3 == 0).select(*pair(k, k + 1, 0.7, "known"))
    found = p.where(k % 2 == 0).select(*pair(k + 1, k, 0.9, "found")).unionByName(p.where(k % 4 == 0).select(*pair(k, k + 1, 0.8, "again"))).unionByName(p.select(*pair(k, k, 1.0, "self")))
    live = p.select(name(k).alias("listing_id"), F.when(k % 10 == 0, F.lit(views.AS_OF)).alias("suppressed_at"))
    return matching.save_matches(known, found, live).select("a", "b", "confidence", F.array_join("reasons", ",").alias("reasons"))


SAVED_MATCHES = """WITH f AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 10 <> 0 AND (p_partkey + 1) % 10 <> 0 AND p_partkey + 1 < (SELECT count(*) FROM part)), n AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 = 0 AND p_partkey NOT IN (SELECT k FROM f)), u AS (SELECT k, 0.9 AS c, 'found' AS r FROM f UNION ALL SELECT k, 0.7, 'known' FROM n)
 SELECT lpad(k::VARCHAR, 9, '0') AS a, lpad((k + 1)::VARCHAR, 9, '0') AS b, c::DOUBLE AS confidence, r AS reasons FROM u"""


def merged_supplements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that the text did not give are filled from a proposal; arrays are united."""
    k, text = F.col("p_partkey"), lambda c: F.lit(c).cast("string")
    own = F.struct(F.when(k % 2 == 0, "unknown").when(k % 3 == 0, text(None)).otherwise("flex").alias("fuel"), F.when(k % 5 != 0, F.col("p_size")).alias("year"), F.array(F.lit("a"), F.lit("b")).alias("defects"))
    proposed = F.struct(F.when(k % 7 != 0, "diesel").alias("fuel"), F.lit(1999).alias("year"), F.when(k % 2 == 0, F.array(F.lit("b"), F.lit("c"))).alias("defects"))
    merged = state.merge_supplement(own, proposed, {"fuel": "string", "year": "int", "defects": "array<string>"})
    return views.table(spark, sf_dir, "part").withColumn("m", merged).select(k, "m.fuel", "m.year", F.array_join("m.defects", ",").alias("defects"))


MERGED_SUPPLEMENTS = """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 7 <> 0 THEN 'diesel' ELSE 'unknown' END WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 7 <> 0 THEN 'diesel' END ELSE 'flex' END AS fuel,
 CASE WHEN p_partkey % 5 <> 0 THEN p_size ELSE 1999 END AS year, CASE WHEN p_partkey % 2 = 0 THEN 'a,b,c' ELSE 'a,b' END AS defects FROM part"""


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search definitions as a form gives them, some of them wrong in one field or more."""
    k, year = F.col("c_custkey"), lambda c: c.cast("int")
    return _table(
        spark, sf_dir, "customer", k=k, search_id=F.concat(F.lit("s"), k), name=F.when(k % 31 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("c_name"))), query=F.col("c_mktsegment"), category=F.when(k % 29 == 0, "boats").otherwise("vehicle"), providers=F.when(k % 23 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("olx"), F.lit("facebook"), F.lit("olx"))),
        min_price=F.when(k % 3 == 0, F.col("c_acctbal")), max_price=F.when(k % 5 == 0, F.lit(100.0)), min_year=year(F.when(k % 7 == 0, 2010)), max_year=year(F.when(k % 2 == 0, 2005)), location=F.when(k % 4 != 0, "Joinville"), radius_km=year(F.when(k % 11 == 0, 50)), minimum_score=(k % 120).cast("int"), interval_minutes=(k % 90).cast("int"),
        forbidden_words=F.array(F.lit(" leilão "), F.lit("leilão"), F.when(k % 13 == 0, " ").otherwise("sucata")),
    )


_SEARCHES = """q AS (SELECT c_custkey AS k, c_name, c_mktsegment AS query, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS lo, CASE WHEN c_custkey % 5 = 0 THEN 100.0 END AS hi FROM customer),
 r AS (SELECT *, concat_ws(',', CASE WHEN k % 31 = 0 THEN 'name' END, CASE WHEN k % 29 = 0 THEN 'category' END, CASE WHEN k % 23 = 0 THEN 'providers' END, CASE WHEN lo < 0 OR lo > hi THEN 'min_price' END, CASE WHEN k % 14 = 0 THEN 'min_year' END,
 CASE WHEN k % 11 = 0 AND k % 4 = 0 THEN 'radius_km' END, CASE WHEN k % 120 > 100 THEN 'minimum_score' END, CASE WHEN k % 90 = 0 THEN 'interval_minutes' END, CASE WHEN k % 13 = 0 THEN 'forbidden_words' END) AS reasons FROM q)"""


def search_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searches(spark, sf_dir).select("search_id", F.array_join(validation.search_reasons(), ",").alias("reasons"))


SEARCH_REASONS = f"WITH {_SEARCHES} SELECT concat('s', k) AS search_id, reasons FROM r"


def search_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid definitions as they are stored: trimmed, without repeated providers and words."""
    good, _ = validation.split_valid(searches(spark, sf_dir), validation.search_reasons())
    return validation.normal_searches(good).select("search_id", "name", F.array_join("providers", ",").alias("providers"), F.array_join("forbidden_words", ",").alias("forbidden_words"), "min_price", "max_price")


SEARCH_DEFINITIONS = f"WITH {_SEARCHES} SELECT concat('s', k) AS search_id, c_name AS name, 'olx,facebook' AS providers, 'leilão,sucata' AS forbidden_words, lo AS min_price, hi AS max_price FROM r WHERE reasons = ''"


def legacy_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old definitions made to fit."""
    out = validation.clean_legacy_searches(searches(spark, sf_dir))
    return out.select("search_id", "name", "location", "min_price", "max_price", "min_year", "max_year", "radius_km", "minimum_score", "interval_minutes", F.array_join("forbidden_words", ",").alias("forbidden_words"))


LEGACY_SEARCHES = f"""WITH {_SEARCHES}, p AS (SELECT *, CASE WHEN lo BETWEEN 0 AND 999999999999.99 THEN lo END AS mn, CASE WHEN k % 7 = 0 THEN 2010 END AS y, CASE WHEN k % 2 = 0 THEN 2005 END AS z FROM r)
 SELECT concat('s', k) AS search_id, CASE WHEN k % 31 = 0 THEN concat('s', k) ELSE c_name END AS name, CASE WHEN k % 4 <> 0 THEN 'Joinville' END AS location, CASE WHEN mn IS NOT NULL THEN least(mn, coalesce(hi, mn)) END::DOUBLE AS min_price,
 CASE WHEN hi IS NOT NULL THEN greatest(hi, coalesce(mn, hi)) END::DOUBLE AS max_price, CASE WHEN y IS NOT NULL THEN least(y, coalesce(z, y)) END AS min_year, CASE WHEN z IS NOT NULL THEN greatest(z, coalesce(y, z)) END AS max_year,
 CASE WHEN k % 4 <> 0 AND k % 11 = 0 THEN 50 END AS radius_km, least(100, k % 120)::INT AS minimum_score, greatest(1, k % 90)::INT AS interval_minutes, CASE WHEN k % 13 = 0 THEN 'leilão' ELSE 'leilão,sucata' END AS forbidden_words FROM p"""


def table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows break each standing rule of the stored tables."""
    k, p, at = F.col("c_custkey"), F.col("p_partkey"), F.lit(views.AS_OF)
    held = searches(spark, sf_dir).withColumns({"run_lease_id": F.when(F.col("k") % 3 == 0, "x"), "run_lease_expires_at": F.when(F.col("k") % 2 == 0, at)})
    analyses = _table(spark, sf_dir, "part", score=(p % 120).cast("int"), deterministic_score=(p % 95).cast("int"), verdict=F.when(p % 6 == 0, "nice").otherwise(F.lit(VERDICTS[0])))
    matches = _table(spark, sf_dir, "part", a=p, b=p + p % 3, confidence=(p % 9) / 7)
    notes = _table(spark, sf_dir, "customer", status=F.when(k % 3 == 0, "sent").when(k % 3 == 1, "sending").otherwise("lost"), sent_at=F.when(k % 2 == 0, at), claimed_at=F.when(k % 5 != 0, at))
    return validation.table_checks(held, analyses, matches, notes)


TABLE_CHECKS = f"""WITH {_SEARCHES} SELECT 'search_definition' AS rule, count(*) FILTER (reasons <> '') AS broken FROM r UNION ALL SELECT 'search_lease', count(*) FILTER ((k % 3 = 0) <> (k % 2 = 0)) FROM r
 UNION ALL SELECT 'analysis_score', count(*) FILTER (p_partkey % 120 > 100 OR p_partkey % 95 > 90) FROM part UNION ALL SELECT 'analysis_verdict', count(*) FILTER (p_partkey % 6 = 0) FROM part
 UNION ALL SELECT 'match_pair', count(*) FILTER (p_partkey % 3 = 0 OR p_partkey % 9 > 7) FROM part
 UNION ALL SELECT 'notification_status', count(*) FILTER (CASE c_custkey % 3 WHEN 0 THEN c_custkey % 2 <> 0 WHEN 1 THEN c_custkey % 2 = 0 OR c_custkey % 5 = 0 ELSE true END) FROM customer"""


def _comparables(spark: SparkSession, sf_dir: str, analyzer) -> DataFrame:
    """Per advertisement of the analyzer's category: how many of the 250 newest others compare, and their median price."""
    k = F.col("p_partkey")
    rows = texts.ads(spark, sf_dir).join(views.table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price")), "p_partkey")
    data = analyzer.extract(Listing(F.col("title"), F.col("description"), F.col("attributes")))
    rows = rows.withColumn("category", made_once(detect_category(F.col("title"), F.col("description")))).select(k.alias("listing_id"), "category", F.when(k % 10 != 0, "BRL").alias("currency"), "price", (F.lit(views.AS_OF) - F.make_dt_interval(hours=(k % 300).cast("int"))).alias("last_seen_at"), made_once(data).alias("data"))
    pool = rows.where(F.col("category") == analyzer.category)
    pairs = comparable_pairs(pool, pool, analyzer)
    return pairs.groupBy(F.col("target.listing_id").alias("listing_id")).agg(F.count("*").alias("n"), F.round(F.median("candidate.price") + 1e-7, 4).alias("median_price"))


def _comparables_sql(kind: int, residual: str) -> str:
    return f"""WITH ad AS (SELECT p_partkey AS listing_id, p_retailprice AS price, CASE WHEN p_partkey % 10 <> 0 THEN 'BRL' ELSE '' END AS currency, {_AT} - INTERVAL (p_partkey % 300) HOUR AS last_seen_at, p_size, p_name FROM part WHERE p_partkey % 4 = {kind}),
 pool AS (SELECT *, row_number() OVER (PARTITION BY currency ORDER BY last_seen_at DESC, listing_id) AS r FROM ad)
 SELECT t.listing_id, count(*) AS n, round(median(c.price) + 1e-7, 4) AS median_price FROM pool t JOIN pool c ON t.currency = c.currency AND t.listing_id <> c.listing_id AND c.r - (c.r > t.r)::INT <= 250 AND {residual} GROUP BY t.listing_id"""


def comparables_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparables(spark, sf_dir, VehicleAnalyzer())


COMPARABLES_VEHICLE = _comparables_sql(0, "abs(t.p_size % 35 - c.p_size % 35) <= 2 AND abs(t.p_size - c.p_size) * 1000 <= greatest(30000, t.p_size * 350)")


#: What keeps an advertisement out of the pool: one of seven faults, or none, by a number mixed from key, size and price.
_FAULT = "(p_partkey * 7919 + p_size * 104729 + cast(floor(p_retailprice * 10 + 0.5) AS BIGINT)) % 13"


def comparables_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cars compared with what may be compared: of the pool, rows that are inactive, suppressed, long unseen, without price or
    without extraction are left out before the newest 250 are taken; targets are all that are not suppressed and extracted."""
    analyzer, k, fault = VehicleAnalyzer(), F.col("p_partkey"), F.expr(_FAULT)
    rows = texts.ads(spark, sf_dir).join(views.table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_partkey").where(k % 4 == 0)
    data = analyzer.extract(Listing(F.col("title"), F.col("description"), F.col("attributes")))
    rows = rows.select(
        k.alias("listing_id"), F.lit("vehicle").alias("category"), F.lit("BRL").alias("currency"), F.when(fault == 1, 0.0).when(fault != 2, F.col("p_retailprice")).alias("price"),
        (F.lit(views.AS_OF) - F.make_dt_interval(days=F.when(fault == 3, 91).otherwise(0).cast("int"), hours=(k % 300).cast("int"))).alias("last_seen_at"),
        (fault != 4).alias("active"), F.when(fault == 5, F.lit(views.AS_OF)).alias("suppressed_at"), made_once(F.when(fault != 6, data)).alias("data"),
    )
    pairs = comparable_pairs(rows.where("suppressed_at is null and data is not null"), rows.where(eligible(views.AS_OF, 90)), analyzer)
    return pairs.groupBy(F.col("target.listing_id").alias("listing_id")).agg(F.count("*").alias("n"), F.round(F.median("candidate.price") + 1e-7, 4).alias("median_price"))


COMPARABLES_ELIGIBLE = f"""WITH ad AS (SELECT *, {_FAULT} AS fault, {_AT} - INTERVAL (p_partkey % 300) HOUR AS seen FROM part WHERE p_partkey % 4 = 0),
 pool AS (SELECT *, row_number() OVER (ORDER BY seen DESC, p_partkey) AS r FROM ad WHERE fault NOT IN (1, 2, 3, 4, 5, 6)), t AS (SELECT ad.*, r FROM ad LEFT JOIN pool USING (p_partkey) WHERE ad.fault NOT IN (5, 6))
 SELECT t.p_partkey AS listing_id, count(*) AS n, round(median(c.p_retailprice) + 1e-7, 4) AS median_price FROM t JOIN pool c ON t.p_partkey <> c.p_partkey AND c.r - coalesce((c.r > t.r)::INT, 0) <= 250
 AND abs(t.p_size % 35 - c.p_size % 35) <= 2 AND abs(t.p_size - c.p_size) * 1000 <= greatest(30000, t.p_size * 350) GROUP BY t.p_partkey"""


def comparables_gpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparables(spark, sf_dir, GpuAnalyzer())


COMPARABLES_GPU = _comparables_sql(1, "t.p_size % 3 = c.p_size % 3")


def comparables_notebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparables(spark, sf_dir, NotebookAnalyzer())


COMPARABLES_NOTEBOOK = _comparables_sql(2, "t.p_size % 2 = c.p_size % 2")


def comparables_electronics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparables(spark, sf_dir, GenericAnalyzer("electronics"))


COMPARABLES_ELECTRONICS = _comparables_sql(3, "t.p_name = c.p_name AND t.p_size % 5 <> 0 AND c.p_size % 5 <> 0")
