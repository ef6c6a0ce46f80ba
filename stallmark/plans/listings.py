"""Queries over identity, state and matches of listings, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmark.operators import dedup, filters, matching, reports, state, validation
from stallmark.plans import views
from stallmark.schema import SOURCES
from stallmark.shared import stored

_KEY = "CASE WHEN external_id IS NOT NULL THEN concat(source, ':id:', external_id) ELSE concat(source, ':url:https://example.com/item/', l_orderkey::VARCHAR, '/', l_linenumber::VARCHAR, '?v=1') END"


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed with the first arrival of each identity only."""
    out = dedup.deduplicate_listings(views.feed(spark, sf_dir), views.ARRIVAL)
    return out.select("dedup_key", "l_orderkey", "l_linenumber", "l_partkey", "title", "price", "seen_at")


DEDUP_FIRST = f"""WITH {views.FEED}, k AS (SELECT *, {_KEY} AS dedup_key FROM feed) SELECT dedup_key, l_orderkey, l_linenumber, l_partkey, title, price, seen_at
 FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY {", ".join(views.ARRIVAL)}) AS rn FROM k) WHERE rn = 1"""


def union_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feeds of the three sources, deduplicated apart and together."""
    f = views.feed(spark, sf_dir)
    out = dedup.union_batches([f.where(F.col("source") == s) for s in SOURCES], views.ARRIVAL)
    return out.select("source", "external_id", "l_orderkey", "l_linenumber", "price")


UNION_BATCHES = f"WITH {views.LISTING} SELECT source, external_id, l_orderkey, l_linenumber, price FROM listing"


def invalid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed rows that a run would turn away, by reasons: some made bad on purpose."""
    f = views.feed(spark, sf_dir).withColumn("image_url", F.lit(None).cast("string"))
    k = F.col("l_orderkey")
    f = f.withColumns({"title": F.when(k % 11 == 0, " ").otherwise(F.col("title")), "currency": F.when(k % 17 == 0, "R$").otherwise(F.col("currency")), "url": F.when(k % 19 == 0, "ftp://example.com/x").otherwise(F.col("url")), "price": F.when(k % 23 == 0, -1.0).otherwise(F.col("price"))})
    _, bad = validation.split_valid(f, validation.summary_reasons())
    return bad.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


INVALID_ROWS = f"""WITH {views.FEED}, r AS (SELECT array_to_string(list_filter([CASE WHEN l_orderkey % 11 = 0 THEN 'title' END, CASE WHEN l_orderkey % 23 = 0 THEN 'price' END,
 CASE WHEN l_orderkey % 17 = 0 THEN 'currency' END, CASE WHEN l_orderkey % 19 = 0 THEN 'url' END], lambda x: x IS NOT NULL), ',') AS reasons FROM feed) SELECT reasons, count(*) AS n FROM r WHERE reasons <> '' GROUP BY reasons"""


def latest_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as analyses of an order by a supplier: one of each kept, a returned one first."""
    li = views.table(spark, sf_dir, "lineitem").where("l_linenumber is not null")
    a = li.select(F.col("l_orderkey").alias("listing_id"), (F.col("l_suppkey") % 5).alias("search_id"), F.col("l_linestatus").alias("input_hash"), F.col("l_shipdate").alias("created_at"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("analysis_id"), "l_returnflag")
    n = a.where("l_returnflag = 'R'").select("analysis_id")
    out = dedup.latest_analyses(a, n)
    return out.select("listing_id", "search_id", "input_hash", "created_at", F.col("analysis_id.l_partkey").alias("part"))


LATEST_ANALYSIS = """WITH a AS (SELECT l_orderkey AS listing_id, l_suppkey % 5 AS search_id, l_linestatus AS input_hash, l_shipdate AS created_at, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag FROM lineitem),
 n AS (SELECT DISTINCT l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, true AS hit FROM a WHERE l_returnflag = 'R'),
 j AS (SELECT a.*, coalesce(hit, false) AS hit FROM a LEFT JOIN n USING (l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity))
 SELECT listing_id, search_id, input_hash, created_at, l_partkey AS part FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, search_id, input_hash
 ORDER BY hit DESC, created_at DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn FROM j) WHERE rn = 1"""


def canonical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as matches of a part and a supplier's number: each unordered pair once, the best."""
    li = views.table(spark, sf_dir, "lineitem")
    m = li.select((F.col("l_partkey") % 50).alias("a"), (F.col("l_orderkey") % 50).alias("b"), F.col("l_discount").alias("confidence"), F.col("l_shipdate").alias("updated_at"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("match_id"))
    return dedup.canonical_pairs(m).select("a", "b", "confidence", "updated_at")


CANONICAL_PAIRS = """SELECT a, b, confidence, updated_at FROM (SELECT least(l_partkey % 50, l_orderkey % 50) AS a, greatest(l_partkey % 50, l_orderkey % 50) AS b, l_discount AS confidence, l_shipdate AS updated_at,
 row_number() OVER (PARTITION BY least(l_partkey % 50, l_orderkey % 50), greatest(l_partkey % 50, l_orderkey % 50) ORDER BY l_discount DESC, l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rn
 FROM lineitem WHERE l_partkey % 50 <> l_orderkey % 50) WHERE rn = 1"""


def one_notification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as notices of a user by type: an unsent one first, else the last sent."""
    e = views.table(spark, sf_dir, "events")
    n = e.select(F.col("user_id").alias("analysis_id"), F.col("event_type").alias("channel"), F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("sent_at"), F.col("event_id").alias("notification_id"))
    return dedup.one_notification(n)


ONE_NOTIFICATION = """SELECT analysis_id, channel, sent_at, notification_id FROM (SELECT user_id AS analysis_id, event_type AS channel, CASE WHEN event_id % 7 <> 0 THEN ts END AS sent_at, event_id AS notification_id,
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN event_id % 7 <> 0 THEN ts END DESC NULLS FIRST, event_id DESC) AS rn FROM events) WHERE rn = 1"""


def resolve_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later feed rows against a snapshot of the earlier ones: which listing each belongs to, if any."""
    f = views.feed(spark, sf_dir).withColumn("normalized_url", F.concat_ws("/", "l_orderkey", "l_linenumber"))
    day = F.lit("1998-01-01").cast("timestamp_ntz")
    old = f.where(F.col("seen_at") < day).select("source", "external_id", "normalized_url", F.concat_ws("/", "source", F.coalesce("external_id", F.concat(F.lit("u"), "normalized_url"))).alias("listing_id")).distinct()
    by = dedup.keep_first(old, ["listing_id"], ["normalized_url"])
    out = dedup.resolve_identity(f.where(F.col("seen_at") >= day), by)
    return out.select(*views.ARRIVAL, "listing_id")


RESOLVE_IDENTITY = f"""WITH {views.FEED}, f AS (SELECT *, concat(l_orderkey::VARCHAR, '/', l_linenumber::VARCHAR) AS nu FROM feed), o AS (SELECT DISTINCT source, external_id, nu FROM f WHERE seen_at < TIMESTAMP '1998-01-01'),
 n AS (SELECT f.*, EXISTS (SELECT 1 FROM o WHERE o.source = f.source AND o.external_id = f.external_id) AS by_id, EXISTS (SELECT 1 FROM o WHERE o.source = f.source AND o.external_id IS NULL AND o.nu = f.nu) AS by_url FROM f WHERE seen_at >= TIMESTAMP '1998-01-01')
 SELECT {", ".join(views.ARRIVAL)}, CASE WHEN by_id THEN concat(source, '/', external_id) WHEN by_url THEN concat(source, '/u', nu) END AS listing_id FROM n"""


def _matchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.listing(spark, sf_dir).withColumns({"last_seen_at": F.col("seen_at"), "suppressed_at": F.lit(None).cast("timestamp_ntz")})


def cross_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recent listing against the newest 100 of its category on other sources: the matches."""
    since = F.lit(views.AS_OF) - F.make_dt_interval(days=F.lit(views.WINDOW_DAYS))
    live = _matchable(spark, sf_dir).where(F.col("active") & (F.col("last_seen_at") >= since))
    live = stored(live.select("listing_id", "source", "category", "title", "price", "location", "active", "suppressed_at", "last_seen_at"), "live")
    out = matching.recent_matches(live, live, SOURCES, views.AS_OF, views.WINDOW_DAYS)
    return out.select("a", "b", F.round("confidence", 6).alias("confidence"), F.array_join("reasons", "; ").alias("reasons"))


_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(strip_accents(coalesce({}, ''))), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))"
CROSS_MATCH = f"""WITH {views.LISTING}, live AS (SELECT listing_id, source, category, price, seen_at, {_WORDS.format("title")} AS t, {_WORDS.format("location")} AS l FROM listing WHERE active AND seen_at >= TIMESTAMP '2001-11-05' - INTERVAL {views.WINDOW_DAYS} DAY),
 pool AS (SELECT * FROM (SELECT o.s AS left_out, live.*, row_number() OVER (PARTITION BY category, o.s ORDER BY seen_at DESC, listing_id) AS rn FROM live, (SELECT unnest(['facebook','olx','mercadolivre']) AS s) o WHERE o.s <> live.source) WHERE rn <= 100),
 p AS (SELECT a.listing_id AS a, b.listing_id AS b, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE AS j,
 coalesce(abs(a.price - b.price) / nullif(greatest(a.price, b.price), 0) <= 0.03 AND a.price IS NOT NULL AND b.price IS NOT NULL, false) AS priced,
 CASE WHEN len(a.l) > 0 AND len(b.l) > 0 THEN len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l)))::DOUBLE >= 0.5 ELSE false END AS placed
 FROM live a JOIN pool b ON a.category = b.category AND a.source = b.left_out),
 c AS (SELECT *, CASE WHEN j >= 0.65 THEN 0.5::DOUBLE * j ELSE 0::DOUBLE END + CASE WHEN priced THEN 0.3::DOUBLE ELSE 0::DOUBLE END + CASE WHEN placed THEN 0.2::DOUBLE ELSE 0::DOUBLE END AS c FROM p)
 SELECT a, b, round(least(1.0::DOUBLE, c), 6) AS confidence, concat_ws('; ', CASE WHEN j >= 0.65 THEN concat('Títulos semelhantes (', floor(j * 100 + 0.5)::INT::VARCHAR, '%)') END, CASE WHEN priced THEN 'Preços iguais ou muito próximos' END,
 CASE WHEN placed THEN 'Localizações semelhantes' END) AS reasons FROM c WHERE c >= 0.7"""


def similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct part titles with token Jaccard of 0.65 or more, by prefixes of their rarest words."""
    t = views.table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand", F.col("p_size").cast("string")).alias("title"))
    return matching.similar_titles(t)


SIMILAR_TITLES = f"""WITH t AS (SELECT DISTINCT concat(p_name, ' ', p_type, ' ', p_brand, ' ', p_size::VARCHAR) AS title FROM part), w AS (SELECT title, {_WORDS.format("title")} AS w FROM t)
 SELECT a.title AS x, b.title AS y FROM w a JOIN w b ON a.title < b.title WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.65"""


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent listings with what matching reads of them, made once: targets, and the pools of their brand and category."""
    r = views.recent(spark, sf_dir)
    return stored(r.select("brand", "category", "listing_id", "source", "title", "location", "price", F.col("seen_at").alias("last_seen_at")), "recent")


def exclude_cross_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates left to each target, of the 250 newest others of its brand and category, once those that match it are
    out."""
    return matching.unmatched_in_pool(_recent(spark, sf_dir), ["brand", "category"])


_HIT = """a.source <> b.source AND CASE WHEN len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE >= 0.65 THEN 0.5::DOUBLE * (len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE) ELSE 0::DOUBLE END
 + CASE WHEN abs(a.price - b.price) / nullif(greatest(a.price, b.price), 0) <= 0.03 THEN 0.3::DOUBLE ELSE 0::DOUBLE END
 + CASE WHEN len(a.l) > 0 AND len(b.l) > 0 AND len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l)))::DOUBLE >= 0.5 THEN 0.2::DOUBLE ELSE 0::DOUBLE END >= 0.7"""
_POOL = f"""w AS (SELECT listing_id, source, brand, category, price, {_WORDS.format("title")} AS t, {_WORDS.format("location")} AS l, row_number() OVER (PARTITION BY brand, category ORDER BY seen_at DESC, listing_id) AS r FROM recent),
 p AS (SELECT a.listing_id, b.listing_id AS other, b.r - (b.r > a.r)::INT AS pos, {_HIT} AS hit FROM w a JOIN w b ON a.brand = b.brand AND a.category = b.category AND a.listing_id <> b.listing_id AND b.r - (b.r > a.r)::INT <= 250)"""
EXCLUDE_CROSS_POSTS = f"WITH {views.RECENT}, {_POOL} SELECT listing_id, count(*) AS n FROM p WHERE NOT hit GROUP BY listing_id"


def greedy_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates of each target stay and go when each that matches an earlier kept one is dropped."""
    return matching.collapse_pools(_recent(spark, sf_dir), ["brand", "category"])


GREEDY_COLLAPSE = f"""WITH RECURSIVE {views.RECENT}, {_POOL}, h AS (SELECT a.listing_id AS other, list(b.listing_id) AS m FROM w a JOIN w b ON a.brand = b.brand AND a.category = b.category AND a.listing_id <> b.listing_id AND b.r <= 251 AND {_HIT} GROUP BY a.listing_id),
 c AS (SELECT p.listing_id, other, pos, coalesce(m, []) AS m FROM p LEFT JOIN h USING (other)),
 fold AS (SELECT DISTINCT listing_id, 0::BIGINT AS pos, []::VARCHAR[] AS kept, 0 AS dropped FROM c UNION ALL
 SELECT f.listing_id, c.pos, CASE WHEN list_has_any(f.kept, c.m) THEN f.kept ELSE list_append(f.kept, c.other) END, f.dropped + list_has_any(f.kept, c.m)::INT FROM fold f JOIN c ON c.listing_id = f.listing_id AND c.pos = f.pos + 1)
 SELECT listing_id, len(kept)::INT AS kept, dropped::INT AS dropped FROM fold JOIN (SELECT listing_id, max(pos) AS pos FROM c GROUP BY listing_id) USING (listing_id, pos)"""


def due_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.search(spark, sf_dir)
    ran = F.lit(views.AS_OF) - F.make_dt_interval(mins=(F.col("search_id") % 100).cast("int"))
    s = s.withColumn("last_run_at", F.when(F.col("search_id") % 9 != 0, ran))
    return s.where(filters.due(views.AS_OF)).select("search_id", "last_run_at")


DUE_SEARCHES = f"""WITH {views.SEARCH}, r AS (SELECT *, CASE WHEN search_id % 9 <> 0 THEN TIMESTAMP '2001-11-05' - INTERVAL 1 MINUTE * (search_id % 100) END AS last_run_at FROM search)
 SELECT search_id, last_run_at FROM r WHERE active AND (last_run_at IS NULL OR last_run_at + INTERVAL 1 MINUTE * interval_minutes <= TIMESTAMP '2001-11-05')"""


def needs_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.recent(spark, sf_dir).withColumn("last_checked_at", F.lit(views.AS_OF) - F.make_dt_interval(hours=(F.col("l_partkey") % 48).cast("int")))
    need = filters.needs_details(views.AS_OF, F.col("l_linenumber") == 1, F.col("size") == 1)
    return r.select("listing_id", need.alias("needs"))


NEEDS_DETAILS = f"WITH {views.RECENT} SELECT listing_id, l_linenumber = 1 OR size = 1 OR l_partkey % 48 > 24 AS needs FROM recent"


def claim_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as notices in every state, after a claim."""
    e = views.table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    status = F.when(k == 0, "pending").when(k == 1, "failed").when(k == 2, "sending").otherwise("sent")
    at = F.when(k == 2, F.lit(views.AS_OF) - F.make_dt_interval(mins=(F.col("event_id") % 31).cast("int")))
    n = e.select(F.col("event_id").alias("notification_id"), status.alias("status"), (F.col("event_id") % 3).alias("attempts"), at.alias("claimed_at"), F.when(k == 3, F.col("ts")).alias("sent_at"), F.when(k == 1, "timeout").alias("last_error"))
    return state.claim(n, views.AS_OF)


CLAIM_TRANSITION = """WITH n AS (SELECT event_id AS notification_id, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'sending' ELSE 'sent' END AS status, event_id % 3 AS attempts,
 CASE WHEN event_id % 4 = 2 THEN TIMESTAMP '2001-11-05' - INTERVAL 1 MINUTE * (event_id % 31) END AS claimed_at, CASE WHEN event_id % 4 = 3 THEN ts END AS sent_at, CASE WHEN event_id % 4 = 1 THEN 'timeout' END AS last_error FROM events),
 c AS (SELECT *, coalesce(status IN ('pending', 'failed') OR status = 'sending' AND claimed_at <= TIMESTAMP '2001-11-05' - INTERVAL 15 MINUTE, false) AS claimed FROM n)
 SELECT notification_id, CASE WHEN claimed THEN 'sending' ELSE status END AS status, attempts + claimed::INT AS attempts, CASE WHEN claimed THEN TIMESTAMP '2001-11-05' ELSE claimed_at END AS claimed_at,
 CASE WHEN NOT claimed THEN sent_at END AS sent_at, CASE WHEN NOT claimed THEN last_error END AS last_error, claimed FROM c"""


def search_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last time that a user met each type of event."""
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("search_id"), F.col("event_type").alias("listing_id"), F.col("ts").alias("matched_at"))
    half = F.lit("1998-01-01").cast("timestamp_ntz")
    known = state.links(e.limit(0).select("search_id", "listing_id", F.col("matched_at").alias("first_matched_at"), F.col("matched_at").alias("last_matched_at")), e.where(F.col("matched_at") < half))
    return state.links(known, e.where(F.col("matched_at") >= half))


SEARCH_LINKS = "SELECT user_id AS search_id, event_type AS listing_id, min(ts) AS first_matched_at, max(ts) AS last_matched_at FROM events GROUP BY ALL"


def snapshot(df: DataFrame, *given: str) -> DataFrame:
    """Listings of the views as rows of the stored table; columns that are given are taken as they are."""
    from stallmark.functions.hashing import fingerprint
    from stallmark.functions.urls import normalize_url
    from stallmark.schema import LISTING

    have = {
        "listing_id": F.concat_ws(":", "source", F.coalesce(F.concat(F.lit("id:"), "external_id"), F.concat(F.lit("url:"), normalize_url(F.col("url"))))),
        "fingerprint": fingerprint(F.col("source"), F.col("title"), F.col("price"), F.col("location")),
        "normalized_url": normalize_url(F.col("url")),
        "images": F.array().cast("array<string>"),
        "attributes": F.create_map().cast("map<string,string>"),
        "first_seen_at": F.col("seen_at"),
        "last_seen_at": F.col("seen_at"),
        "last_checked_at": F.col("seen_at"),
    }
    have = {n: c for n, c in have.items() if n not in given}
    return df.select(*(have.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LISTING.fields))


def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the even lines, some suppressed, after a batch of the odd lines and of half the even ones, some
    of them cheaper: what becomes of each listing."""
    rows = views.listing_by_id(spark, sf_dir)
    n = F.col("l_linenumber")
    old = snapshot(rows.where(n % 2 == 0), "listing_id").withColumn("suppressed_at", F.when(F.col("title").like("%STEEL%"), F.lit(views.AS_OF)))
    cheaper = F.when(F.col("l_orderkey") % 5 == 0, F.col("price") - 1).otherwise(F.col("price"))
    batch = rows.where((n % 2 == 1) | (n % 4 == 2)).select(F.xxhash64("listing_id").alias("seq"), "source", "external_id", "title", cheaper.alias("price"), "currency", "location", "url", F.lit(None).cast("string").alias("image_url"), "category")
    out = state.upsert_summaries(old, batch, views.AS_OF)
    return out.select("listing_id", "change", F.round("price_point", 2).alias("price_point"), F.round("price", 2).alias("price"))


UPSERT_SNAPSHOT = f"""WITH {views.LISTING}, o AS (SELECT *, title LIKE '%STEEL%' AS gone FROM listing WHERE l_linenumber % 2 = 0), b AS (SELECT *, CASE WHEN l_orderkey % 5 = 0 THEN price - 1 ELSE price END AS np FROM listing WHERE l_linenumber % 2 = 1 OR l_linenumber % 4 = 2),
 j AS (SELECT coalesce(o.listing_id, b.listing_id) AS listing_id, CASE WHEN b.listing_id IS NULL THEN NULL WHEN o.listing_id IS NULL THEN 'new' WHEN o.gone THEN 'suppressed' WHEN o.price IS DISTINCT FROM b.np THEN 'changed' ELSE 'same' END AS change, o.price AS op, b.np FROM o FULL JOIN b ON o.listing_id = b.listing_id)
 SELECT listing_id, change, CASE WHEN change IN ('new', 'changed') THEN round(np, 2) END AS price_point, round(CASE WHEN change IN ('new', 'changed', 'same') THEN np ELSE op END, 2) AS price FROM j"""


def suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recent listings, those of one brand made tombstones."""
    s = stored(snapshot(views.recent(spark, sf_dir)), "recent")  # few of all listings, read for both sides
    gone = s.where(F.col("title").like("%Brand#11%")).select("listing_id")
    out = state.suppress(s, gone, views.AS_OF)
    return out.select("listing_id", "external_id", "title", "price", "location", "active", "suppressed_at")


SUPPRESS = f"""WITH {views.RECENT}, g AS (SELECT *, title LIKE '%Brand#11%' AS gone FROM recent) SELECT listing_id, external_id, CASE WHEN gone THEN '[removido]' ELSE title END AS title, CASE WHEN NOT gone THEN price END AS price,
 CASE WHEN NOT gone THEN location END AS location, active AND NOT gone AS active, CASE WHEN gone THEN TIMESTAMP '2001-11-05' END AS suppressed_at FROM g"""


def recent_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 live listings, each with its newest analysis (an order's line by price)."""
    rows = _matchable(spark, sf_dir).where("active")
    li = views.table(spark, sf_dir, "lineitem")
    a = li.select(F.concat_ws(":", F.lit("olx"), F.concat(F.lit("id:"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"))).alias("listing_id"), F.col("l_shipdate").alias("created_at"), F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("analysis_id"), F.col("l_quantity").cast("int").alias("score"), F.col("l_returnflag").alias("verdict"))
    return reports.recent_listings(rows, a, 200)


RECENT_LISTINGS = f"""WITH {views.LISTING}, top AS (SELECT * FROM listing WHERE active ORDER BY seen_at DESC, listing_id LIMIT 200),
 a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn FROM (SELECT concat('olx:id:', l_orderkey::VARCHAR, '-', l_linenumber::VARCHAR) AS id, * FROM lineitem))
 SELECT top.listing_id, top.source, top.title, top.price, top.location, top.seen_at AS last_seen_at, a.l_quantity::INT AS score, a.l_returnflag AS verdict FROM top LEFT JOIN a ON a.id = top.listing_id AND a.rn = 1"""


def search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.search(spark, sf_dir).withColumns({"name": F.col("query"), "providers": F.array(F.lit("olx"), F.lit("facebook")), "min_year": F.lit(None).cast("int"), "max_year": F.lit(2000), "created_at": F.lit(views.AS_OF), "min_price": F.floor("min_price"), "max_price": F.floor("max_price")})
    return reports.search_list(s)


SEARCH_REPORT = f"""WITH {views.SEARCH} SELECT search_id, query AS name, query, category, 'olx, facebook' AS providers, concat(coalesce(floor(min_price)::BIGINT::VARCHAR, '—'), '–', coalesce(floor(max_price)::BIGINT::VARCHAR, '—')) AS price,
 '—–2000' AS years, minimum_score, interval_minutes, active FROM search"""


def deal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notice texts of the recent listings of olx."""
    r = views.recent(spark, sf_dir).where("source = 'olx'")
    l = F.struct("source", "title", F.floor("price").cast("double").alias("price"), "currency", "location", F.lit("https://www.olx.com.br/item/x-1").alias("url"))  # noqa: E741
    combined = F.struct(F.lit(1500.0).alias("median_price"), F.lit(12).alias("sample_size"), F.lit("high").alias("confidence"))
    text = reports.deal_notice(l, F.col("size"), F.array(F.col("brand")), F.array().cast("array<string>"), F.create_map(F.lit("olx"), F.lit(1500.0)), combined, F.lit(-12.34), SOURCES)
    return r.select("listing_id", text.alias("text"))


DEAL_REPORT = f"""WITH {views.RECENT}, m AS (SELECT *, replace(format('{{:,}}', floor(price)::BIGINT), ',', '.') AS d FROM recent WHERE source = 'olx')
 SELECT listing_id, concat('🔥 <b>OPORTUNIDADE — ', size::VARCHAR, '/100</b>', chr(10), chr(10), title, chr(10), '<b>', CASE WHEN currency = 'BRL' THEN concat('R$ ', d, ',00') ELSE d END, '</b>', chr(10), chr(10), '📍 OLX', coalesce(' — ' || location, ''), chr(10), chr(10),
 '📊 <b>PREÇO DE MERCADO</b>', chr(10), 'olx: <b>', CASE WHEN currency = 'BRL' THEN 'R$ 1.500,00' ELSE '1.500' END, '</b>', chr(10), 'Mediana combinada: <b>', CASE WHEN currency = 'BRL' THEN 'R$ 1.500,00' ELSE '1.500' END, '</b>', chr(10), 'Amostra: 12 (high)', chr(10), 'Diferença: <b>-12.3%</b>', chr(10), chr(10),
 '✅ <b>Pontos positivos</b>', chr(10), '• ', brand, chr(10), chr(10), '⚠️ <b>Verificar</b>', chr(10), '• Verificar condição e procedência', chr(10), chr(10), '<a href="https://www.olx.com.br/item/x-1">Abrir anúncio</a>') AS text FROM m"""
