"""Snapshots and state machines: new_state = f(old_state, batch, as_of). Nothing is updated in place."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallmark.functions.hashing import content_hash, fingerprint
from stallmark.functions.urls import normalize_url
from stallmark.operators.dedup import keep_first, resolve_identity
from stallmark.schema import LISTING
from stallmark.shared import stored


def price_changes(observations: DataFrame, key: str = "listing_id", order: list[str] = ["observed_at", "seq"]) -> DataFrame:  # noqa: B006
    """Observations whose price differs from the one before (null prices count as a price in between), the first
    included; those without price are then dropped."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = observations.withColumn("_before", F.lag("price").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    return rows.where((F.col("_first") | ~F.col("price").eqNullSafe(F.col("_before"))) & F.col("price").isNotNull()).drop("_before", "_first")


def price_history(changes: DataFrame, key: str = "listing_id", last: int | None = None) -> DataFrame:
    """(key, history): price points in order of time, the last ones only if asked."""
    out = changes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("observed_at", "price"))).alias("history"))
    return out if last is None else out.withColumn("history", F.slice("history", F.greatest(F.size("history") - last + 1, F.lit(1)), last))


class _Side(str):
    """The columns of one side of a join, by their names without its prefix."""

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self}{name}")


def identified(batch: DataFrame, snapshot: DataFrame | None) -> DataFrame:
    """batch with its normalized_url and the listing_id it belongs to, or its own where it is new. The names alone meet
    the snapshot's (None: there is none yet); those that belong to a listing under another id than their own are few,
    and are written and joined with the whole rows."""
    batch = batch.withColumn("normalized_url", normalize_url(F.col("url")))
    names = ["source", "external_id", "normalized_url"]
    own = F.concat_ws(":", "source", F.coalesce(F.concat(F.lit("id:"), "external_id"), F.concat(F.lit("url:"), "normalized_url")))
    if snapshot is None:
        return batch.withColumn("listing_id", own)
    found = resolve_identity(batch.select(*names), snapshot.select("listing_id", *names))
    found = found.where("listing_id is not null").select(*(F.col(n).alias(f"_{n}") for n in names), F.col("listing_id").alias("_other"), (F.col("listing_id") == own).alias("_own"))
    moved = stored(found.where("not _own").drop("_own").distinct(), "moved")
    if not moved.isEmpty():  # one name may belong to several listings, its own among them
        twice = moved.select(*(F.col(f"_{n}").alias(n) for n in names)).distinct()
        same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
        moved = moved.unionByName(stored(found.where("_own").drop("_own").distinct().join(twice, same[0] & same[1] & same[2], "left_semi"), "own"))
    same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    rows = batch.drop("listing_id").join(moved, same[0] & same[1] & same[2], "left")
    return rows.withColumn("listing_id", F.coalesce("_other", own)).drop("_other", *(f"_{n}" for n in names))


def upsert_summaries(snapshot: DataFrame, batch: DataFrame, as_of: datetime) -> DataFrame:
    """The snapshot after a batch of summaries (SUMMARY columns and category), one row a listing at most. Rows found
    by identity are updated; a change of price, title, place, picture or URL drops what only details know; suppressed
    rows take an id they lacked and nothing else; others are new. Two more columns tell of the batch: `change` (new,
    changed, same, suppressed, or null where the batch has no row) and `price_point` (the price to append to the
    history, or null)."""
    return upsert_identified(snapshot, identified(batch, snapshot), as_of)


def upsert_identified(snapshot: DataFrame, found: DataFrame, as_of: datetime) -> DataFrame:
    """upsert_summaries of a batch that is identified."""
    now = F.lit(as_of)
    # a row without id and one with an id may name one stored listing: the first of them counts
    found = keep_first(found, ["listing_id"], ["seq"])
    names = ["listing_id", "source", "category", "external_id", "title", "price", "currency", "location", "url", "normalized_url", "image_url"]
    # columns, not structs: what is not read is not shuffled
    b = found.select(*(F.col(n).alias(f"_b_{n}") for n in names))
    s = snapshot.select(*(F.col(n).alias(f"_s_{n}") for n in LISTING.fieldNames()))
    both = s.join(b, F.col("_s_listing_id") == F.col("_b_listing_id"), "full_outer")
    old, new = _Side("_s_"), _Side("_b_")
    no_old, no_new = old["listing_id"].isNull(), new["listing_id"].isNull()
    gone = old["suppressed_at"].isNotNull()
    priced = ~old["price"].eqNullSafe(new["price"])
    changed = priced
    for n in ("title", "location", "image_url", "normalized_url"):
        changed = changed | ~old[n].eqNullSafe(new[n])
    kind = F.when(no_new, F.lit(None)).when(no_old, "new").when(gone, "suppressed").when(changed, "changed").otherwise("same")
    both = both.withColumn("change", kind)
    both = both.withColumn("price_point", F.when(F.col("change").isin("new", "changed") & (no_old | priced), new["price"]))
    fresh, live = F.col("change") == "new", F.col("change").isin("new", "changed", "same")
    reset = F.col("change").isin("new", "changed")
    print_ = fingerprint(new["source"], new["title"], new["price"], new["location"])
    images = F.when(new["image_url"].isNull(), F.array().cast("array<string>")).otherwise(F.array(new["image_url"]))
    pick = lambda n: F.when(live, new[n]).otherwise(old[n])
    keep = lambda n, blank=None: F.when(reset, F.lit(None) if blank is None else blank).otherwise(old[n])
    columns = {n: pick(n) for n in ("category", "title", "price", "currency", "location", "url", "normalized_url", "image_url")}
    columns |= {
        "listing_id": F.coalesce(old["listing_id"], new["listing_id"]),
        "source": F.coalesce(old["source"], new["source"]),
        "external_id": F.coalesce(old["external_id"], new["external_id"]),
        "fingerprint": F.when(live, print_).otherwise(old["fingerprint"]),
        "description": keep("description"),
        "seller_name": keep("seller_name"),
        "images": keep("images", images),
        "attributes": keep("attributes", F.create_map().cast("map<string,string>")),
        "published_at": keep("published_at"),
        "content_hash": keep("content_hash"),
        "first_seen_at": F.when(fresh, now).otherwise(old["first_seen_at"]),
        "last_seen_at": F.when(live, now).otherwise(old["last_seen_at"]),
        "last_checked_at": F.when(fresh, now).otherwise(old["last_checked_at"]),
        "active": F.when(live, True).otherwise(old["active"]),
        "suppressed_at": old["suppressed_at"],
    }
    fields = [columns[f.name].cast(f.dataType).alias(f.name) for f in LISTING.fields]
    return both.select(*fields, "change", "price_point")


def links(known: DataFrame, batch: DataFrame) -> DataFrame:
    """(search_id, listing_id, first_matched_at, last_matched_at) with a batch of (search_id, listing_id, matched_at)."""
    new = batch.select("search_id", "listing_id", F.col("matched_at").alias("first_matched_at"), F.col("matched_at").alias("last_matched_at"))
    return known.unionByName(new).groupBy("search_id", "listing_id").agg(F.min("first_matched_at").alias("first_matched_at"), F.max("last_matched_at").alias("last_matched_at"))


def fence_holds(a: Column, b: Column) -> Column:
    """Whether two (updated_at, fingerprint, content_hash) tell of one state; nulls equal each other."""
    return a["updated_at"].eqNullSafe(b["updated_at"]) & a["fingerprint"].eqNullSafe(b["fingerprint"]) & a["content_hash"].eqNullSafe(b["content_hash"])


def fenced(snapshot: DataFrame, updates: DataFrame, key: str = "listing_id") -> DataFrame:
    """updates with `accepted`: whether their fence (struct) equals the live row's."""
    rows = snapshot.select(F.col(key).alias("_key"), F.struct("updated_at", "fingerprint", "content_hash").alias("_now"), "suppressed_at")
    joined = updates.join(rows, F.col(key) == F.col("_key"), "left")
    ok = F.col("_key").isNotNull() & F.col("suppressed_at").isNull() & fence_holds(F.col("_now"), F.col("fence"))
    return joined.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("_key", "_now", "suppressed_at")


def apply_fenced(snapshot: DataFrame, updates: DataFrame, key: str = "listing_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, stale) updates: those whose fence (struct) equals the live row's, and the rest."""
    judged = fenced(snapshot, updates, key)
    return judged.where("accepted").drop("accepted"), judged.where("not accepted").drop("accepted")


def update_details(snapshot: DataFrame, details: DataFrame, as_of: datetime) -> DataFrame:
    """The snapshot with accepted details (listing_id and detail columns) in place, and checked and seen now."""
    names = ["title", "description", "price", "currency", "location", "seller_name", "url", "image_url", "images", "attributes", "published_at"]
    d = details.select(F.col("listing_id").alias("_id"), F.struct(*names).alias("d"))
    joined = snapshot.join(d, F.col("listing_id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull() & F.col("suppressed_at").isNull()
    c = F.col("d")
    new = {n: F.when(hit, c[n]).otherwise(F.col(n)) for n in names}
    new |= {
        "normalized_url": F.when(hit, normalize_url(c["url"])).otherwise(F.col("normalized_url")),
        "content_hash": F.when(hit, content_hash(c["title"], c["description"], c["price"], c["attributes"], c["images"])).otherwise(F.col("content_hash")),
        "last_checked_at": F.when(hit, F.lit(as_of)).otherwise(F.col("last_checked_at")),
        "last_seen_at": F.when(hit, F.lit(as_of)).otherwise(F.col("last_seen_at")),
    }
    return joined.select(*(new.get(n, F.col(n)).alias(n) for n in snapshot.columns))


def save_extractions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Extractions after a run. A failed attempt (attempt_model set, model another) does not overwrite a success on
    the same content and category; it only leaves its mark."""
    s = stored.select(F.col("listing_id").alias("_id"), F.struct(*stored.columns).alias("s"))
    i = incoming.select("listing_id", F.struct(*incoming.columns).alias("i"))
    both = s.join(i, F.col("_id") == F.col("listing_id"), "full_outer")
    old, new = F.col("s"), F.col("i")
    failed = new["attempt_model"].isNotNull() & ~new["model"].eqNullSafe(new["attempt_model"])
    keep = failed & old["model"].isNotNull() & (old["content_hash"] == new["content_hash"]) & (old["category"] == new["category"])
    keep = F.coalesce(keep, F.lit(False))
    marks = {"attempt_model", "attempted_at"}
    pick = lambda n: F.when(new.isNull(), old[n]).when(keep & F.lit(n not in marks), old[n]).otherwise(new[n])
    return both.select(*(pick(n).alias(n) for n in stored.columns))


def save_analyses(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Analyses by (listing, search, input). A known one changes only if a model ran; a failed attempt leaves its time."""
    keys = ["listing_id", "search_id", "input_hash"]
    s = stored.select(*keys, F.struct(*stored.columns).alias("s"))
    i = incoming.select(*keys, F.struct(*stored.columns).alias("i"))
    both = s.join(i, keys, "full_outer")
    old, new = F.col("s"), F.col("i")
    ran, tried = new["analysis_model"].isNotNull(), new["llm_attempted_at"].isNotNull()
    fixed = {"analysis_id", "created_at"}
    pick = lambda n: F.when(old.isNull(), new[n]).when(F.lit(n in fixed) | new.isNull(), old[n]).when(ran | (tried & F.lit(n == "llm_attempted_at")), new[n]).otherwise(old[n])
    return both.select(*keys, *(pick(n).alias(n) for n in stored.columns if n not in keys))


def reusable(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """wanted (keys, input_hash, ...) with `reused` and, where a stored analysis of equal keys rests on the same input, its
    other columns; of several the one whose columns sort last. Null hashes are never reused."""
    on = [*keys, "input_hash"]
    rest = [c for c in stored.columns if c not in on]
    one = stored.where("input_hash is not null").groupBy(*on).agg(F.max(F.struct(*rest)).alias("_stored"))
    found = wanted.join(one, on, "left").withColumn("reused", F.col("_stored").isNotNull())
    return found.select(*wanted.columns, "reused", *(F.col("_stored")[c].alias(c) for c in rest))


def claim(notifications: DataFrame, as_of: datetime, lease_minutes: int = 15) -> DataFrame:
    """Notifications with those that may be sent claimed: pending, failed, or sending under an expired lease become
    sending, one attempt more; `claimed` tells which."""
    if lease_minutes <= 0:
        raise ValueError("a lease lasts longer than nothing")
    expired = F.col("claimed_at") <= F.lit(as_of) - F.make_dt_interval(mins=F.lit(lease_minutes))
    can = F.coalesce(F.col("status").isin("pending", "failed") | ((F.col("status") == "sending") & expired), F.lit(False))
    rows = notifications.withColumn("claimed", can)
    c = F.col("claimed")
    return rows.withColumns(
        {
            "status": F.when(c, "sending").otherwise(F.col("status")),
            "attempts": F.col("attempts") + c.cast("int"),
            "claimed_at": F.when(c, F.lit(as_of)).otherwise(F.col("claimed_at")),
            "sent_at": F.when(~c, F.col("sent_at")),
            "last_error": F.when(~c, F.col("last_error")),
        }
    )


def settle(notifications: DataFrame, outcomes: DataFrame, error: Column, as_of: datetime) -> DataFrame:
    """Notifications after delivery: outcomes (notification_id, claimed_at, attempts, ok, error) count only for the
    very claim they name."""
    o = outcomes.select(F.col("notification_id").alias("_id"), F.col("claimed_at").alias("_at"), F.col("attempts").alias("_n"), "ok", error.alias("_error"))
    same = (F.col("notification_id") == F.col("_id")) & (F.col("status") == "sending") & (F.col("claimed_at") == F.col("_at")) & (F.col("attempts") == F.col("_n"))
    joined = notifications.join(o, same, "left")
    hit = F.col("_id").isNotNull()
    return joined.select(
        *(c for c in notifications.columns if c not in ("status", "claimed_at", "sent_at", "last_error")),
        F.when(hit & F.col("ok"), "sent").when(hit, "failed").otherwise(F.col("status")).alias("status"),
        F.when(~hit, F.col("claimed_at")).alias("claimed_at"),
        F.when(hit & F.col("ok"), F.lit(as_of)).when(~hit, F.col("sent_at")).alias("sent_at"),
        F.when(hit & ~F.col("ok"), F.col("_error")).when(~hit, F.col("last_error")).alias("last_error"),
    )


def lease(searches: DataFrame, search_ids: DataFrame, lease_id: str, as_of: datetime, minutes: int = 30) -> DataFrame:
    """Searches with a run lease taken, or renewed by its holder, where it is free, expired or one's own."""
    wanted = search_ids.select(F.col("search_id").alias("_id")).distinct()
    free = F.col("run_lease_id").isNull() | (F.col("run_lease_expires_at") <= F.lit(as_of)) | (F.col("run_lease_id") == lease_id)
    joined = searches.join(wanted, F.col("search_id") == F.col("_id"), "left").withColumn("_ok", F.col("_id").isNotNull() & F.col("active") & free)
    until = F.lit(as_of) + F.make_dt_interval(mins=F.lit(minutes))
    out = joined.withColumns({"run_lease_id": F.when(F.col("_ok"), F.lit(lease_id)).otherwise(F.col("run_lease_id")), "run_lease_expires_at": F.when(F.col("_ok"), until).otherwise(F.col("run_lease_expires_at"))})
    return out.drop("_id", "_ok")


def release(searches: DataFrame, lease_id: str, as_of: datetime, completed: bool) -> DataFrame:
    """Searches without the lease; one that completed ran now."""
    own = F.coalesce(F.col("run_lease_id") == lease_id, F.lit(False))
    out = searches.withColumn("last_run_at", F.when(own & F.lit(completed), F.lit(as_of)).otherwise(F.col("last_run_at")))
    return out.withColumns({"run_lease_id": F.when(~own, F.col("run_lease_id")), "run_lease_expires_at": F.when(~own, F.col("run_lease_expires_at"))})


def suppress(snapshot: DataFrame, ids: DataFrame, as_of: datetime) -> DataFrame:
    """The snapshot with the listings as tombstones: identity kept, content blank."""
    wanted = ids.select(F.col("listing_id").alias("_id")).distinct()
    joined = snapshot.join(wanted, F.col("listing_id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull() & F.col("suppressed_at").isNull()
    blank = {"title": F.lit("[removido]"), "images": F.array().cast("array<string>"), "attributes": F.create_map().cast("map<string,string>"), "active": F.lit(False), "suppressed_at": F.lit(as_of), "fingerprint": F.lit("")}
    nulls = ["description", "price", "currency", "location", "seller_name", "image_url", "published_at", "content_hash"]
    blank |= {n: F.lit(None) for n in nulls}
    return joined.select(*((F.when(hit, blank[n]).otherwise(F.col(n)) if n in blank else F.col(n)).alias(n) for n in snapshot.columns))


def without_listings(df: DataFrame, ids: DataFrame, key: str = "listing_id") -> DataFrame:
    """A dependent table less what hangs on the listings."""
    return df.join(ids.select(F.col("listing_id").alias(key)).distinct(), key, "left_anti")


def merge_supplement(own: Column, proposed: Column, fields: dict[str, str]) -> Column:
    """A struct whose null or "unknown" fields are filled from another, and whose arrays are united. fields: name and
    type of each."""
    out = []
    for name, kind in fields.items():
        a, b = own[name], proposed[name]
        if kind.startswith("array"):
            out.append(F.coalesce(F.array_union(a, b), a, b).alias(name))
        elif kind == "string":
            out.append(F.when(a.isNull() | (a == "unknown"), F.coalesce(b, a)).otherwise(a).alias(name))
        else:
            out.append(F.coalesce(a, b).alias(name))
    return F.struct(*out)
