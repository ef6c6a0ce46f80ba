"""URL functions over Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallmark.functions.text import once

#: Query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid"]
#: Hosts of each source; a host counts with its subdomains.
HOSTS = {"facebook": ["facebook.com"], "olx": ["olx.com.br"], "mercadolivre": ["mercadolivre.com.br", "mercadolibre.com"]}


def normalize_url(url: Column) -> Column:
    """Without fragment, tracking parameters, leading www. and trailing slashes of the path; parameters sorted by
    name, equal names in their order; scheme and host in lower case, the scheme's own port dropped. Null for what is
    no URL."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    scheme = F.lower(part("PROTOCOL"))
    host = F.regexp_replace(F.lower(part("HOST")), r"^www\.", "")
    authority = part("AUTHORITY")
    user = F.coalesce(F.nullif(F.regexp_extract(authority, "^(.*@)", 1), F.lit("")), F.lit(""))
    port = F.coalesce(F.nullif(F.regexp_extract(authority, r"(:\d+)$", 1), F.lit("")), F.lit(""))
    port = F.when(((scheme == "https") & (port == ":443")) | ((scheme == "http") & (port == ":80")), "").otherwise(port)
    path = F.regexp_replace(F.coalesce(part("PATH"), F.lit("")), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    params = F.filter(F.split(F.coalesce(part("QUERY"), F.lit("")), "&"), lambda p: p != "")
    named = F.transform(params, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("name"), i.alias("at"), F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("text")))
    kept = F.array_sort(F.filter(named, lambda p: ~p["name"].isin(TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: p["text"]), "&")
    return F.concat(scheme, F.lit("://"), user, host, port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def is_http_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(url, F.lit("HOST")).isNotNull(), F.lit(False))


def is_marketplace_url(source: Column, url: Column) -> Column:
    """https, no user, no port but the usual one, and a host of the source."""
    return once(F.lower(F.try_parse_url(url, F.lit("HOST"))), lambda host: _of_source(source, url, host))


def _of_source(source: Column, url: Column, host: Column) -> Column:
    authority = F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))
    plain = (authority == host) | (authority == F.concat(host, F.lit(":443")))
    right = F.lit(False)
    for name, hosts in HOSTS.items():
        own = F.lit(False)
        for h in hosts:
            own = own | (host == h) | host.endswith(f".{h}")
        right = F.when(source == name, own).otherwise(right)
    return F.coalesce((F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & plain & right, F.lit(False))


def short_url(source: Column, url: Column, most: int = 600) -> Column:
    """The URL if it is the source's and at most `most` long; else without query; else null."""
    bare = F.regexp_replace(url, "[?#].*$", "")
    fits = F.when(F.length(url) <= most, url).when(F.length(bare) <= most, bare)
    return F.when(is_marketplace_url(source, url), fits)


def first_party_id(source: Column, url: Column) -> Column:
    """The listing's number in its URL, by source; null where it has none."""
    path = F.try_parse_url(url, F.lit("PATH"))
    group = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    decoded = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    item = F.coalesce(group(decoded, r"(?i)(?:item_id:|[?&#]wid=)(MLB-?\d{6,})"), group(decoded, r"(?i)\b(MLB-?\d{6,})\b"))
    return (
        F.when(source == "facebook", group(path, r"/marketplace/item/(\d+)"))
        .when(source == "olx", group(path, r"-(\d{6,})/?$"))
        .when(source == "mercadolivre", F.upper(F.replace(item, F.lit("-"), F.lit(""))))
    )
