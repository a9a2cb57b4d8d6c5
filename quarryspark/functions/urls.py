"""Column functions over URLs and document identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that do not tell documents apart.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid", "pr_prod_strat", "pr_rec_id", "pr_rec_pid", "pr_ref_pid", "pr_seq", "_ga", "_gl", "ref", "source")
#: File names that stand for their folder.
INDEX = ("index.html", "index.htm", "index.php", "default.html", "default.htm")
#: Fixed value: the DNS name space of version-5 UUIDs.
DNS = "6ba7b8109dad11d180b400c04fd430c8"

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def decoded(text: Column) -> Column:
    """Percent escapes as characters; a plus sign stays. What is no escape stays as it is."""
    safe = F.regexp_replace(F.regexp_replace(text, r"\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(safe)


def encoded(text: Column) -> Column:
    """As a form would send it, but ~ stays and * is escaped."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def website(url: Column) -> Column:
    """The host with its port, in small letters, without a leading www."""
    url = F.trim(url)
    host = F.coalesce(F.nullif(_part(url, 2), F.lit("")), F.split_part(_part(url, 3), F.lit("/"), F.lit(1)))
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def normalised(url: Column) -> Column:
    """The identity of a page: small host without www., decoded path without an index file or a closing slash, query
    without tracking and blank parameters in the order of their names, no fragment. An empty URL stays empty."""
    url = F.trim(url)
    scheme = F.lower(F.coalesce(F.nullif(_part(url, 1), F.lit("")), F.lit("https")))
    host = F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", "")
    path = decoded(_part(url, 3))
    segments = F.split(F.regexp_replace(path, "/+$", ""), "/")
    indexed = F.lower(F.element_at(segments, -1)).isin(*INDEX)
    folder = F.array_join(F.filter(F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0))), lambda s: s != ""), "/")
    path = F.when(path == "", "/").when(indexed, F.regexp_replace(F.concat(F.lit("/"), folder), "(.)/+$", "$1")).otherwise(F.coalesce(F.nullif(F.regexp_replace(path, "(.)/+$", "$1"), F.lit("")), F.lit("/")))
    pairs = F.transform(F.filter(F.split(_part(url, 4), "&"), lambda p: p.rlike("^[^=]+=.")), lambda p: F.struct(_form(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), _form(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    pairs = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING))
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["k"])))
    ordered = F.flatten(F.transform(names, lambda k: F.filter(pairs, lambda p: p["k"] == k)))  # values of one name keep their order
    query = F.array_join(F.transform(ordered, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url == "", "").otherwise(whole)


def _form(text: Column) -> Column:
    return decoded(F.replace(text, F.lit("+"), F.lit(" ")))


def uuid5(name: Column, space: str = DNS) -> Column:
    """The version-5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def document_id(site: Column, url: Column) -> Column:
    return uuid5(F.concat(F.lower(site), F.lit(":"), normalised(url)))


def slug(url: Column) -> Column:
    """A URL's host as a name for files; crawl where it has none."""
    host = F.replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(host, "[^a-zA-Z0-9._-]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("crawl"))


def hash_filename(content_hash: Column) -> Column:
    """The file of an immutable artifact, by its content hash."""
    return F.concat(F.lit("sha256_"), F.regexp_replace(content_hash, "^sha256:", ""), F.lit(".json"))
