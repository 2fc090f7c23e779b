"""URL functions as column expressions: parse, normalise, key, compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track visitors.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "ref", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid",
    "_ga", "_gl", "igshid", "s_cid", "ncid",
)

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_LAST_SEGMENT = r"(?s)^((?:.*/)?[^/;]*)(?:;([^/]*))?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def stripped(url: Column) -> Column:
    return F.regexp_replace(url, r"(?U)^\s+|\s+$", "")


def domain(url: Column) -> Column:
    """Network location in lower case, with port and user; '' where there is none, null for null."""
    return F.lower(_part(url, 2))


def is_valid_url(url: Column) -> Column:
    """True for http and https with a network location; null counts as false."""
    return F.coalesce(F.lower(_part(url, 1)).isin("http", "https") & (_part(url, 2) != ""), F.lit(False))


def same_domain(one: Column, other: Column) -> Column:
    return domain(one) == domain(other)


def _decoded(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), part)


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(url: Column) -> Column:
    """One spelling for URLs that name the same page.

    Scheme and network location in lower case without default port, path without
    trailing slashes (the root stays /), parameters without blank and tracking
    ones, sorted by name with the values of a name in their order, no fragment.
    Text that is no URL is treated as a path; null gives null.
    """
    u = stripped(url)
    scheme, host, path, query = F.lower(_part(u, 1)), F.lower(_part(u, 2)), _part(u, 3), _part(u, 4)
    host = (
        F.when(host.endswith(":80") & (scheme == "http"), F.regexp_replace(host, ":80$", ""))
        .when(host.endswith(":443") & (scheme == "https"), F.regexp_replace(host, ":443$", ""))
        .otherwise(host)
    )
    params = F.regexp_extract(path, _LAST_SEGMENT, 2)
    path = F.regexp_replace(F.regexp_extract(path, _LAST_SEGMENT, 1), "/+$", "")
    path = F.when(path == "", "/").when((host != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=.")),
        lambda p, i: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("name"), i.alias("place"), _decoded(F.regexp_replace(p, "(?s)^[^=]*=", "")).alias("value")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["name"]).isin(*TRACKING_PARAMS)))
    text = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["name"]), F.lit("="), _encoded(p["value"]))), "&")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        path,
        F.when(params != "", F.concat(F.lit(";"), params)).otherwise(""),
        F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""),
    )


def url_key(url: Column) -> Column:
    return F.sha2(normalize_url(url), 256)
