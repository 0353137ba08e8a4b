"""Addresses as column expressions: parts, normal forms, kinds and extraction from text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only trace where a visitor came from.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ref", "ref_src", "spm", "usp", "_ga", "_gl")
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def authority(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, PARTS, 2)), r"^[^@]*@", "")


def host(url: Column) -> Column:
    """Lower-case host without port and without a leading ``www.``; null where there is none."""
    bare = F.regexp_replace(F.regexp_replace(authority(F.trim(url)), r":[0-9]*$", ""), r"^www\.", "")
    return F.nullif(bare, F.lit(""))


def origin_key(url: Column) -> Column:
    """host, with its port unless that is the scheme's own."""
    port = F.regexp_extract(authority(F.trim(url)), r":([0-9]+)$", 1)
    usual = (port == "") | ((scheme(url) == "http") & (port == "80")) | ((scheme(url) == "https") & (port == "443"))
    return F.when(usual, host(url)).otherwise(F.concat(host(url), F.lit(":"), port))


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def query_parameters(url: Column) -> Column:
    """``name=value`` parts of the query, in order."""
    query = F.regexp_replace(F.regexp_extract(url, PARTS, 4), r"^\?", "")
    return F.filter(F.split(query, "&"), lambda x: x != "")


def parts_of(url: Column) -> Column:
    """scheme, authority, path and query of an address in one struct, with empty strings for what it lacks."""
    return F.struct(scheme(url).alias("scheme"), authority(url).alias("authority"), path(url).alias("path"), F.regexp_extract(url, PARTS, 4).alias("query"))


def normalize_url(url: Column, tracking: Sequence[str] = TRACKING) -> Column:
    """Lower-case scheme and host, no usual port, no fragment, no tracking parameters, one slash less at the end; null where it is no address."""

    def joined(p: Column) -> Column:
        given = F.filter(F.split(F.regexp_replace(p["query"], r"^\?", ""), "&"), lambda x: x != "")
        query = F.array_join(F.filter(given, lambda x: ~F.lower(F.substring_index(x, "=", 1)).isin(*tracking)), "&")
        way = F.when(p["path"] == "", "/").when(F.length(p["path"]) > 1, F.regexp_replace(p["path"], "/$", "")).otherwise(p["path"])
        usual = F.when(p["scheme"] == "http", F.regexp_replace(p["authority"], ":80$", "")).when(p["scheme"] == "https", F.regexp_replace(p["authority"], ":443$", "")).otherwise(p["authority"])
        whole = F.concat(p["scheme"], F.lit("://"), usual, way, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
        return F.when((p["scheme"] != "") & (p["authority"] != ""), whole)

    return F.get(F.transform(F.array(parts_of(F.trim(url))), joined), 0)  # the parts are taken once


def same_address_key(url: Column) -> Column:
    """Lower case without slashes at the end: what addresses that differ in these alone share."""
    return F.regexp_replace(F.lower(F.trim(url)), r"/+$", "")


def homepage_like(url: Column) -> Column:
    """No path, or one that names a start page."""
    return F.coalesce(F.lower(path(url)).rlike(r"^/?(index|main|home|default)?(\.(html?|jsp|php|do|asp))?/?$"), F.lit(False))


def public_address(url: Column) -> Column:
    """http or https with a named host, or a number outside the private and local ranges."""
    h = F.coalesce(host(url), F.lit(""))
    private = h.rlike(r"^(localhost|.*\.local|.*\.internal|0\.0\.0\.0|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*)$")
    return F.coalesce(scheme(url).isin("http", "https") & (h != "") & ~private, F.lit(False))


def kind_of(url: Column, kinds: Sequence[tuple[str, str]], default: str = "unsupported") -> Column:
    """The first kind whose pattern the host matches."""
    h = F.coalesce(host(url), F.lit(""))
    (pattern, name), *rest = kinds
    out = F.when(h.rlike(pattern), name)
    for pattern, name in rest:
        out = out.when(h.rlike(pattern), name)
    return out.otherwise(default)


ADDRESS = r"https?://[^\s\"'<>()]+"


def extract_urls(text: Column) -> Column:
    """Addresses in a text, without punctuation behind them, in order; those that differ in case alone once."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({ADDRESS})"), 1), lambda u: F.regexp_replace(u, r"[.,;:!?\]}]+$", ""))
    keys = F.transform(found, lambda u: F.lower(u))
    return F.filter(found, lambda u, i: F.array_position(keys, F.lower(u)) == i + 1)
