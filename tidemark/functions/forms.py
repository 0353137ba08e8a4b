"""Addresses of form platforms: which one an address belongs to, the form's id, why it is none, and one canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.rules import first_match
from tidemark.functions.urls import PARTS, TRACKING, authority, path, query_parameters, scheme

# Hosts of the platforms, and parts of them that hold no forms.
SHORTENERS = ("forms.gle", "naver.me")
GOOGLE, NAVER, MOAFORM, ANSWERS, SHORT = "docs.google.com", "form.naver.com", ("moaform.com", "www.moaform.com"), "answer.moaform.com", "surveyl.ink"
BLOCKED_HOSTS = ("help.moaform.com", "api.moaform.com", "blog.moaform.com", "home.moaform.com")
BLOCKED_PATHS = ("/pricing", "/login", "/signup", "/templates", "/terms", "/privacy", "/help", "/blog")
ID = "([A-Za-z0-9_-]+)"


def accepted(platform: str, form_id: Column) -> Column:
    return F.struct(F.lit(True).alias("ok"), F.lit(platform).alias("platform"), form_id.alias("form_id"), F.lit(None).cast("string").alias("reason"))


def refused(reason: str) -> Column:
    return F.struct(F.lit(False).alias("ok"), F.lit(None).cast("string").alias("platform"), F.lit(None).cast("string").alias("form_id"), F.lit(reason).alias("reason"))


def address_parts(url: Column) -> Column:
    """scheme, host and path (without slashes at its end) of an address, in one struct."""
    bare = F.regexp_replace(authority(url), ":[0-9]*$", "")
    return F.struct(scheme(url).alias("scheme"), bare.alias("host"), F.regexp_replace(path(url), "/+$", "").alias("path"))


def response_address(url: Column) -> Column:
    """ok, platform, form_id and reason: whether an address is that of a form that can be answered, by the rules of its platform."""

    def judged(p: Column) -> Column:
        host, way = p["host"], p["path"]
        low = F.lower(way)
        moaform, short = host.isin(*MOAFORM), (host == SHORT) | F.endswith(host, F.lit(f".{SHORT}"))
        given = lambda pattern: F.regexp_extract(way, pattern, 1)
        google_form, answer = rf"(?i)^/forms/d/(?:e/)?{ID}(?:/closedform(?:/viewform)?|/viewform)?$", rf"(?i)^/answers/{ID}(?:/start)?$"
        named, asked, tail = rf"(?i)^/(?:forms?|s|survey)/{ID}$", rf"(?i)^/q/{ID}$", rf"^/{ID}$"
        family = F.contains(host, F.lit("moaform.com")) | F.contains(host, F.lit(SHORT))
        blocked = F.lit(False)
        for start in BLOCKED_PATHS:
            blocked = blocked | (low == start) | F.startswith(low, F.lit(f"{start}/"))
        return first_match([
            (p["scheme"] == "", refused("not_an_address")), (~p["scheme"].isin("http", "https"), refused("not_http")),
            (host.isin(*SHORTENERS), refused("shortener")),
            ((host == GOOGLE) & low.rlike("/edit$"), refused("editor")), ((host == GOOGLE) & low.rlike("/viewanalytics|/analytics|/reporting"), refused("results")),
            ((host == GOOGLE) & low.rlike("/formresponse$"), refused("submission")), ((host == GOOGLE) & way.rlike(google_form), accepted("google_forms", given(google_form))),
            (host == GOOGLE, refused("no_form_path")),
            ((host == NAVER) & way.rlike(rf"(?i)^/response/{ID}$"), accepted("naver_form", given(rf"(?i)^/response/{ID}$"))), (host == NAVER, refused("no_form_path")),
            (~family, refused("unsupported")), (host.isin(*BLOCKED_HOSTS) | host.rlike(r"^(help|api)\."), refused("no_form_host")),
            ((host == ANSWERS) & (way == ""), refused("root")), (blocked, refused("no_form_path")), (moaform & (way == ""), refused("root")),
            (moaform & way.rlike(asked), accepted("moaform", given(asked))), ((host == ANSWERS) & way.rlike(answer) & (F.lower(given(answer)) != "answers"), accepted("moaform", given(answer))),
            (moaform & way.rlike(named) & (F.lower(given(named)) != "404"), accepted("moaform", given(named))), (short & way.rlike(tail) & (F.lower(given(tail)) != "404"), accepted("moaform", given(tail))),
        ], refused("no_form_path"))

    return F.get(F.transform(F.array(address_parts(F.trim(url))), judged), 0)


def address_kind(url: Column) -> Column:
    """``shortener``, the platform, or ``unsupported``."""
    told = response_address(url)
    return F.when(told["reason"] == "shortener", "shortener").otherwise(F.coalesce(told["platform"], F.lit("unsupported")))


def form_domain(url: Column) -> Column:
    """Whether a host is one of a form platform at all, whatever its path."""
    p = address_parts(F.trim(url))
    host = p["host"]
    known = host.isin(*SHORTENERS, NAVER) | ((host == GOOGLE) & F.contains(F.lower(p["path"]), F.lit("/forms")))
    return F.coalesce(known | host.rlike(r"(^|\.)(moaform\.com|surveyl\.ink)$") | F.contains(host, F.lit("wiseon")), F.lit(False))


def canonical_address(url: Column) -> Column:
    """One form of an address: lower-case host, no fragment, no tracking, no slash at the end; forms end in viewform and carry no query where the platform needs none."""

    def joined(x: Column) -> Column:
        way = F.when(x["path"] == "", "/").otherwise(x["path"])
        google = (x["host"] == GOOGLE) & F.contains(way, F.lit("/forms"))
        bare = F.regexp_replace(way, r"/(edit|viewform|closedform|formResponse)(/.*)?$", "")
        way = F.when(google & bare.rlike(rf"^/forms/d/(e/)?{ID}$"), F.concat(bare, F.lit("/viewform"))).otherwise(way)
        silent = google | (x["host"].isin(*MOAFORM) & F.lower(way).rlike("^/q/"))
        query = F.when(silent | (x["query"] == ""), "").otherwise(F.concat(F.lit("?"), x["query"]))
        return F.when((x["scheme"] != "") & (x["host"] != ""), F.concat(x["scheme"], F.lit("://"), x["host"], way, query))

    p = address_parts(F.trim(url))
    kept = F.filter(query_parameters(F.trim(url)), lambda q: ~F.lower(F.substring_index(q, "=", 1)).isin(*TRACKING) & ~F.startswith(F.lower(q), F.lit("utm_")))
    whole = F.struct(p["scheme"].alias("scheme"), p["host"].alias("host"), p["path"].alias("path"), F.array_join(kept, "&").alias("query"))
    return F.when(F.trim(url).rlike(PARTS), F.get(F.transform(F.array(whole), joined), 0))


def shorteners_first(url: Column) -> Column:
    """A sort key: 0 for shortened addresses, which must be resolved before the others."""
    return F.when(F.coalesce(address_parts(F.trim(url))["host"].isin(*SHORTENERS), F.lit(False)), 0).otherwise(1)
