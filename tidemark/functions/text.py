"""Texts as column expressions: titles, sentences, names, keys and badges."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def sanitize_title(title: Column, longest: int = 300) -> Column:
    """Single spaces, at most ``longest`` characters; null where nothing is left or the title is an address."""
    bare = F.substring(collapse_spaces(title), 1, longest)
    return F.when(~bare.rlike(r"^(?i:https?://|www\.)\S*$"), F.nullif(bare, F.lit("")))


def sentences_with(text: Column, words: Sequence[str], most: int = 5) -> Column:
    """The first ``most`` sentences that hold one of ``words``, in order."""
    sentences = F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")
    holds = lambda s: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(s), w))
    return F.slice(F.filter(sentences, holds), 1, most)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, for which Spark has no built-in function."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


# Marks of legal form in names.
LEGAL_FORMS = r"\((주|유|재|사|학|의)\)|㈜|주식회사|유한회사|재단법인|사단법인|학교법인|의료법인"


def name_key(name: Column) -> Column:
    """A name for comparison: compatibility form, no legal form, no brackets, lower-case letters and digits alone."""
    bare = F.regexp_replace(F.regexp_replace(nfkc(name), LEGAL_FORMS, ""), r"\([^)]*\)|\[[^\]]*\]", "")
    return F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", "")


def aliases_in_brackets(name: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(name, F.lit(r"\(([^)]+)\)"), 1), lambda a: F.trim(a)))


def long_keys(keys: Column, least: int = 3) -> Column:
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) >= least))


def badges(texts: Column, hints: Mapping[str, str], most: int = 3) -> Column:
    """The first ``most`` labels whose pattern one of ``texts`` matches."""
    matches = lambda pattern: F.exists(texts, lambda t: t.rlike(pattern))
    found = F.array(*[F.when(matches(p), F.lit(label)) for label, p in hints.items()])
    return F.slice(F.array_compact(found), 1, most)


def visible_text(html: Column) -> Column:
    """Text of a page outside its scripts, styles, comments and tags, with single spaces."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for code, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(code), F.lit(plain))
    return collapse_spaces(bare)


def page_title(html: Column) -> Column:
    return F.nullif(collapse_spaces(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def links(html: Column) -> Column:
    """Targets of a page's links, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"']"), 1)


def around(text: Column, needle: str, before: int = 60, after: int = 60) -> Column:
    """The characters around the first place of ``needle``; null where it isn't."""
    at = F.locate(needle, text)
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substr(text, start, at - start + len(needle) + after))


# Short names of places and what they stand for, and the Latin letters of a syllable's parts.
REGIONS = {"서울시(?!청)": "서울특별시", "서울시청": "서울특별시청", "부산시": "부산광역시", "대구시": "대구광역시", "인천시": "인천광역시", "대전시": "대전광역시", "울산시": "울산광역시"}
ONSETS = ("g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h")
VOWELS = ("a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i")
CODAS = ("", "k", "k", "k", "n", "n", "n", "t", "l", "k", "m", "l", "l", "l", "p", "l", "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "t")


def expanded_regions(name: Column) -> Column:
    for short, whole in REGIONS.items():
        name = F.regexp_replace(name, short, whole)
    return name


def name_aliases(name: Column) -> Column:
    """A name, itself without marks of legal form and with whole region names, and what it has in brackets; each once, two characters at least."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, LEGAL_FORMS, ""), r"\([^)]*\)", ""))
    inner = F.filter(aliases_in_brackets(name), lambda a: ~a.rlike("^(주|유|사|재)$"))
    every = F.concat(F.array(name, bare, expanded_regions(bare)), F.coalesce(inner, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda a: F.length(F.trim(a)) >= 2))


def romanized(text: Column) -> Column:
    """Hangul syllables spelled in Latin letters by their parts; other letters and digits in lower case, all else left out."""
    part = lambda names, at: F.get(F.array(*[F.lit(x) for x in names]), at.cast("int"))

    def spelled(c: Column) -> Column:
        code = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long") - 0xAC00
        syllable = F.concat(part(ONSETS, F.floor(code / 588)), part(VOWELS, F.floor((code % 588) / 28)), part(CODAS, code % 28))
        return F.when(c.rlike("^[가-힣]$"), syllable).when(c.rlike("^[A-Za-z0-9]$"), F.lower(c)).otherwise("")

    return F.array_join(F.transform(F.split(text, ""), spelled), "")


def without_keys(json: Column, names: Sequence[str]) -> Column:
    """A JSON object as text without the fields of those names, at its top and in objects one level below; other values keep their types.

    Null where the text is no object.
    """
    drop = lambda m: F.map_filter(m, lambda k, _: ~F.lower(k).isin(*[n.lower() for n in names]))
    inner = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    kept = F.transform_values(drop(F.from_json(json, "map<string,variant>")), lambda k, v: F.coalesce(F.parse_json(F.to_json(drop(inner(v)))), v))
    return F.to_json(kept)


def script_json(html: Column, name: str) -> Column:
    """The JSON that a page's script gives to ``name``: from the first brace behind it to the last one before the script ends."""
    body = F.regexp_extract(html, rf"(?s)\b{name}\s*=\s*([\[{{].*?[\]}}])\s*;?\s*</script", 1)
    return F.nullif(body, F.lit(""))


def linked_data(html: Column) -> Column:
    """The first block of linked data of a page, as JSON text."""
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script", 1)), F.lit(""))


def field_kinds(html: Column) -> Column:
    """Kinds of a page's input fields in order; one without a type takes text, hidden ones are no questions."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<input\b[^>]*>)"), 1)
    kind = lambda tag: F.lower(F.regexp_extract(tag, r"(?i)\btype\s*=\s*[\"']?([A-Za-z]+)", 1))
    return F.filter(F.transform(tags, lambda t: F.when(kind(t) == "", "text").otherwise(kind(t))), lambda k: ~k.isin("hidden", "submit", "button"))


def label_of(html: Column, field: str) -> Column:
    """The text of the label that belongs to the field of that id."""
    inner = F.regexp_extract(html, rf"(?is)<label\b[^>]*\bfor\s*=\s*[\"']{field}[\"'][^>]*>(.*?)</label>", 1)
    return F.nullif(collapse_spaces(F.regexp_replace(inner, "<[^>]*>", " ")), F.lit(""))
