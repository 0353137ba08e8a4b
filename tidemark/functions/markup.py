"""Pages as trees and as carriers of values: elements with their place, fields and labels, dates, values that scripts assign."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import dates
from tidemark.functions.rules import first_match
from tidemark.functions.text import collapse_spaces

NODE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("place", "parent", "last")] + [T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType())])
# Elements without content, and those that one of the same list ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ENDS = {"p": {"p"}, "li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
HOLDS = {"ul", "ol", "table", "select", "dl", "div", "section", "article", "body", "td", "form"}


class _Tree(HTMLParser):
    """Elements of a page in order, each with its parent, its last descendant and the text directly in it.

    With ``as_written`` texts and attributes keep their character references.
    """

    def __init__(self, as_written: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.as_written = as_written
        self.nodes: list[dict] = []
        self.open: list[int] = []

    def read(self, page: str) -> list[dict]:
        self.feed(page.replace("&", "&amp;") if self.as_written else page)
        self.close()
        self.close_to(0)
        return self.nodes

    def close_to(self, depth: int) -> None:
        for at in self.open[depth:]:
            self.nodes[at]["last"] = len(self.nodes) - 1
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        ended = ENDS.get(tag, ())
        for depth in range(len(self.open) - 1, -1, -1):
            above = self.nodes[self.open[depth]]["tag"]
            if above in ended:
                self.close_to(depth)
                if tag != "tr":
                    break
            elif above in HOLDS:
                break
        place = len(self.nodes)
        self.nodes.append({"place": place, "parent": self.open[-1] if self.open else None, "last": place, "tag": tag, "attrs": {k: v if v is not None else "" for k, v in attrs}, "text": ""})
        if tag not in VOID:
            self.open.append(place)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[depth]]["tag"] == tag:
                return self.close_to(depth)
        return None

    def handle_data(self, data):
        if self.open:
            raw = self.as_written and self.cdata_elem in self.CDATA_CONTENT_ELEMENTS
            self.nodes[self.open[-1]]["text"] += data.replace("&amp;", "&") if raw else data


#: So many characters of pages are trees at once in a worker, whatever a batch holds.
PORTION = 1 << 18


def portions(pages: pd.Series, most: int) -> Iterator[pd.Series]:
    """A batch in parts of about ``most`` characters, one page at least."""
    at = size = 0
    for end, n in enumerate(pages.str.len().fillna(0), 1):
        size += n
        if size >= most or end == len(pages):
            yield pages.iloc[at:end]
            at, size = end, 0


@F.pandas_udf(T.ArrayType(NODE))
def page_tree(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The elements of a page, to be selected as a column before other expressions look into it.  Void elements hold nothing, what HTML lets end implicitly ends, stray end tags are passed over, what stays open ends with the page."""
    for pages in batches:
        for own in portions(pages, PORTION):
            yield own.map(lambda page: None if page is None else _Tree().read(page))


@F.pandas_udf(T.ArrayType(NODE))
def page_tree_as_written(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``page_tree`` with character references in texts and attributes left as the page writes them."""
    for pages in batches:
        for own in portions(pages, PORTION):
            yield own.map(lambda page: None if page is None else _Tree(as_written=True).read(page))


def inner_text(nodes: Column, node: Column) -> Column:
    """All text in an element and below it, with single spaces; scripts and styles show none."""
    shown = lambda x: F.filter(nodes, lambda n: n["place"].between(x["place"], x["last"]) & ~n["tag"].isin("script", "style"))
    joined = lambda x: F.when(x.isNotNull(), collapse_spaces(F.array_join(F.transform(shown(x), lambda n: n["text"]), " ")))
    return F.get(F.transform(F.array(node), joined), F.lit(0))  # the element is found once, not for each node


def first_of(nodes: Column, wanted) -> Column:
    return F.get(F.filter(nodes, wanted), F.lit(0))


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


# Kinds of input fields that have a question type of their own.
INPUT_TYPES = {"email": "email", "tel": "phone", "file": "file", "checkbox": "checkbox", "radio": "radio", "number": "number", "date": "date"}


def form_fields(nodes: Column) -> Column:
    """label, kind, name and required of a page's fields in order, each label once.

    A field is called by the label for its id, by the label around it, by its aria-label, by its
    placeholder, then by its name; one without any is no question, nor are hidden ones and buttons.
    """
    kind = lambda n: F.lower(F.coalesce(F.nullif(attr(n, "type"), F.lit("")), F.lit("text")))
    asks = lambda n: n["tag"].isin("textarea", "select") | ((n["tag"] == "input") & ~kind(n).isin("hidden", "submit", "button", "reset", "image"))
    told = lambda c: F.when(F.length(F.trim(c)) >= 2, collapse_spaces(c))

    def described(n: Column) -> Column:
        by_id = first_of(nodes, lambda x: (x["tag"] == "label") & (attr(x, "for") == attr(n, "id")))
        held = F.filter(nodes, lambda x: (x["tag"] == "label") & (x["place"] < n["place"]) & (x["last"] >= n["place"]))
        around = F.try_element_at(held, F.lit(-1))
        name = told(F.translate(attr(n, "name"), "_-", "  "))
        label = F.coalesce(told(inner_text(nodes, by_id)), told(inner_text(nodes, around)), told(attr(n, "aria-label")), told(attr(n, "placeholder")), F.when(F.length(name) >= 3, name))
        type_ = first_match([(n["tag"] == "textarea", "long_text"), (n["tag"] == "select", "dropdown"), *[(kind(n) == k, v) for k, v in INPUT_TYPES.items()]], "short_text")
        required = attr(n, "required").isNotNull() | F.coalesce(attr(n, "aria-required") == "true", F.lit(False))
        return F.struct(label.alias("label"), type_.alias("kind"), attr(n, "name").alias("name"), required.alias("required"))

    fields = F.filter(F.transform(F.filter(nodes, asks), described), lambda f: f["label"].isNotNull())
    key = lambda f: F.regexp_replace(F.lower(f["label"]), r"\s+", "")
    once = lambda own: F.filter(own, lambda f, i: ~F.exists(F.slice(own, 1, i), lambda g: key(g) == key(f)))
    return F.get(F.transform(F.array(fields), once), F.lit(0))


# Where pages say when they were published, and the labels of days in tables.
META_DAYS = ("article:published_time", "og:published_time", "date", "Date", "created", "regDate", "regdate")
DAY_LABELS = "등록일|작성일|게시일|공지일|날짜|작성날짜|최초등록일|최종수정일|최종수정|작성시간|등록시간"
LINKED_DAYS = ("datePublished", "dateCreated", "dateModified")


def published_days(nodes: Column, labels: str = DAY_LABELS) -> Column:
    """meta, linked, table and text: the first day each way of saying it gives, as ISO strings: meta and time elements, linked data, cells beside a label, the text shown."""
    day = lambda c: F.get(dates.iso_days(F.regexp_replace(c, r"([0-9])T[0-9:.]+.*", "$1")), F.lit(0))
    meta = F.filter(nodes, lambda n: (n["tag"] == "meta") & (attr(n, "property").isin(*META_DAYS[:2]) | attr(n, "name").isin(*META_DAYS[2:])))
    said = F.concat(
        F.transform(meta, lambda n: attr(n, "content")),
        F.transform(F.filter(nodes, lambda n: (n["tag"] == "time") & attr(n, "datetime").isNotNull()), lambda n: attr(n, "datetime")),
        F.transform(F.filter(nodes, lambda n: F.coalesce(attr(n, "data-date"), attr(n, "data-regdate")).isNotNull()), lambda n: F.coalesce(attr(n, "data-date"), attr(n, "data-regdate"))),
    )
    blocks = F.transform(F.filter(nodes, lambda n: (n["tag"] == "script") & (attr(n, "type") == "application/ld+json")), lambda n: n["text"])
    listed = lambda t: F.concat(*[F.array(F.get_json_object(t, f"$.{k}"), F.get_json_object(t, f"$[0].{k}"), F.get_json_object(t, f"$['@graph'][0].{k}")) for k in LINKED_DAYS])
    linked = F.array_compact(F.flatten(F.transform(blocks, listed)))
    heads = F.filter(nodes, lambda n: n["tag"].isin("th", "dt", "label", "span", "strong", "em") & inner_text(nodes, n).rlike(labels))
    beside = lambda h: F.filter(nodes, lambda n: (n["parent"] == h["parent"]) & (n["place"] > h["last"]) & n["tag"].isin("td", "dd", "span", "p"))
    cells = F.transform(heads, lambda h: inner_text(nodes, F.get(beside(h), F.lit(0))))
    shown = collapse_spaces(F.array_join(F.transform(F.filter(nodes, lambda n: ~n["tag"].isin("script", "style")), lambda n: n["text"]), " "))
    first = lambda values: F.get(F.array_compact(F.transform(values, day)), F.lit(0))
    return F.struct(first(said).alias("meta"), first(linked).alias("linked"), first(cells).alias("table"), day(dates.without_copyright_years(shown)).alias("text"))


def page_day(days: Column) -> Column:
    return F.coalesce(days["meta"], days["linked"], days["table"], days["text"])


#: What a scan for the end of a value must tell apart: strings with their escapes, and brackets.
PIECE = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[\[{]|[\]}]", re.S)


def balanced(text: str, start: int) -> str | None:
    """The value whose bracket opens at ``start``, up to the bracket that closes it; brackets in strings don't count."""
    depth = 0
    for piece in PIECE.finditer(text, start):
        if piece[0] in "[{":
            depth += 1
        elif piece[0] in "]}":
            depth -= 1
            if depth == 0:
                return text[start : piece.end()]
    return None


def assigned_value(html: Column, name: str) -> Column:
    """The object or list that a script assigns to ``name``, as text, whatever follows it; the first one that closes, else null."""
    pattern = re.compile(rf"(?<![\w$]){re.escape(name)}\s*[\"']?\]?\s*[=:]\s*(?=[\[{{])")

    @F.pandas_udf(T.StringType())
    def scan(pages: pd.Series) -> pd.Series:
        def value(page):
            found = (balanced(page, m.end()) for m in pattern.finditer(page or ""))
            return next((v for v in found if v is not None), None)

        return pages.map(value)

    return scan(html)


# What the codes of one platform's questions mean; 8 is a page break.
ITEM_TYPES = {0: "short_text", 1: "long_text", 2: "single_choice", 3: "dropdown", 4: "multiple_choice", 5: "linear_scale", 7: "grid_single", 9: "date", 10: "time", 13: "file_upload"}
STATE_NAMES = ("__INITIAL_STATE__", "__PRELOADED_STATE__", "__NUXT__")


def listed_items(data: Column) -> Column:
    """title, kind, options and required of the questions in a list of lists, as one platform embeds them; page breaks are none."""
    items = F.from_json(F.get_json_object(data, "$[1][1]"), "array<string>")
    code = lambda i: F.get_json_object(i, "$[3]").try_cast("int")
    kind = lambda i: first_match([(code(i) == k, v) for k, v in ITEM_TYPES.items()], "unknown")
    choices = lambda i: F.coalesce(F.from_json(F.get_json_object(i, "$[4][0][1]"), "array<string>"), F.array().cast("array<string>"))
    options = lambda i: F.filter(F.transform(choices(i), lambda o: collapse_spaces(F.get_json_object(o, "$[0]"))), lambda o: o != "")
    required = lambda i: F.coalesce(F.get_json_object(i, "$[4][0][2]").isin("1", "true"), F.lit(False))
    one = lambda i: F.struct(collapse_spaces(F.get_json_object(i, "$[1]")).alias("title"), kind(i).alias("kind"), options(i).alias("options"), required(i).alias("required"))
    return F.transform(F.filter(items, lambda i: code(i).isNotNull() & (code(i) != 8)), one)


def state_value(html: Column) -> Column:
    """The state that a page's framework embeds, under the first of its usual names."""
    return F.coalesce(*[assigned_value(html, name) for name in STATE_NAMES])
