"""Fields from HTML pages.

Attributes, labelled values and embedded JSON are found with expressions.  Only
what needs an element tree (cards, descriptions) or unlimited JSON depth runs in
Python, as Arrow-batched functions around the standard HTML parser.
"""

from __future__ import annotations

import json
import re
import sys
from collections import defaultdict
from html import unescape as decoded
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from skillweft.dictionaries import (
    CARD_COMPANY, CARD_LINK, CARD_LOCATION, CARD_TITLE, COMPANY_URL_PATTERN, DESCRIPTION_ELEMENTS,
    DESCRIPTION_MINIMUM, LINK_KEYS, SIZE_PAGE_LABELS, SIZE_PAGE_PATTERNS, STAFF_KEYS, STAFF_WORDINGS,
)
from skillweft.functions.companies import canonical_url, company_url, is_login_wall
from skillweft.functions.sizes import (
    largest_number_label, normalize_size, plain_size_text, range_label, size_from_text, size_label,
)
from skillweft.functions.text import alternation, let, squeeze, strip

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ENTITIES = [("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"),
             ("&nbsp;", " "), ("&amp;", "&")]
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

# markup that every HTML parser reads alike: plain start tags, end tags, simple comments and the document type
_NAME = "[a-zA-Z][a-zA-Z0-9-]*"
_VALUE = '[^"<>&]*(?:&(?:amp|lt|gt|quot|nbsp|#39);[^"<>&]*)*'
_ATTRIBUTES = re.compile(rf'[ \t\n]+({_NAME})="({_VALUE})"')
_TOKEN = re.compile(
    rf'([^<]*)<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+{_NAME}="{_VALUE}")*) ?'
    r'|!--[^<>-]*--|!(?i:doctype)[^<>]*)>'
)
# elements whose content is not markup
_RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "svg", "math"}

_FIRST = lambda items: F.get(F.filter(items, lambda x: x.isNotNull()), F.lit(0))


def unescape(text: Column) -> Column:
    for entity, letter in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(letter))
    return text


def attribute_values(html: Column, tag: str, attribute: str) -> Column:
    """Values of an attribute over all tags of a kind, in page order."""
    pattern = rf"""(?is)<{tag}\b[^>]*?\s{attribute}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
    raw = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    return F.transform(raw, lambda v: unescape(F.regexp_replace(v, r"""^["']|["']$""", "")))


def hrefs(html: Column) -> Column:
    return attribute_values(html, "a", "href")


def first_company_link(html: Column) -> Column:
    """First anchor that leads to a company page, with its whole path."""
    return _FIRST(F.transform(hrefs(html), company_url))


def json_ld_scripts(html: Column) -> Column:
    pattern = r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def _linked(data):
    """Link texts of nested organisation entries, outermost first."""
    if isinstance(data, list):
        return [x for item in data for x in _linked(item)]
    if not isinstance(data, dict):
        return []
    found = []
    for key in LINK_KEYS:
        value = data.get(key)
        found += [value] if isinstance(value, str) else _linked(value) if isinstance(value, dict) else []
    return found


def _json_links(scripts: pd.Series) -> pd.Series:
    def read(texts):
        found = []
        for text in texts if texts is not None else ():
            try:
                found += _linked(json.loads(text or "{}"))
            except ValueError:
                continue
        return found

    return scripts.map(read)


json_links = F.pandas_udf(_json_links, ArrayType(StringType()))


def meta_content(html: Column, name: str) -> Column:
    """Content of the first meta tag with that property."""
    tag = F.regexp_extract(html, rf"""(?is)<meta\b(?=[^>]*\bproperty\s*=\s*["']?{name}["'\s>/])[^>]*>""", 0)
    value = F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*("[^"]*"|'[^']*')""", 1)
    return unescape(F.regexp_replace(value, r"""^["']|["']$""", ""))


def company_link(html: Column) -> Column:
    """Best company address of a posting page: struct(url, strategy, confidence).

    Anchors come before embedded organisation data, that before the og:url tag and
    any address in the page text; all fields are NULL without a hit.
    """
    page = F.coalesce(html, F.lit(""))
    direct = _FIRST(F.transform(hrefs(page), canonical_url))
    structured = _FIRST(F.transform(json_links(json_ld_scripts(page)), canonical_url))
    og = canonical_url(meta_content(page, "og:url"))
    text = canonical_url(F.regexp_extract(page, COMPANY_URL_PATTERN + r"(?U:[\w\-_.%]+)", 0))

    def option(url: Column, strategy: str, confidence: float) -> Column:
        return F.when(url.isNotNull(), F.struct(
            url.alias("url"), F.lit(strategy).alias("strategy"), F.lit(confidence).alias("confidence")
        ))

    return F.coalesce(
        option(direct, "direct_link", 0.95), option(structured, "structured_data", 0.85),
        option(og, "og_meta", 0.70), option(text, "text_parse", 0.70),
    )


def visible_text(html: Column) -> Column:
    """Page text without scripts, styles, comments and tags."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return squeeze(unescape(F.regexp_replace(text, r"(?s)<[^>]*>", " ")))


def labelled_size(html: Column) -> Column:
    """Size from a 'company size' term and its description, else from the page text."""
    pairs = r"(?is)<dt\b[^>]*>(.*?)</dt>(?=.*?<dd\b[^>]*>(.*?)</dd>)"
    terms = F.regexp_extract_all(html, F.lit(pairs), F.lit(1))
    values = F.regexp_extract_all(html, F.lit(pairs), F.lit(2))
    named = F.zip_with(terms, values, lambda k, v: F.when(
        F.lower(visible_text(k)).rlike(alternation(SIZE_PAGE_LABELS)), largest_number_label(visible_text(v))
    ))
    in_text = let(visible_text(html), lambda text: _FIRST(F.array(*[
        largest_number_label(F.nullif(F.regexp_extract(text, p, 0), F.lit(""))) for p in SIZE_PAGE_PATTERNS
    ])))
    return F.coalesce(_FIRST(named), in_text)


def short_element_size(html: Column) -> Column:
    """Size from meta contents and short span or li texts that mention employees."""
    contents = attribute_values(html, "meta", "content")
    spans = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?is)<(?:span|li)\b[^>]*>(.*?)</(?:span|li)>"), F.lit(1)),
        visible_text,
    )
    short = F.filter(spans, lambda s: (F.length(s) <= 50) & s.rlike(r"\d"))
    telling = F.filter(F.concat(contents, short), lambda s: s.rlike(r"(?i)\bemployees?\b"))
    return _FIRST(F.transform(telling, size_from_text))


def json_ld_size(html: Column) -> Column:
    """Head count text of embedded organisation data; nested values are skipped."""

    def objects(script: Column) -> Column:
        listed = F.startswith(strip(script), F.lit("["))
        return F.when(listed, F.from_json(script, "array<string>")).otherwise(F.array(script))

    def values(item: Column) -> Column:
        found = F.array(*[F.get_json_object(item, f"$.{key}") for key in STAFF_KEYS])
        plain = F.filter(found, lambda v: ~v.rlike(r"^\s*[{\[]"))
        return F.transform(plain, lambda v: F.regexp_replace(plain_size_text(v), r"^(\d+)\.0$", "$1"))

    every = F.flatten(F.transform(F.flatten(F.transform(json_ld_scripts(html), objects)), values))
    return _FIRST(every)


def staff_text(text: Column) -> Column:
    """Head count wording of a page text as written; NULL for blocked pages."""

    def read(clean: Column) -> Column:
        found = F.array(*[plain_size_text(F.regexp_extract(clean, p, 1)) for p in STAFF_WORDINGS])
        return F.when(~is_login_wall(clean, strict=False), _FIRST(found))

    return let(squeeze(F.translate(text, "\u2013\u2014\u00a0", "-- ")), read)


def company_page_size(html: Column) -> Column:
    """Embedded head count, else the wording in the page text."""
    return F.coalesce(json_ld_size(html), staff_text(visible_text(html)))


_INCLUDED = (
    "STRUCT<included: ARRAY<STRUCT<universalName: STRING, entityUrn: STRING, "
    "employeeCountRange: STRUCT<start: BIGINT, `end`: BIGINT>, employeeCount: BIGINT>>>"
)


def code_tag_size(html: Column, slug: Column) -> Column:
    """Size of the company with that slug from JSON kept in code tags."""
    blocks = F.filter(
        F.regexp_extract_all(html, F.lit(r"(?is)<code\b[^>]*>(.*?)</code>"), F.lit(1)),
        lambda b: F.contains(b, F.lit("employeeCountRange")),
    )
    items = F.flatten(F.transform(blocks, lambda b: F.coalesce(
        F.from_json(strip(unescape(b)), _INCLUDED)["included"],
        F.from_json(F.lit("[]"), _INCLUDED[len("STRUCT<included: "):-1]),
    )))
    target = F.lower(slug)

    def label(item: Column) -> Column:
        mine = (F.lower(item["universalName"]) == target) | F.contains(
            F.lower(item["entityUrn"]), F.concat(F.lit("company/"), target)
        )
        span = item["employeeCountRange"]
        by_range = F.when(span["start"].isNotNull(), range_label(span["start"], span["end"]))
        return F.when(F.coalesce(mine, F.lit(False)), F.coalesce(by_range, size_label(item["employeeCount"])))

    return _FIRST(F.transform(items, label))


def field_size(html: Column) -> Column:
    """Size label of a staff field in embedded data, whatever its nesting."""
    raw = F.regexp_extract(
        F.array_join(json_ld_scripts(html), "\n"),
        r'(?i)"(?:numberOfEmployees|employeeCount)"\s*:\s*(?:\{[^}]*\}\s*,?\s*)?"?([^",\}]+)"?', 1,
    )
    return normalize_size(F.nullif(strip(raw), F.lit("")))


class _Page(HTMLParser):
    """Elements in the order of their start tags, read in one pass; an element is its place among them.

    Visible texts stand once in ``texts``; of an element it is known which of them
    (``first`` to ``last``), and which of the elements behind it (up to ``inside``), lie inside.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self._clear()

    def _clear(self):
        self.tags: list[str] = []
        self.given: list[str | dict] = []  # attributes, as text until they are asked for
        self.first: list[int] = []
        self.last: list[int] = []
        self.inside: list[int] = []
        self.texts: list[str] = []
        self.open: list[int] = []
        self.depth: defaultdict[str, int] = defaultdict(int)

    def handle_starttag(self, tag, attrs):
        self._start(tag, {k: v or "" for k, v in attrs})

    def _start(self, tag, given):
        node, at = len(self.tags), len(self.texts)
        self.tags.append(tag)
        self.given.append(given)
        self.first.append(at)
        self.last.append(at)
        self.inside.append(node + 1)
        if tag not in _VOID:
            self.open.append(node)
            self.depth[tag] += 1

    def handle_endtag(self, tag):
        depth = self.depth
        if not depth[tag]:
            return
        at, behind, name = len(self.texts), len(self.tags), None
        while name != tag:
            node = self.open.pop()
            name = self.tags[node]
            depth[name] -= 1
            self.last[node], self.inside[node] = at, behind

    def handle_data(self, data):
        if not self.depth["script"] and not self.depth["style"]:
            self.texts.append(data)

    def _read_plain(self, html: str) -> bool:
        """Read a page of plain markup alone; False, with some of it read, for any other."""
        parts = _TOKEN.split(html)  # what stands between tokens, then the four groups of a token, and so on
        rest = parts.pop()
        if any(parts[::5]) or "<" in rest or "&" in rest:
            return False
        # ``_start`` and ``handle_endtag`` once more in place: calls would cost as much as the work
        texts, tags, given, opened, depth = self.texts, self.tags, self.given, self.open, self.depth
        first, last, inside = self.first, self.last, self.inside
        for data, ends, starts, attributes in zip(parts[1::5], parts[2::5], parts[3::5], parts[4::5], strict=True):
            if data:
                texts.append(decoded(data) if "&" in data else data)
            if starts:
                tag = starts.lower()
                if tag in _RAW:
                    return False
                at = len(texts)
                if tag not in _VOID:
                    opened.append(len(tags))
                    depth[tag] += 1
                tags.append(tag)
                given.append(attributes)
                first.append(at)
                last.append(at)
                inside.append(len(tags))
            elif ends:
                tag = ends.lower()
                if depth[tag]:
                    at, behind, name = len(texts), len(tags), None
                    while name != tag:
                        node = opened.pop()
                        name = tags[node]
                        depth[name] -= 1
                        last[node], inside[node] = at, behind
        if rest:
            texts.append(rest)
        return True

    def read(self, html: str) -> "_Page":
        if not self._read_plain(html):
            self._clear()
            self.feed(html)
            self.close()
        for node in self.open:
            self.last[node], self.inside[node] = len(self.texts), len(self.tags)
        return self

    @property
    def elements(self) -> list[dict]:
        return [{"tag": tag, "attrs": self.attributes(n), "first": self.first[n], "place": n, "last": self.last[n],
                 "inside": self.inside[n]} for n, tag in enumerate(self.tags)]

    def attributes(self, node: int) -> dict[str, str]:
        given = self.given[node]
        if isinstance(given, str):
            found = _ATTRIBUTES.findall(given)
            given = self.given[node] = {k.lower(): decoded(v) if "&" in v else v for k, v in found}
        return given

    def parts(self, node: int) -> list[str]:
        return self.texts[self.first[node]:self.last[node]]

    def text(self, node: int | None) -> str | None:
        return None if node is None else "".join(self.parts(node)).strip()

    def find(self, tag: str, css: str | None = None, inside: int | None = None, **attrs) -> int | None:
        """First element of that kind, of the page or of those inside an element."""
        at, stop = (0, len(self.tags)) if inside is None else (inside + 1, self.inside[inside])
        while True:
            try:
                at = self.tags.index(tag, at, stop)
            except ValueError:
                return None
            given = self.given[at]
            # an entity stands for no letter of a class name: a text without the name needs no reading
            if not (css and isinstance(given, str) and css not in given):
                known = self.attributes(at)
                if not (css and css not in known.get("class", "").split()) \
                        and all(known.get(k) == v for k, v in attrs.items()):
                    return at
            at += 1


def _cards(html: str) -> list[dict]:
    if not html:
        return []
    page, found = _Page().read(html), []
    for card, tag in enumerate(page.tags):
        if tag != "li":
            continue
        link = page.find(*CARD_LINK, inside=card)
        if link is None:
            continue
        date = page.find("time", inside=card)
        found.append({
            "href": page.attributes(link).get("href", ""),
            "title": page.text(page.find(*CARD_TITLE, inside=card)),
            "company": page.text(page.find(*CARD_COMPANY, inside=card)),
            "location": page.text(page.find(*CARD_LOCATION, inside=card)),
            "date": None if date is None else page.attributes(date).get("datetime", ""),
        })
    return found


def _description(html: str) -> str:
    if not html:
        return ""
    page = _Page().read(html)
    lines = lambda node: "\n".join(s for s in (t.strip() for t in page.parts(node)) if s)
    options = [page.find(tag, css, **({"id": name} if name else {})) for tag, css, name in DESCRIPTION_ELEMENTS]
    for node in options:
        if node is not None and len(lines(node)) > DESCRIPTION_MINIMUM:
            return lines(node)
    main = page.find("main")
    return lines(main) if main is not None else ""


_CARD = StructType([StructField(n, StringType()) for n in ("href", "title", "company", "location", "date")])


_CARDS = to_arrow_type(ArrayType(_CARD))


def _read_cards(pages: pa.Array) -> pa.Array:
    return pa.array(map(_cards, pages.to_pylist()), type=_CARDS)


def _read_descriptions(pages: pd.Series) -> pd.Series:
    return pages.map(_description)


posting_cards = F.arrow_udf(_read_cards, ArrayType(_CARD))
posting_description = F.pandas_udf(_read_descriptions, StringType())
