"""Company names, page addresses (slugs) and whether the two fit together."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skillweft.dictionaries import (
    COMPANY_URL_PATTERN, COMPANY_URL_PREFIX, CORPORATE_SUFFIXES, IGNORED_NAME_WORDS, JOB_URL_PREFIX,
    LOGIN_WALL_MARKERS, NAME_STOPWORDS, REGIONAL_WORDS, SHORT_CORPORATE_SUFFIXES, SLUG_NOISE_PATTERN,
    SLUG_STOPWORDS, TITLE_STOPWORDS,
)
from skillweft.functions.text import alternation, let, squeeze, strip


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def unquote(url: Column) -> Column:
    """Percent decoding that leaves '+' and broken escapes alone."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def company_url(url: Column) -> Column:
    """Absolute company address with its whole path, on the main host."""
    found = F.regexp_extract(unquote(url), COMPANY_URL_PATTERN + r"(?U:[\w\-_/%.]+)", 0)
    path = F.rtrim(F.regexp_extract(found, r"^[a-zA-Z]+://[^/]+(/.*)$", 1), F.lit("/"))
    return F.when(
        F.startswith(path, F.lit("/company/")), F.concat(F.lit("https://www.linkedin.com"), path, F.lit("/"))
    )


def canonical_url(url: Column) -> Column:
    """Company address from an absolute or relative link, reduced to its slug."""

    def build(text: Column) -> Column:
        slug = F.coalesce(
            _filled(F.regexp_extract(text, COMPANY_URL_PATTERN + r"((?U:[\w\-_.]+))", 1)),
            _filled(F.regexp_extract(text, r"/company/((?U:[\w\-_.]+))", 1)),
        )
        return F.when(slug.isNotNull(), F.concat(F.lit(COMPANY_URL_PREFIX), slug, F.lit("/")))

    return let(unquote(url), build)


def company_slug(url: Column) -> Column:
    """Slug after '/company/' anywhere in the address."""
    return _filled(F.regexp_extract(url, r"/company/([^/?#]+)", 1))


def path_slug(url: Column) -> Column:
    """Lower-case slug of an address whose path starts with '/company/'; '' otherwise."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)
    last = F.element_at(F.split(F.rtrim(path, F.lit("/")), "/company/"), -1)
    return F.coalesce(F.when(F.startswith(path, F.lit("/company/")), F.lower(strip(last))), F.lit(""))


def job_url(url: Column) -> Column:
    """Canonical posting address from its trailing number; NULL for other links."""
    part = F.regexp_extract(url, r"/jobs/view/([^?]+)", 1)
    number = _filled(F.regexp_extract(part, r"(\d+)$", 1))
    return F.concat(F.lit(JOB_URL_PREFIX), number, F.lit("/"))


def slugify(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(squeeze(name)), r"[^a-z0-9]+", "-")
    return F.trim(dashed, F.lit("-"))


def name_words(name: Column) -> Column:
    return F.filter(F.split(F.lower(squeeze(name)), r"[^a-z0-9]+"), lambda w: w != "")


def strip_suffixes(name: Column) -> Column:
    """Words without leading and trailing legal forms; the name itself when nothing is left."""

    def core(words: Column) -> Column:
        flags = F.transform(words, lambda w: w.isin(*CORPORATE_SUFFIXES))
        first = F.array_position(flags, F.lit(False)).cast("int")
        behind = (F.array_position(F.reverse(flags), F.lit(False)) - 1).cast("int")
        kept = F.slice(words, first, F.size(words) - behind - first + 1)
        return F.when(first > 0, F.array_join(kept, " "))

    return F.coalesce(let(name_words(name), core), squeeze(name))


def name_variants(name: Column) -> Column:
    """The name, its parts, bracketed text, bracket-free and dash-free forms, and acronyms."""

    def build(base: Column) -> Column:
        forms = F.concat(
            F.array(base),
            F.split(base, r"\s*[|/]\s*"),
            F.regexp_extract_all(base, F.lit(r"\(([^\)]+)\)"), F.lit(1)),
            F.array(F.regexp_replace(base, r"\([^\)]*\)", " "), F.replace(base, F.lit("-"), F.lit(" "))),
            F.regexp_extract_all(base, F.lit(r"\b([A-Z]{2,8})\b"), F.lit(1)),
        )
        return F.array_distinct(F.filter(F.transform(forms, squeeze), lambda v: v != ""))

    return let(squeeze(name), build)


def slug_candidates(name: Column) -> Column:
    """Slugs of every variant, without and with legal forms."""
    slugs = F.flatten(F.transform(
        name_variants(name), lambda v: F.array(slugify(strip_suffixes(v)), slugify(v))
    ))
    return F.array_distinct(F.filter(slugs, lambda s: s != ""))


def guessed_slugs(name: Column) -> Column:
    """Full slug, slug without common company words, first long word and first two long words."""

    def dash(text: Column) -> Column:
        return F.trim(F.regexp_replace(F.replace(text, F.lit(" "), F.lit("-")), "-+", "-"), F.lit("-"))

    def build(clean: Column) -> Column:
        def forms(short: Column) -> Column:
            words = F.filter(F.split(short, " "), lambda w: (F.length(w) >= 4) & ~w.isin(*SLUG_STOPWORDS))
            first = F.get(words, F.lit(0))
            second = F.concat(first, F.lit("-"), F.get(words, F.lit(1)))
            listed = F.array_compact(F.array(dash(clean), dash(short), first, second))
            return F.array_distinct(F.filter(listed, lambda s: s != ""))

        return let(squeeze(F.regexp_replace(clean, f"(?i){SLUG_NOISE_PATTERN}", "")), forms)

    return let(squeeze(F.regexp_replace(F.lower(strip(name)), r"[^a-z0-9\s-]", " ")), build)


def _telling_words(name: Column) -> Column:
    return F.filter(
        name_words(name),
        lambda w: ~w.isin(*CORPORATE_SUFFIXES, *IGNORED_NAME_WORDS) & (F.length(w) > 1),
    )


def is_regional(name: Column) -> Column:
    return F.lower(squeeze(name)).rlike(alternation(REGIONAL_WORDS))


def _all_but_one(hits: Column, words: Column) -> Column:
    return hits >= F.greatest(F.lit(1), F.size(words) - 1)


def slug_fits_name(url: Column, name: Column) -> Column:
    """Does the slug share enough words with the name or one of its variants?"""

    def test(slug_words: Column) -> Column:
        primary = _telling_words(F.get(F.split(name, r"\s*[|/]\s*"), F.lit(0)))

        def fits(variant: Column) -> Column:
            def enough(words: Column) -> Column:
                hits = F.size(F.filter(words, lambda w: F.array_contains(slug_words, w)))
                return (F.size(words) > 0) & F.when(is_regional(variant), hits >= F.size(words)).otherwise(
                    _all_but_one(hits, words)
                )

            return let(_telling_words(variant), enough)

        none_primary = (F.size(primary) > 0) & ~F.exists(primary, lambda w: F.array_contains(slug_words, w))
        return (F.size(slug_words) > 0) & ~none_primary & F.exists(name_variants(name), fits)

    words = F.filter(F.split(path_slug(url), r"[^a-z0-9]+"), lambda w: w != "")
    return F.coalesce(let(words, test), F.lit(False))


def plain_text(text: Column) -> Column:
    """Lower case, ordinary dashes and spaces, whitespace collapsed."""
    return F.lower(squeeze(F.translate(text, "\u2013\u2014\u00a0", "-- ")))


def slug_contains_name(url: Column, name: Column) -> Column:
    """Fast check: all but one word of the name occur in the slug; a name of legal forms passes."""
    slug = F.translate(path_slug(url), "-_", "  ")
    words = F.filter(
        F.split(plain_text(name), " "),
        lambda w: (F.length(w) > 1) & ~w.isin(*SHORT_CORPORATE_SUFFIXES),
    )

    def enough(ws: Column) -> Column:
        hits = F.size(F.filter(ws, lambda w: F.contains(slug, w)))
        return (F.size(ws) == 0) | _all_but_one(hits, ws)

    ready = (slug != "") & (F.coalesce(name, F.lit("")) != "")
    return F.coalesce(ready & let(words, enough), F.lit(False))


def page_fits_name(url: Column, name: Column, page_text: Column) -> Column:
    """Does a company page (by its text and slug) belong to the name?"""

    def test(text: Column) -> Column:
        slug = squeeze(F.translate(path_slug(url), "-_/", "   "))
        words = _telling_words(name)
        seen = lambda w: F.contains(text, w) | F.contains(slug, w)
        hits = F.size(F.filter(words, seen))
        regions = F.filter(
            F.array(*map(F.lit, REGIONAL_WORDS)), lambda r: F.contains(F.lower(squeeze(name)), r)
        )
        regional = (hits >= F.size(words)) & F.exists(regions, seen)
        usable = (text != "") & ~F.contains(text, F.lit("page not found")) & ~F.contains(text, F.lit("404"))
        return usable & (path_slug(url) != "") & (F.size(words) > 0) & F.when(
            F.size(regions) > 0, regional
        ).otherwise(_all_but_one(hits, words))

    return F.coalesce(let(F.lower(squeeze(page_text)), test), F.lit(False))


def is_login_wall(text: Column, strict: bool = True) -> Column:
    """Blocked or empty page.  ``strict`` also rejects every text under 120 letters."""

    def test(clean: Column) -> Column:
        short = F.length(clean) < 120
        if not strict:
            short = short & F.contains(clean, F.lit("linkedin"))
        return (clean == "") | short | clean.rlike(alternation(LOGIN_WALL_MARKERS))

    return let(plain_text(text), test)


def name_in_text(name: Column, text: Column, threshold: int = 2) -> Column:
    """At least ``threshold`` (or all) telling words of the name occur in the text."""
    words = F.filter(
        F.regexp_extract_all(F.lower(name), F.lit(r"([a-zA-Z]{3,})"), F.lit(1)),
        lambda w: ~w.isin(*NAME_STOPWORDS),
    )

    def enough(ws: Column) -> Column:
        hits = F.size(F.filter(ws, lambda w: F.contains(F.lower(text), w)))
        return (F.size(ws) == 0) | (hits >= F.least(F.lit(threshold), F.size(ws)))

    return let(words, enough)


def title_names_company(title: Column, name: Column) -> Column:
    """Every longer telling word of the name occurs in the title."""
    words = F.filter(
        F.regexp_extract_all(F.lower(name), F.lit(r"([a-zA-Z]{4,})"), F.lit(1)),
        lambda w: ~w.isin(*TITLE_STOPWORDS),
    )
    return let(words, lambda ws: (F.size(ws) > 0) & F.forall(ws, lambda w: F.contains(F.lower(title), w)))


def is_improvement(found: Column, stored: Column, valid: Column) -> Column:
    """Validity of a found address that is new or differs; NULL when nothing changes."""
    missing = F.coalesce(stored, F.lit("")) == ""
    return F.when(found.isNotNull() & (missing | (found != stored)), valid)
