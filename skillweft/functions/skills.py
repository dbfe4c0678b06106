"""Skill spelling: normalising, classifying, list clean-up and grounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skillweft.dictionaries import (
    GENERIC_TERMS, INDONESIAN_SKILLS, SKILL_ALIASES, SOFT_SKILL_INDICATORS, SOFT_SKILL_PHRASES,
    SPECIFIC_FIXES, SYNONYMS,
)
from skillweft.functions.text import alternation, first_contained, first_pair, let, one_of_pairs, strip

# longest phrase first; the whole text equal to a phrase is then the longest hit by itself
_PHRASES = sorted(INDONESIAN_SKILLS, key=lambda pair: len(pair[0]), reverse=True)


def normalize_skill(skill: Column) -> Column:
    """Comparison key: English phrase, lower case, no odd characters, single separators.

    Hyphens and commas become spaces last, so runs of spaces can remain.
    """
    text = let(
        strip(F.lower(F.coalesce(skill, F.lit("")))),
        lambda x: F.coalesce(first_contained(x, _PHRASES), x),
    )
    text = F.replace(text, F.lit("/"), F.lit(" "))
    text = F.regexp_replace(text, r"(?U)[^\w\s\-+#./]", "")
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    text = F.regexp_replace(text, r"^[\s\-.(]+|[\s\-.)]+$", "")
    return F.trim(F.translate(text, ",-", "  "))


def light_key(skill: Column) -> Column:
    """Lighter key used to deduplicate lists and to look skills up in a text."""
    return F.trim(F.regexp_replace(F.replace(F.lower(skill), F.lit("-"), F.lit(" ")), r"(?U)\s+", " "))


def lower_key(skill: Column) -> Column:
    return strip(F.lower(skill))


def specific_fix(skill: Column) -> Column:
    return one_of_pairs(lower_key(skill), SPECIFIC_FIXES)


def is_generic(skill: Column) -> Column:
    return lower_key(skill).isin(*GENERIC_TERMS)


def is_soft_skill(skill: Column) -> Column:
    return lower_key(skill).rlike(alternation(SOFT_SKILL_INDICATORS))


def classify(skill: Column) -> Column:
    empty = skill.isNull() | (skill == "")
    return (
        F.when(empty, "unknown").when(is_generic(skill), "GENERIC")
        .when(is_soft_skill(skill), "Soft Skill").otherwise("unknown")
    )


def synonym(skill: Column, loose: bool = True) -> Column:
    """English synonym: exact key, else (``loose``) the first entry contained either way."""
    def find(text: Column) -> Column:
        exact = one_of_pairs(text, SYNONYMS)
        if not loose:
            return exact
        return F.coalesce(exact, first_pair(SYNONYMS, lambda k: F.contains(text, k) | F.contains(k, text)))

    return let(lower_key(skill), find)


def dedup_keep_first(items: Column, key=light_key) -> Column:
    """Drop later items with the same key; blank keys go as well."""

    # one struct of both lists: an expression that a lambda mentions is worked out again for every entry
    def firsts(both: Column) -> Column:
        distinct = F.filter(F.array_distinct(both["keys"]), lambda k: k != "")
        return F.transform(
            distinct, lambda k: F.element_at(both["items"], F.array_position(both["keys"], k).cast("int")))

    return let(let(items, lambda x: F.struct(x.alias("items"), F.transform(x, key).alias("keys"))), firsts)


_SHORTEST_PHRASE = min(map(len, SOFT_SKILL_PHRASES))


def _is_run(token: Column) -> Column:
    return token.rlike(r"\A[a-z0-9]+\z")


def _entry_key(skill: Column) -> Column:
    """``light_key``; an entry that is one run of letters and digits needs no clean-up."""
    return let(F.lower(skill), lambda low: F.when(_is_run(low), low).otherwise(light_key(low)))


def _soft_key(key: Column) -> Column:
    """A light key that mentions a soft phrase; a shorter one than any phrase cannot."""
    return key.isNotNull() & (F.length(key) >= _SHORTEST_PHRASE) & key.rlike(alternation(SOFT_SKILL_PHRASES))


def looks_soft(skill: Column) -> Column:
    return light_key(skill).rlike(alternation(SOFT_SKILL_PHRASES))


def reclassify(skills: Column) -> Column:
    """Move soft-looking entries of technical_skill to soft_skill and deduplicate each list."""
    none = F.array().cast("array<string>")

    # the key of an entry serves the test and the deduplication
    def keyed(name: str) -> Column:
        return F.transform(
            F.coalesce(skills[name], none), lambda s: F.struct(s.alias("item"), _entry_key(s).alias("key")))

    def firsts(entries: Column) -> Column:
        def pick(both: Column) -> Column:
            distinct = F.filter(F.array_distinct(both["keys"]), lambda k: k != "")
            return F.transform(distinct, lambda k: F.element_at(
                both["entries"], F.array_position(both["keys"], k).cast("int"))["item"])

        return let(let(entries, lambda e: F.struct(e.alias("entries"), e["key"].alias("keys"))), pick)

    def lists(row: Column) -> Column:
        technical = row["technical"]
        moved = F.filter(technical, lambda e: _soft_key(e["key"]))
        stays = F.filter(technical, lambda e: e["key"].isNotNull() & ~_soft_key(e["key"]))
        return F.struct(
            firsts(row["tools"]).alias("tech_stack"),
            firsts(stays).alias("technical_skill"),
            firsts(F.concat(row["soft"], moved)).alias("soft_skill"),
        )

    return let(F.struct(
        keyed("tech_stack").alias("tools"), keyed("technical_skill").alias("technical"), keyed("soft_skill").alias("soft")
    ), lists)


def contains_token(text: Column, token: Column) -> Column:
    """Token occurs in the text with no letter or digit next to it."""
    pattern = F.concat(F.lit(r"(?<![a-z0-9])\Q"), token, F.lit(r"\E(?![a-z0-9])"))
    return (token != "") & F.contains(text, token) & F.rlike(text, pattern)


def _blank_runs(text: Column) -> Column:
    """The text's runs of letters a-z and digits, each between blanks."""
    return F.concat(F.lit(" "), F.regexp_replace(text, "[^a-z0-9]+", " "), F.lit(" "))


def _contains_run(runs: Column, token: Column) -> Column:
    """``contains_token`` of a token that is one run, without a pattern per token."""
    return F.contains(runs, F.concat(F.lit(" "), token, F.lit(" ")))


def is_grounded(skill: Column, text: Column, runs: Column | None = None) -> Column:
    """The text (already a light key) mentions the skill, a known short form or 60 % of its words.

    ``runs`` are the text's runs, where they are worked out already.
    """
    if runs is None:
        return let(F.struct(text.alias("text"), _blank_runs(text).alias("runs")),
                   lambda row: is_grounded(skill, row["text"], row["runs"]))

    def found(token: Column) -> Column:
        return F.when(_is_run(token), _contains_run(runs, token)).otherwise(contains_token(text, token))

    def short_form(key: Column) -> Column:
        aliases = F.try_element_at(
            F.create_map(*[x for k, v in SKILL_ALIASES for x in (F.lit(k), F.array(*map(F.lit, v)))]), key
        )
        return F.coalesce(F.exists(aliases, found), F.lit(False))

    def mentioned(key: Column) -> Column:
        def enough(words: Column) -> Column:
            hits = F.size(F.filter(words, found))
            return (F.size(words) > 0) & (hits >= 0.6 * F.size(words))

        by_words = let(F.filter(F.split(key, " "), lambda w: F.length(w) >= 3), enough)
        return (key != "") & (contains_token(text, key) | short_form(key) | by_words)

    # a single run is its own key and its only word
    return let(F.lower(skill), lambda low: F.when(_is_run(low), _contains_run(runs, low) | short_form(low)).otherwise(
        let(light_key(low), mentioned)))


def keep_grounded(skills: Column, source_text: Column) -> Column:
    """Drop tool and technical entries that the source text does not mention; soft skills stay."""

    def kept(row: Column) -> Column:
        lists, grounded = row["lists"], lambda s: is_grounded(s, row["text"], row["runs"])
        return F.struct(
            F.filter(lists["tech_stack"], grounded).alias("tech_stack"),
            F.filter(lists["technical_skill"], grounded).alias("technical_skill"),
            lists["soft_skill"].alias("soft_skill"),
        )

    # the lists, the key of the text and its runs are worked out once, not once per entry
    key = light_key(F.coalesce(source_text, F.lit("")))
    return let(let(F.struct(skills.alias("lists"), key.alias("text")), lambda row: F.struct(
        row["lists"].alias("lists"), row["text"].alias("text"), _blank_runs(row["text"]).alias("runs"))), kept)


def parse_skill_text(text: Column, scalar: bool = False) -> Column:
    """Stored skill text -> list.

    JSON list text is parsed (single quotes allowed).  Other text is one entry
    when ``scalar``, else a comma list whose entries are trimmed.
    """
    listed = F.from_json(F.translate(text, "'", '"'), "array<string>")
    other = F.array(text) if scalar else F.transform(F.split(text, ","), strip)
    return F.when(F.startswith(text, F.lit("[")), listed).otherwise(other)
