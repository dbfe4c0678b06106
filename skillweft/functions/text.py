"""Small text expressions shared by the skill, place and company functions."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(column: Column) -> Column:
    """Trim every kind of whitespace."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def squeeze(column: Column) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"(?U)\s+", " "))


def title_case(column: Column) -> Column:
    """Capital after every non-letter, also after hyphens ('toli-toli' -> 'Toli-Toli')."""
    pieces = F.regexp_extract_all(F.lower(column), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    shown = F.transform(
        pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))
    )
    return F.array_join(shown, "")


def alternation(words: list[str]) -> str:
    """Regex that finds any of the words, taken literally."""
    return "|".join(rf"\Q{w}\E" for w in words)


def pair_table(pairs: list[tuple[str, str]]) -> Column:
    """A small fixed table as one array literal of (k, v), in table order."""
    rows = json.dumps([{"k": k, "v": v} for k, v in pairs])
    return F.from_json(F.lit(rows), "array<struct<k: string, v: string>>")


def first_pair(pairs: list[tuple[str, str]], test) -> Column:
    """Value of the first entry whose key passes the test, else NULL."""
    return F.get(F.filter(pair_table(pairs), lambda p: test(p["k"])), F.lit(0))["v"]


def one_of_pairs(key: Column, pairs: list[tuple[str, str]]) -> Column:
    """Value for an exact key of a small fixed table, else NULL."""
    return F.try_element_at(F.from_json(F.lit(json.dumps(dict(pairs))), "map<string, string>"), key)


def first_contained(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Value of the first key, in table order, that the text contains."""
    return F.when(
        text.rlike(alternation([k for k, _ in pairs])), first_pair(pairs, lambda k: F.contains(text, k))
    )


def strip_count(column: Column) -> Column:
    """Drop a trailing '(123)'."""
    return F.regexp_replace(column, r"\s*\(\d+\)\s*$", "")


def format_duration(seconds: Column) -> Column:
    """'45s', '3m 20s' or '2h 5m'."""
    whole = F.floor(seconds)
    return (
        F.when(seconds < 60, F.format_string("%ds", whole))
        .when(seconds < 3600, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60)))
    )


def iso_date_or(column: Column, fallback: Column) -> Column:
    """Date part of an ISO date or timestamp; the fallback where it cannot be read."""
    stamp = F.try_to_timestamp(F.replace(column, F.lit("Z"), F.lit("+00:00")))
    return F.coalesce(F.to_date(stamp), fallback)


def fixed_offset_time(column: Column, offset: str = "+07:00") -> Column:
    """UTC time -> local wall-clock time without zone."""
    return F.from_utc_timestamp(column, offset).cast("timestamp_ntz")
