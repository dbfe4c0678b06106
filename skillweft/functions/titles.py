"""Posting titles: cleaning, role filter, exclusion and keyword assignment."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from skillweft.dictionaries import (
    ROLE_EXCLUSIONS, ROLE_TERMS, SENIORITY_WORDS, TITLE_ACRONYMS, TITLE_REJECTS,
    TITLE_SUFFIX_PATTERNS,
)
from skillweft.functions.text import alternation, squeeze


def clean_title(title: Column) -> Column:
    """Drop work-mode suffixes and seniority words, capitalise words, keep known acronyms upper-case."""
    text = squeeze(F.lower(title))
    for pattern in TITLE_SUFFIX_PATTERNS:
        text = F.regexp_replace(text, f"(?iU){pattern}", "")
    words = F.filter(
        F.split(squeeze(text), " "),
        lambda w: ~F.translate(w, ",()", "").isin(*SENIORITY_WORDS) & (w != ""),
    )
    shown = F.transform(
        words,
        lambda w: F.when(F.upper(w).isin(*TITLE_ACRONYMS), F.upper(w)).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
        ),
    )
    return F.array_join(shown, " ")


def clean_title_text(title: str) -> str:
    """The same cleaning for one request text."""
    text = title.strip().lower()
    for pattern in TITLE_SUFFIX_PATTERNS:
        text = re.sub(pattern, "", text, flags=re.IGNORECASE)
    kept = [w for w in text.split() if w.translate(str.maketrans("", "", ",()")) not in SENIORITY_WORDS]
    return " ".join(w.upper() if w.upper() in TITLE_ACRONYMS else w.capitalize() for w in kept)


def is_target_role(title: Column) -> Column:
    text = F.lower(F.coalesce(title, F.lit("")))
    return text.rlike(alternation(ROLE_TERMS)) & ~text.rlike(alternation(ROLE_EXCLUSIONS))


def is_excluded(title: Column) -> Column:
    """A reject phrase starts the title or starts one of its words."""
    return F.concat(F.lit(" "), F.lower(title)).rlike(f" ({alternation(TITLE_REJECTS)})")
