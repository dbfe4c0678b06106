"""Keyword assignment for posting titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skillweft.dictionaries import TITLE_REASON_EXCLUDED, TITLE_REASON_REJECTED
from skillweft.functions.titles import clean_title, is_excluded
from skillweft.operators.containment import FEW, contained_words
from skillweft.session import cut_lineage


def match_keyword(titles: DataFrame, keywords: DataFrame, title: str = "job_title") -> DataFrame:
    """Add keyword_id and matched_keyword: all words of the keyword occur in the title.

    The longest keyword wins, then the lowest id.  Matching runs on distinct
    lower-case titles.
    """
    texts = cut_lineage(titles.select(F.lower(title).alias("text")).distinct())
    known = keywords.select("id", "keyword", F.lower("keyword").alias("phrase"))
    best = (
        contained_words(texts, known).join(known, "phrase")
        .groupBy("text").agg(F.min_by(
            F.struct("id", "keyword"), F.struct(-F.length("keyword"), F.col("id"), F.col("keyword"))
        ).alias("hit"))
        .select("text", F.col("hit.id").alias("matched_id"), F.col("hit.keyword").alias("matched_keyword"))
    )
    best = cut_lineage(best)
    if best.count() <= FEW:  # few distinct titles are sent to the rows, which then need no shuffle by title
        best = F.broadcast(best)
    return titles.join(best, F.lower(F.col(title)) == F.col("text"), "left").drop("text")


def normalize_titles(titles: DataFrame, keywords: DataFrame, title: str = "job_title") -> DataFrame:
    """Clean title, keyword, status (accepted, rejected, excluded) and reason."""
    cleaned = titles.withColumn("title_clean", clean_title(F.col(title)))
    matched = match_keyword(cleaned, keywords, "title_clean")
    excluded = is_excluded(F.col("title_clean"))
    hit = F.col("matched_id").isNotNull()
    return matched.select(
        *titles.columns,
        "title_clean",
        F.when(~excluded, F.col("matched_id")).alias("keyword_id_matched"),
        F.when(~excluded, F.col("matched_keyword")).alias("matched_keyword"),
        F.when(excluded, "excluded").when(hit, "accepted").otherwise("rejected").alias("title_status"),
        F.when(excluded, TITLE_REASON_EXCLUDED).when(~hit, TITLE_REASON_REJECTED).alias("reason"),
    )
