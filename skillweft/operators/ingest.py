"""Posting ingest: list pages -> new job rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skillweft.functions.companies import job_url
from skillweft.functions.html import first_company_link, posting_cards, posting_description
from skillweft.functions.text import iso_date_or
from skillweft.functions.titles import clean_title, is_target_role
from skillweft.operators.rewrite import append_absent
from skillweft.operators.titles import match_keyword
from skillweft.session import cut_lineage


def cards(pages: DataFrame) -> DataFrame:
    """(page_id, keyword_id, pos, href, title, company, location, date) from list pages (page_id, keyword_id, html)."""
    return pages.select(
        "page_id", "keyword_id", F.posexplode(posting_cards("html")).alias("pos", "card")
    ).select("page_id", "keyword_id", "pos", "card.*")


def postings_from_cards(found: DataFrame, keywords: DataFrame, today: Column) -> DataFrame:
    """Job rows: posting link, clean title of a wanted role, keyword by title, defaults for missing cells."""
    rows = found.withColumn("link", job_url(F.col("href"))).filter(F.col("link").isNotNull()).filter(
        F.col("title") != ""
    ).withColumn("job_title", clean_title(F.col("title")))
    # pages are parsed and titles cleaned once: the wanted rows are far smaller than the pages and feed several joins
    wanted = cut_lineage(rows.filter(is_target_role(F.col("job_title"))).drop("href", "title"))
    matched = match_keyword(wanted, keywords, "job_title")
    return matched.select(
        "link", "job_title", F.coalesce("matched_id", "keyword_id").alias("keyword_id"),
        F.coalesce("company", F.lit("N/A")).alias("company"),
        F.coalesce(F.nullif("location", F.lit("")), F.lit("Indonesia")).alias("location"),
        iso_date_or(F.col("date"), today).alias("posted_date"), "page_id", "pos",
    )


def new_postings(pages: DataFrame, jobs: DataFrame, keywords: DataFrame, today: Column) -> DataFrame:
    """Rows to append: the first card per link that is not stored yet."""
    rows = postings_from_cards(cards(pages), keywords, today)
    return append_absent(jobs, rows, "link", F.struct("page_id", "pos")).drop("page_id", "pos")


def with_details(jobs: DataFrame, detail_pages: DataFrame) -> DataFrame:
    """Add job_description and company_url from detail pages (link, html)."""
    details = detail_pages.select(
        "link", posting_description("html").alias("job_description"),
        first_company_link(F.col("html")).alias("company_url"),
    )
    return jobs.join(details, "link", "left").withColumn(
        "job_description", F.coalesce("job_description", F.lit(""))
    )
