"""Filter options and list pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skillweft.operators.facets import Facets, filter_rows, or_default, present, select_jobs
from skillweft.operators.ordering import first_number, top_n


def _option(df: DataFrame, facet: str, value, count=None, order=None) -> DataFrame:
    return df.select(
        F.lit(facet).alias("facet"), value.cast("string").alias("value"),
        (count if count is not None else F.lit(None)).cast("bigint").alias("cnt"),
        (order if order is not None else F.lit(0)).cast("bigint").alias("sort_key"),
    )


def filter_options(t, companies: int = 100) -> DataFrame:
    """All filter options as (facet, value, cnt, sort_key) rows.

    Company, size, month and year counts come from one pass over the jobs.
    """
    sets = t.jobs.select(
        "company", "employee_size",
        F.month("posted_date").alias("month"), F.year("posted_date").alias("year"), "keyword",
    ).groupingSets(
        [["company"], ["employee_size"], ["month"], ["year"], ["keyword"]],
        "company", "employee_size", "month", "year", "keyword",
    ).agg(F.count(F.lit(1)).alias("cnt"), F.grouping_id().alias("gid"))
    # grouping id: one zero bit marks the column that was grouped on
    one = {"company": 0b01111, "employee_size": 0b10111, "month": 0b11011, "year": 0b11101, "keyword": 0b11110}
    cnt = F.col("cnt")

    def part(name: str) -> DataFrame:
        return sets.filter((F.col("gid") == one[name]) & F.col(name).isNotNull())

    best = top_n(part("company").filter(F.col("company") != ""), [F.desc("cnt"), F.asc("company")], companies)
    places = t.job_analysis.filter(present("location", "other", "Remote")).groupBy("location").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    last = t.job_analysis.agg(F.max("extracted_at").alias("at"))
    return (
        _option(part("keyword"), "keyword", F.col("keyword"), cnt)
        .union(_option(best, "company", F.col("company"), cnt))
        .union(_option(part("employee_size").filter(F.col("employee_size") != ""), "employee_size",
                       F.col("employee_size"), cnt, first_number("employee_size")))
        .union(_option(part("month"), "month", F.col("month"), cnt, F.col("month")))
        .union(_option(part("year"), "year", F.col("year"), cnt, -F.col("year")))
        .union(_option(places, "city", F.col("location"), cnt))
        .union(_option(t.skill_types, "skill_type", F.col("name")))
        .union(_option(last, "last_extraction", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")))
    )


def months_and_years(jobs: DataFrame) -> DataFrame:
    """Distinct months ascending and years descending as two lists (12 months, one entry per year)."""
    return jobs.filter(F.col("posted_date").isNotNull()).agg(
        F.array_sort(F.collect_set(F.month("posted_date"))).alias("months"),
        F.sort_array(F.collect_set(F.year("posted_date")), asc=False).alias("years"),
    )


def job_list(t, facets: Facets, limit: int = 50) -> DataFrame:
    """Newest postings with their keyword text and display defaults."""
    rows = select_jobs(t.jobs, t.job_analysis, facets)
    return rows.orderBy(F.desc("posted_date"), F.asc("id")).limit(limit).select(
        "id", "job_title", "company", or_default("location", "Indonesia").alias("location"), "keyword",
        F.coalesce(F.date_format("posted_date", "yyyy-MM-dd"), F.lit("")).alias("posted_date"),
        F.coalesce(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("created_at"),
    )


def analysis_page(analysis: DataFrame, facets: Facets, offset: int, limit: int) -> DataFrame:
    """One page of analysed jobs, newest first, with the number of rows that pass the facets."""
    rows = filter_rows(analysis, facets)
    if facets.locations:
        rows = rows.filter(F.col("location").isin(*facets.locations))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        rows.orderBy(F.desc("extracted_at"), F.asc("id")).offset(offset).limit(limit)
        .select("id", "job_id", "job_title", "company", "location", "keyword",
                F.date_format("extracted_at", "yyyy-MM-dd'T'HH:mm:ss").alias("extracted_at"))
        .withColumn("total", total)
    )


def table_page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
