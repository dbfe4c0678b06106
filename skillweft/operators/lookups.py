"""Filters and joins that look rows up: staged searches, anti joins, latest rows, page lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skillweft.operators.facets import blank, contains_any, present


def exact_else_contains(df: DataFrame, column: str, text: str, extra: Column | None = None,
                        key: str = "id") -> DataFrame:
    """The row whose column equals the text (no case), else contains it; lowest id wins.

    No row matches: empty result.
    """
    wanted = F.lit(text.strip().lower())
    exact = F.lower(column) == wanted
    if extra is not None:
        exact = exact | extra
    stage = F.when(exact, 1).when(F.contains(F.lower(column), wanted), 2)
    staged = df.withColumn("stage", stage).filter(F.col("stage").isNotNull())
    return staged.orderBy("stage", key).limit(1)


def first_stage_only(df: DataFrame, stages: list[Column]) -> DataFrame:
    """Rows of the first stage that matches anything, with the stage number.

    The winning stage is a one-row subquery, so rows are never gathered to compare them.
    """
    stage = F.coalesce(*[F.when(test, F.lit(i)) for i, test in enumerate(stages, 1)])
    staged = df.withColumn("stage", stage).filter(F.col("stage").isNotNull())
    return staged.filter(F.col("stage") == staged.agg(F.min("stage").alias("m")).scalar())


def search_jobs(
    jobs: DataFrame, keywords: DataFrame, title: str, clean: str, size: str | None = None
) -> DataFrame:
    """Title contains the text; else keyword contains it; else title has any longer word of it."""
    first_keyword = (
        keywords.filter(contains_any("keyword", [title])).agg(F.min("id").alias("id")).scalar()
    )
    words = [w for w in clean.split() if len(w) > 2]
    by_word = contains_any("job_title", words) if words else F.lit(False)
    rows = jobs.filter(F.col("employee_size") == size) if size else jobs
    return first_stage_only(
        rows, [contains_any("job_title", [clean, title]), F.col("keyword_id") == first_keyword, by_word]
    )


def single_row(df: DataFrame, key: str, value, order: str = "id") -> DataFrame:
    return df.filter(F.col(key) == F.lit(value)).orderBy(order).limit(1)


def without_match(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    keys = right.select(F.col(right_key).alias("_k"))
    return left.join(keys, F.col(key) == F.col("_k"), "left_anti")


def with_match(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    keys = right.select(F.col(right_key).alias("_k"))
    return left.join(keys, F.col(key) == F.col("_k"), "left_semi")


def unprocessed_jobs(jobs: DataFrame, links: DataFrame) -> DataFrame:
    return without_match(jobs, links, "id", "job_id").select("id")


def blank_analysis_jobs(jobs: DataFrame, analysis: DataFrame, nulls_count: bool = True) -> DataFrame:
    """Analysed jobs whose three skill columns are empty.

    ``nulls_count=False`` accepts only empty strings, as an IN list with NULL does.
    """
    columns = ["tech_stack", "technical_skill", "soft_skill"]
    test = F.lit(True)
    for c in columns:
        empty = F.coalesce(F.trim(c), F.lit("")) == "" if nulls_count else F.col(c) == ""
        test = test & empty
    return with_match(jobs, analysis.filter(test), "id", "job_id").select("id")


def companies_to_enrich(jobs: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Companies without an enrichment row, with their number of jobs."""
    counts = jobs.filter(present("company", "N/A")).groupBy("company").agg(
        F.count(F.lit(1)).alias("job_count")
    )
    return without_match(counts, enrichment, "company", "company_name")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Newest row per key; only one row per key and task is shuffled."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_r") == 1).drop("_r")


def latest_url(jobs: DataFrame) -> DataFrame:
    """Company -> URL of its newest job that has one."""
    return jobs.filter(present("company") & present("company_url")).groupBy("company").agg(
        F.max_by("company_url", "id").alias("company_url")
    )


def null_safe_match(left: DataFrame, right: DataFrame, equal: list[str], null_safe: list[str]) -> DataFrame:
    """Inner join on plain and null-safe keys; columns of ``right`` other than keys are added."""
    renamed = right.select(*[F.col(c).alias(f"_{c}") for c in right.columns])
    test = F.lit(True)
    for c in equal:
        test = test & (F.col(c) == F.col(f"_{c}"))
    for c in null_safe:
        test = test & F.col(c).eqNullSafe(F.col(f"_{c}"))
    values = [c for c in right.columns if c not in (*equal, *null_safe)]
    return left.join(renamed, test).select(*left.columns, *[F.col(f"_{c}").alias(c) for c in values])


def missing_urls(jobs: DataFrame) -> DataFrame:
    return jobs.filter(blank("company_url"))
