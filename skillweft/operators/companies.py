"""Company jobs: work lists, address and size updates, audits and enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skillweft.dictionaries import LARGE_COMPANY_WORDS
from skillweft.functions.companies import company_slug, company_url, is_improvement, slug_contains_name
from skillweft.functions.html import company_link
from skillweft.functions.sizes import VALID_SIZES, size_order
from skillweft.functions.text import alternation
from skillweft.operators.containment import contained_phrases
from skillweft.operators.facets import blank, present
from skillweft.operators.lookups import companies_to_enrich, latest_url
from skillweft.operators.ordering import percent
from skillweft.operators.rewrite import update_by_key, upsert
from skillweft.session import cut_lineage


def url_work_list(jobs: DataFrame) -> DataFrame:
    """Companies with jobs that lack an address: (company, job_count)."""
    return jobs.filter(F.col("company_url").isNull() & present("company", "N/A")).groupBy("company").agg(
        F.count(F.lit(1)).alias("job_count")
    )


def size_work_list(jobs: DataFrame, skip_existing: bool = True) -> DataFrame:
    """One row per (company, address, stored size) that needs a size, with its number of jobs."""
    rows = jobs
    if skip_existing:
        rows = jobs.filter(blank("employee_size") | ~F.col("employee_size").isin(*VALID_SIZES))
    return rows.groupBy("company", "company_url", "employee_size").agg(
        F.min("id").alias("job_id"), F.count(F.lit(1)).alias("job_count")
    )


def one_url_per_company(jobs: DataFrame) -> DataFrame:
    """Distinct companies without a size, with their smallest address and number of jobs."""
    return jobs.filter(present("company") & blank("employee_size")).groupBy("company").agg(
        F.min("company_url").alias("company_url"), F.count(F.lit(1)).alias("job_count")
    )


def unique_companies(jobs: DataFrame) -> DataFrame:
    return jobs.filter(present("company", "N/A")).groupBy("company").agg(F.count(F.lit(1)).alias("job_count"))


def missing_url_counts(jobs: DataFrame) -> DataFrame:
    """Rows, rows without an address and the covered share, in one row."""
    return jobs.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("company_url").isNull()).alias("missing")
    ).withColumn("covered_pct", percent(F.col("total") - F.col("missing"), F.col("total")))


def size_statistics(jobs: DataFrame) -> DataFrame:
    """Jobs, distinct companies and share per size (NULL is a group)."""
    # distinct companies are counted on the (size, company) level, never per size in one task
    pairs = jobs.groupBy("employee_size", "company").agg(F.count(F.lit(1)).alias("n"))
    sizes = pairs.groupBy("employee_size").agg(
        F.sum("n").alias("jobs"), F.count("company").alias("companies")
    )
    total = jobs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return sizes.withColumn("percentage", percent(F.col("jobs"), total))


def main_size(jobs: DataFrame) -> DataFrame:
    """Per company: the (address, size) group with most jobs, and any address.

    Ties go to the group with the smallest address, then the smallest size.
    """
    groups = jobs.filter(present("company", "N/A")).groupBy("company", "company_url", "employee_size").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    order = F.struct(-F.col("cnt"), F.coalesce("company_url", F.lit("")), F.coalesce("employee_size", F.lit("")))
    return groups.groupBy("company").agg(
        F.min_by("employee_size", order).alias("employee_size"),
        F.max("cnt").alias("cnt"),
        F.min_by("company_url", F.when(present("company_url"), order)).alias("company_url"),
    )


def suspicious_sizes(jobs: DataFrame, verified: DataFrame) -> DataFrame:
    """Companies whose stored size looks wrong, with the reason.

    ``verified`` is (company, size).  Labels are compared by size class, so both
    spellings of a class are equal.
    """
    known = verified.groupBy(F.col("company").alias("_c")).agg(F.max("size").alias("verified_size"))
    rows = main_size(jobs).filter(present("employee_size", "N/A")).join(known, F.col("company") == F.col("_c"), "left")
    size, top = size_order(F.col("employee_size")), 8
    large = F.lower("company").rlike(alternation(LARGE_COMPANY_WORDS))
    differs = F.col("verified_size").isNotNull() & ~size_order(F.col("verified_size")).eqNullSafe(size)
    words = F.size(F.filter(F.split("company", r"\s+"), lambda w: w != ""))
    reason = (
        F.when(differs, "verified")
        .when(size == top, F.when(~large, "too_large"))
        .when(size.isin(1, 2) & (words <= 3), "too_small")
    )
    return rows.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(
        "company", "company_url", "employee_size", "cnt", "verified_size", "reason"
    )


def repair_sizes(jobs: DataFrame, verified: DataFrame) -> DataFrame:
    """Jobs with the verified size where the audit found a difference."""
    fixes = suspicious_sizes(jobs, verified).filter(F.col("reason") == "verified").select(
        "company", F.col("verified_size").alias("employee_size")
    )
    return update_by_key(jobs, fixes, "company", "employee_size")


def propagate_sizes(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """Write one found size (company, company_url, employee_size) to all jobs of the company address."""
    return update_by_key(jobs, found, "company", "employee_size", null_safe="company_url")


def fill_urls(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """Write found addresses (company, company_url) where the job has none."""
    return update_by_key(jobs, found, "company", "company_url", only_null=True)


def repair_company(jobs: DataFrame, name: str, size: str) -> DataFrame:
    """Set the size of the first company whose name contains the text, on all its jobs with that address."""
    hit = jobs.filter(F.contains(F.lower("company"), F.lit(name.lower()))).agg(
        F.min_by(F.struct("company", "company_url"), "id").alias("h")
    ).select("h.company", "h.company_url", F.lit(size).alias("employee_size"))
    return propagate_sizes(jobs, hit)


def size_by_name(names: DataFrame, jobs: DataFrame) -> DataFrame:
    """Known size per name: from the company of that name, else one whose name contains it.

    Among several companies the one with the smallest job id decides.
    """
    known = cut_lineage(jobs.filter(present("company") & present("employee_size")).groupBy(
        F.lower(F.trim("company")).alias("text")
    ).agg(F.min_by("employee_size", "id").alias("size"), F.min("id").alias("first_id")))
    wanted = names.select("name", F.lower(F.trim("name")).alias("phrase")).distinct()
    exact = wanted.join(known, F.col("phrase") == F.col("text")).select("name", "size")
    rest = wanted.join(exact.select("name"), "name", "left_anti")
    pairs = contained_phrases(known.select("text"), rest.select("phrase"))
    inside = (
        pairs.join(known, "text").groupBy("phrase").agg(F.min_by("size", "first_id").alias("size"))
        .join(rest, "phrase").select("name", "size")
    )
    return exact.union(inside)


def by_source_priority(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """First non-blank value per company over sources in order: (company, value, source)."""
    ranked = reduce(DataFrame.unionByName, [
        df.select("company", "value", F.lit(i).alias("priority"), F.lit(name).alias("source"))
        for i, (name, df) in enumerate(sources)
    ])
    best = F.min_by(F.struct("value", "source"), F.struct("priority", "value"))
    return ranked.filter(present("value")).groupBy("company").agg(best.alias("b")).select(
        "company", F.col("b.value").alias("value"), F.col("b.source").alias("source")
    )


def extract_links(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Company address found on every job's page, whether it fits the company and improves the job.

    ``pages`` is (job_id, html).
    """
    found = jobs.select("id", "company", "company_url").join(
        pages.select(F.col("job_id").alias("id"), company_link(F.col("html")).alias("f")), "id", "left"
    )
    valid = F.when(F.col("f.url").isNotNull(), slug_contains_name(F.col("f.url"), F.col("company")))
    return found.select(
        "id", "company", "company_url", F.col("f.url").alias("found_url"),
        F.coalesce("f.strategy", F.lit("none")).alias("strategy"),
        F.coalesce("f.confidence", F.lit(0.0)).alias("confidence"), valid.alias("valid"),
    ).withColumn("improvement", is_improvement(F.col("found_url"), F.col("company_url"), F.col("valid")))


def strategy_statistics(links: DataFrame) -> DataFrame:
    """Per strategy: found, validated, improved and the success rate."""
    return links.filter(F.col("found_url").isNotNull()).groupBy("strategy").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("validated"),
        F.count_if("improvement").alias("improved"),
    ).withColumn("success_rate", percent(F.col("validated"), F.col("total")))


def apply_links(jobs: DataFrame, links: DataFrame) -> DataFrame:
    """Jobs with every found address written."""
    found = links.filter(F.col("found_url").isNotNull()).select("id", F.col("found_url").alias("company_url"))
    return update_by_key(jobs, found, "id", "company_url")


def enrich(jobs: DataFrame, enrichment: DataFrame, sizes: DataFrame) -> DataFrame:
    """Enrichment table after adding the companies it lacks.

    The newest stored address gives the slug; ``sizes`` is (company, employee_size).
    """
    todo = companies_to_enrich(jobs, enrichment).select("company")
    urls = latest_url(jobs).select(F.col("company").alias("_u"), "company_url")
    found = sizes.groupBy(F.col("company").alias("_s")).agg(F.max("employee_size").alias("employee_size"))
    fresh = todo.join(urls, F.col("company") == F.col("_u"), "left").join(
        found, F.col("company") == F.col("_s"), "left"
    ).select(
        F.col("company").alias("company_name"), "employee_size",
        company_slug(company_url(F.col("company_url"))).alias("linkedin_slug"),
        F.lit("enriched").alias("source"),
    )
    return upsert(enrichment, fresh, "company_name", ["linkedin_slug", "source"], ["employee_size"])


def clean_sizes(jobs: DataFrame) -> Column:
    """Stored size, or NULL when it is not a known label."""
    return F.when(F.col("employee_size").isin(*VALID_SIZES), F.col("employee_size"))
