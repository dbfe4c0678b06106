"""Counting and ranking over the fact - bridge - dimension model.

``links`` is the (job_id, skill_id) bridge with unique pairs.  Counts are taken
per skill id before the dimension is joined, so a skill that holds a large part
of the bridge is reduced to one row per task before anything is shuffled on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skillweft.operators.facets import Facets, present, select_jobs, select_links
from skillweft.operators.ordering import (
    first_number, number_all, percent, ranked_top_n, top_n, top_per_group,
)


def total_of(df: DataFrame) -> Column:
    """Number of rows as an uncorrelated scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def jobs_for(t, facets: Facets) -> DataFrame:
    """The narrowest job table the facets need: ``postings`` if it has their columns, else ``jobs``."""
    narrow = getattr(t, "postings", None)
    needed = {
        "company": facets.companies, "employee_size": facets.sizes, "keyword": facets.keywords,
    }
    fits = narrow is not None and all(c in narrow.columns for c, values in needed.items() if values)
    return narrow if fits else t.jobs


def of_types(skills: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return skills.filter(F.col("skill_type").isin(*types)) if types else skills


def skill_counts(
    links: DataFrame, jobs: DataFrame, analysis: DataFrame, skills: DataFrame,
    facets: Facets = Facets(),
) -> DataFrame:
    """(skill_id, name, normalized_name, skill_type, cnt) for skills used by the selected jobs.

    Bridge rows are unique per job, so ``cnt`` is also the number of distinct jobs
    unless ``fanout`` multiplies them.
    """
    per_skill = (
        select_links(links, jobs, analysis, facets)
        .groupBy("skill_id").agg(F.count(F.lit(1)).alias("cnt"))
    )
    named = of_types(skills, facets.skill_types).select(
        F.col("id").alias("skill_id"), "name", "normalized_name", "skill_type"
    )
    return per_skill.join(named, "skill_id")


def top_skills(t, facets: Facets, n: int = 20) -> DataFrame:
    counts = skill_counts(t.job_skills, jobs_for(t, facets), t.job_analysis, t.skills, facets)
    order = [F.desc("cnt"), F.asc("skill_id")]
    return top_n(counts, order, n).select("skill_id", "name", "skill_type", "cnt")


def top_skills_ranked(t, facets: Facets, n: int = 20) -> DataFrame:
    """Grouped by (name, type); percentages are shares of the rows shown."""
    counts = skill_counts(t.job_skills, jobs_for(t, facets), t.job_analysis, t.skills, facets)
    grouped = counts.groupBy("name", "skill_type").agg(F.sum("cnt").alias("cnt"))
    shown = ranked_top_n(grouped, [F.desc("cnt"), F.asc("name"), F.asc("skill_type")], n)
    return shown.withColumn(
        "percentage", percent(F.col("cnt"), F.sum("cnt").over(Window.partitionBy()))
    )


def top_of_type_multi(t, facets: Facets, n: int = 10) -> DataFrame:
    """One skill type, several values per facet: ordered by distinct jobs, shows link counts."""
    links = select_links(t.job_skills, jobs_for(t, facets), t.job_analysis, facets)
    named = of_types(t.skills, facets.skill_types).select(F.col("id").alias("skill_id"), "name")
    counts = (
        # per (name, job) first: a name shared by many ids never meets its jobs in one task
        links.join(named, "skill_id")
        .groupBy("name", "job_id").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("name").agg(F.sum("rows").alias("cnt"), F.count(F.lit(1)).alias("jobs"))
    )
    total = total_of(select_jobs(jobs_for(t, facets), t.job_analysis, facets))
    shown = ranked_top_n(counts, [F.desc("jobs"), F.asc("name")], n)
    return shown.withColumn("total_jobs", total).withColumn(
        "percentage", percent(F.col("cnt"), F.col("total_jobs"))
    )


def top_by_type(t, facets: Facets, n: int | None = 10) -> DataFrame:
    """Skills of one type with the share of the selected jobs; all of them when ``n`` is None."""
    counts = skill_counts(t.job_skills, jobs_for(t, facets), t.job_analysis, t.skills, facets)
    total = total_of(select_jobs(jobs_for(t, facets), t.job_analysis, facets))
    order = [F.desc("job_count"), F.asc("skill_name"), F.asc("skill_id")]
    rows = counts.select(
        "skill_id", F.col("name").alias("skill_name"), "skill_type", F.col("cnt").alias("job_count")
    )
    ranked = number_all(rows, order, "rank") if n is None else ranked_top_n(rows, order, n)
    return ranked.withColumn("total_jobs", total).withColumn(
        "percentage", percent(F.col("job_count"), F.col("total_jobs"))
    )


def by_category(t, facets: Facets) -> DataFrame:
    counts = skill_counts(t.job_skills, jobs_for(t, facets), t.job_analysis, t.skills, facets)
    return counts.groupBy("skill_type").agg(F.sum("cnt").alias("cnt"))


def distribution(t, facets: Facets, types: tuple[str, ...], n: int = 5) -> DataFrame:
    """Per requested type: total, share of the requested types and its top-n names as a list."""
    chosen = Facets(**{**facets.__dict__, "skill_types": types})
    counts = skill_counts(t.job_skills, jobs_for(t, chosen), t.job_analysis, t.skills, chosen)
    by_name = counts.groupBy("skill_type", "name").agg(F.sum("cnt").alias("cnt"))
    totals = counts.groupBy("skill_type").agg(F.sum("cnt").alias("total"))
    return nested_top(by_name, totals, t.skill_types, types, n)


def nested_top(
    by_name: DataFrame, totals: DataFrame, skill_types: DataFrame, types: tuple[str, ...], n: int
) -> DataFrame:
    """(skill_type, total, percentage, top_skills[rank, name, cnt]); missing types show zero."""
    best = top_per_group(by_name, ["skill_type"], [F.desc("cnt"), F.asc("name")], n)
    lists = best.groupBy("skill_type").agg(
        F.array_sort(F.collect_list(F.struct("rank", "name", "cnt"))).alias("top_skills")
    )
    wanted = skill_types.filter(F.col("name").isin(*types)).select(F.col("name").alias("skill_type"))
    rows = (
        wanted.join(totals, "skill_type", "left").join(lists, "skill_type", "left")
        .withColumn("total", F.coalesce("total", F.lit(0).cast("bigint")))
    )
    everything = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).scalar()
    return rows.select(
        "skill_type", "total", percent(F.col("total"), everything).alias("percentage"), "top_skills"
    )


def flatten_top(nested: DataFrame) -> DataFrame:
    """One row per list entry; types without entries keep one row."""
    return nested.select("skill_type", "total", "percentage", F.explode_outer("top_skills").alias("s")) \
        .select("skill_type", "total", "percentage", "s.rank", "s.name", "s.cnt")


def jobs_by_location(t, facets: Facets, n: int = 10, column: str = "location") -> DataFrame:
    """Postings per raw location (NULL is a group of its own), shares of the rows shown."""
    counts = (
        select_jobs(t.jobs, t.job_analysis, facets)
        .groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))
    )
    shown = top_n(counts, [F.desc("cnt"), F.asc_nulls_first(column)], n)
    return shown.withColumn(
        "percentage", percent(F.col("cnt"), F.sum("cnt").over(Window.partitionBy()))
    )


def skill_by_normalized_name(skills: DataFrame, name: str) -> DataFrame:
    """Lowest id among the skills with that normalised name (case-insensitive)."""
    hit = skills.filter(F.lower("normalized_name") == name.strip().lower())
    return hit.agg(F.min("id").alias("skill_id")).filter(F.col("skill_id").isNotNull())


def top_companies(
    t, skill: str, facets: Facets, n: int = 5, by: tuple[str, ...] = ("company", "company_url")
) -> DataFrame:
    """Companies that ask for one skill; share of all jobs with that skill."""
    seed = skill_by_normalized_name(t.skills, skill).scalar()
    holders = select_links(
        t.job_skills.filter(F.col("skill_id") == seed), jobs_for(t, facets), t.job_analysis, facets
    ).select("job_id")
    rows = t.jobs.join(holders, F.col("id") == F.col("job_id"), "left_semi")
    counts = rows.filter(present("company")).groupBy(*by).agg(F.count(F.lit(1)).alias("job_count"))
    total = total_of(holders)
    order = [F.desc("job_count"), *[F.asc_nulls_first(c) for c in by]]
    return ranked_top_n(counts, order, n).withColumn(
        "percentage", percent(F.col("job_count"), total)
    )


def overall_numbers(t) -> DataFrame:
    """Totals of the model in one row."""
    return t.spark.range(1).select(
        total_of(t.postings).alias("total_jobs"),
        total_of(t.job_skills).alias("total_skills"),
        total_of(t.skills).alias("unique_skills"),
        t.job_skills.agg(F.count_distinct("job_id").alias("n")).scalar().alias("processed_jobs"),
    )


def counts_with_zeros(
    left: DataFrame, right: DataFrame, key: str, right_key: str, name: str = "cnt"
) -> DataFrame:
    """Rows of ``left`` with the number of matching rows of ``right``, zeros kept."""
    per_key = right.groupBy(F.col(right_key).alias("_k")).agg(F.count(F.lit(1)).alias(name))
    return left.join(per_key, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(
        name, F.coalesce(name, F.lit(0).cast("bigint"))
    )


def value_counts(
    df: DataFrame, column: str, *sentinels: str, drop_blank: bool = True
) -> DataFrame:
    rows = df.filter(present(column, *sentinels)) if drop_blank else df
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))


def size_counts(jobs: DataFrame) -> DataFrame:
    """Company sizes with counts and their natural sort key."""
    counts = value_counts(jobs, "employee_size")
    return counts.withColumn("sort_key", first_number("employee_size"))


def skills_by_frequency(t) -> DataFrame:
    """All skill names, most frequent first, with their position."""
    counts = skill_counts(t.job_skills, t.jobs, t.job_analysis, t.skills)
    names = counts.groupBy("name").agg(F.sum("cnt").alias("cnt"))
    return number_all(names, [F.desc("cnt"), F.asc("name")], "position")


def suggest(t, text: str, n: int = 8) -> DataFrame:
    """Autocomplete: names that contain the text, most frequent first."""
    counts = skill_counts(t.job_skills, t.jobs, t.job_analysis, t.skills)
    hits = counts.filter(F.contains(F.lower("name"), F.lit(text.strip().lower())))
    names = hits.groupBy("name").agg(F.sum("cnt").alias("cnt"))
    return top_n(names, [F.desc("cnt"), F.asc("name")], n)


def skill_page(t, skip: int, limit: int, skill_type: str | None = None) -> DataFrame:
    """One page of the skill list with the number of jobs per listed skill."""
    listed = of_types(t.skills, (skill_type,) if skill_type else ()) \
        .orderBy("id").offset(skip).limit(limit)
    wanted = listed.select(F.col("id").alias("skill_id"))
    per_skill = (
        t.job_skills.join(wanted, "skill_id", "left_semi")
        .groupBy("skill_id").agg(F.count(F.lit(1)).alias("job_count"))
    )
    return listed.join(per_skill, F.col("id") == F.col("skill_id"), "left").select(
        "id", "name", "normalized_name", "skill_type",
        F.coalesce("job_count", F.lit(0).cast("bigint")).alias("job_count"),
    )


def keyword_overview(jobs: DataFrame, links: DataFrame, keywords: DataFrame) -> DataFrame:
    """Per keyword: jobs, finished jobs (status or has a skill), rate and the newest job."""
    linked = links.select("job_id").distinct()
    done = (
        jobs.join(linked.withColumn("has_skill", F.lit(True)), F.col("id") == F.col("job_id"), "left")
        .withColumn("done", (F.col("status") == "completed") | F.coalesce("has_skill", F.lit(False)))
    )
    newest = F.max_by(F.struct("created_at", "job_title"), F.struct("created_at", "id"))
    per_keyword = done.groupBy(F.col("keyword_id")).agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if("done").alias("completed_jobs"),
        newest.alias("newest"),
    )
    zero = F.lit(0).cast("bigint")
    rows = keywords.select(F.col("id").alias("keyword_id"), "keyword").join(
        per_keyword, "keyword_id", "left"
    ).select(
        "keyword_id", "keyword",
        F.coalesce("total_jobs", zero).alias("total_jobs"),
        F.coalesce("completed_jobs", zero).alias("completed_jobs"),
        F.col("newest.created_at").alias("last_scraped_at"),
        F.col("newest.job_title").alias("latest_job_title"),
    )
    return rows.withColumn(
        "pending_jobs", F.greatest(F.col("total_jobs") - F.col("completed_jobs"), zero)
    ).withColumn("extraction_rate", percent(F.col("completed_jobs"), F.col("total_jobs")))


def overview_totals(overview: DataFrame) -> DataFrame:
    return overview.agg(
        F.count(F.lit(1)).alias("total_keywords"),
        F.sum("total_jobs").alias("total_jobs"),
        F.sum("completed_jobs").alias("total_completed"),
        F.sum("pending_jobs").alias("total_pending"),
    )
