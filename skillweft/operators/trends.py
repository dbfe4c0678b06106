"""Monthly series, month spines and period comparison."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from skillweft.operators.facets import Facets, filter_rows, select_jobs
from skillweft.operators.ordering import top_per_group
from skillweft.operators.rankings import jobs_for, of_types


def month_key(column: str = "posted_date") -> Column:
    return F.date_format(column, "yyyy-MM")


def month_label(column: Column) -> Column:
    """'1997-03' -> 'Mar 1997'."""
    return F.date_format(F.to_date(column, "yyyy-MM"), "MMM yyyy")


def monthly_skill_counts(t, facets: Facets, by: tuple[str, ...] = ("name", "skill_type")) -> DataFrame:
    """(month, ``by``..., cnt) over the selected, dated jobs.

    The bridge meets the jobs on job_id and is reduced to one row per month and
    skill id before the skill dimension is joined.
    """
    jobs = select_jobs(jobs_for(t, facets), t.job_analysis, facets).filter(F.col("posted_date").isNotNull())
    dated = jobs.select(F.col("id").alias("job_id"), month_key().alias("month"))
    per_id = t.job_skills.join(dated, "job_id").groupBy("month", "skill_id").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    skills = of_types(t.skills, facets.skill_types).withColumnRenamed("id", "skill_id")
    return per_id.join(skills, "skill_id").groupBy("month", *by).agg(F.sum("cnt").alias("cnt"))


def year_and_month(df: DataFrame) -> DataFrame:
    return df.select(
        F.substring("month", 1, 4).cast("int").alias("year"),
        F.substring("month", 6, 2).cast("int").alias("month_num"),
        "*",
    )


def timeline(t, facets: Facets, types: tuple[str, ...], months: int = 12) -> DataFrame:
    """One row per month with a column per type and a total, for the last ``months`` months."""
    counts = monthly_skill_counts(t, facets, ("skill_type",))
    wide = counts.groupBy("month").agg(
        *[F.coalesce(F.sum(F.when(F.col("skill_type") == k, F.col("cnt"))), F.lit(0)).cast("bigint").alias(k)
          for k in types],
        F.sum("cnt").alias("total"),
    )
    return wide.orderBy(F.desc("month")).limit(months)


def last_periods(df: DataFrame, period: str, n: int) -> DataFrame:
    """Rows of the last ``n`` distinct periods: the cut-off is a one-row subquery."""
    cut = (
        df.select(period).filter(F.col(period).isNotNull()).distinct()
        .orderBy(F.desc(period)).limit(n).agg(F.min(period).alias("low")).scalar()
    )
    return df.filter(F.col(period) >= cut)


def job_totals_per_month(jobs: DataFrame) -> DataFrame:
    return (
        jobs.filter(F.col("posted_date").isNotNull())
        .groupBy(month_key().alias("month")).agg(F.count_distinct("id").alias("total_jobs"))
    )


def top_per_month(t, facets: Facets, n: int | None = 5) -> DataFrame:
    """Best skills of every month with the month's job total; all of them when ``n`` is None."""
    counts = monthly_skill_counts(t, facets, ("skill_id", "name", "skill_type"))
    ranked = top_per_group(
        counts, ["month"], [F.desc("cnt"), F.asc("name"), F.asc("skill_id")], n
    )
    typeless = Facets(**{**facets.__dict__, "skill_types": ()})
    totals = job_totals_per_month(select_jobs(jobs_for(t, typeless), t.job_analysis, typeless))
    return totals.join(ranked, "month", "left")


def nest_months(ranked: DataFrame) -> DataFrame:
    """One row per month with its skills as a list; for rankings with a limit."""
    entry = F.struct("rank", "name", "skill_type", "cnt")
    return ranked.groupBy("month", "total_jobs").agg(
        F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), entry))).alias("skills")
    )


def skill_series(t, name: str, facets: Facets) -> DataFrame:
    """Months in which one skill (lowest id with that name) was asked for."""
    seed = t.skills.filter(F.col("name") == name).agg(F.min("id").alias("id")).scalar()
    jobs = select_jobs(jobs_for(t, facets), t.job_analysis, facets).filter(F.col("posted_date").isNotNull())
    hits = t.job_skills.filter(F.col("skill_id") == seed)
    dated = jobs.select(F.col("id").alias("job_id"), month_key().alias("month"))
    return dated.join(hits, "job_id").groupBy("month").agg(F.count(F.lit(1)).alias("cnt"))


def month_spine(
    series: DataFrame, key: str, continuous: bool = True, year: int | None = None,
    today: dt.date | None = None,
) -> DataFrame:
    """Twelve months ending at the last observed one, for every key, gaps filled.

    Gaps are 0 when ``continuous``, else NULL and keys without any positive month
    are dropped.  With ``year`` the months run from January to December, or to
    the current month of a running year.
    """
    if year is None:
        # without observations the months end at the current one
        last = F.coalesce(F.max("month"), F.date_format(F.lit(today or dt.date.today()), "yyyy-MM"))
        end = F.to_date(series.agg(last.alias("m")).scalar(), "yyyy-MM")
        start = F.add_months(end, -11)
    else:
        today = today or dt.date.today()
        start = F.lit(dt.date(year, 1, 1))
        end = F.lit(dt.date(year, today.month if year >= today.year else 12, 1))
    months = F.sequence(start, end, F.expr("INTERVAL 1 MONTH"))
    grid = series.select(key).distinct().select(key, F.explode(months).alias("day")).select(
        key, month_key("day").alias("month")
    )
    filled = grid.join(series.select(key, "month", "cnt"), [key, "month"], "left")
    if continuous:
        return filled.withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("bigint")))
    seen = filled.filter(F.col("cnt") > 0).select(key).distinct()
    return filled.withColumn("cnt", F.when(F.col("cnt") > 0, F.col("cnt"))).join(seen, key, "left_semi")


def trend_card(series: DataFrame, key: str) -> DataFrame:
    """Per key: mean, sum, max, first and last value, direction and change over time."""
    first, last = F.min_by("cnt", "month"), F.max_by("cnt", "month")
    card = series.groupBy(key).agg(
        F.count(F.lit(1)).alias("months"),
        F.round(F.avg("cnt"), 1).alias("mean_cnt"),
        F.sum("cnt").alias("sum_cnt"),
        F.max("cnt").alias("max_cnt"),
        first.alias("first_cnt"),
        last.alias("last_cnt"),
    )
    enough = F.col("months") >= 2
    return card.withColumn(
        "direction",
        F.when(enough, F.when(F.col("last_cnt") > F.col("first_cnt"), "up").otherwise("down")),
    ).withColumn("change", F.when(enough, F.abs(F.col("last_cnt") - F.col("first_cnt"))))


def with_first_last(series: DataFrame, key: str) -> DataFrame:
    """First and last value of the whole series on every row."""
    whole = Window.partitionBy(key).orderBy("month").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return series.withColumn("first_cnt", F.first("cnt").over(whole)).withColumn(
        "last_cnt", F.last("cnt").over(whole)
    )


def compare_periods(before: DataFrame, after: DataFrame, key: str = "name") -> DataFrame:
    """Two rankings side by side, matched without case: TETAP (kept), NEW or OUT."""
    left = before.select(F.lower(key).alias("k"), F.col(key).alias("name_before"), F.col("cnt").alias("cnt_before"))
    right = after.select(F.lower(key).alias("k"), F.col(key).alias("name_after"), F.col("cnt").alias("cnt_after"))
    status = (
        F.when(F.col("name_before").isNull(), "NEW")
        .when(F.col("name_after").isNull(), "OUT")
        .otherwise("TETAP")
    )
    return left.join(right, "k", "full_outer").withColumn("status", status).drop("k")


def period_counts(t, facets: Facets) -> DataFrame:
    """Skill names with counts for one period."""
    jobs = filter_rows(t.postings, facets).select(F.col("id").alias("job_id"))
    per_id = t.job_skills.join(jobs, "job_id", "left_semi").groupBy("skill_id").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    skills = t.skills.select(F.col("id").alias("skill_id"), "name")
    return per_id.join(skills, "skill_id").groupBy("name").agg(F.sum("cnt").alias("cnt"))
