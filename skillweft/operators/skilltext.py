"""Rankings straight from the delimited skill columns of the wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skillweft.functions.skills import parse_skill_text
from skillweft.functions.text import strip
from skillweft.operators.facets import Facets, filter_rows
from skillweft.operators.ordering import percent, ranked_top_n
from skillweft.operators.rankings import flatten_top, nested_top

COLUMNS = ("tech_stack", "technical_skill", "soft_skill")


def chosen_rows(analysis: DataFrame, facets: Facets) -> DataFrame:
    rows = filter_rows(analysis, facets)
    return rows.filter(F.col("location").isin(*facets.locations)) if facets.locations else rows


def top_tokens(analysis: DataFrame, column: str, facets: Facets, n: int = 20) -> DataFrame:
    """Entries of one column, JSON list or a single text; share of the selected rows."""
    rows = chosen_rows(analysis, facets)
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    tokens = rows.filter(F.col(column) != "").select(
        F.explode(parse_skill_text(F.col(column), scalar=True)).alias("token")
    ).select(strip(F.col("token")).alias("token")).filter(F.col("token") != "")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
    shown = ranked_top_n(counts, [F.desc("cnt"), F.asc("token")], n)
    return shown.withColumn("total_jobs", total).withColumn(
        "percentage", percent(F.col("cnt"), F.col("total_jobs"))
    )


def token_counts(
    analysis: DataFrame, facets: Facets, columns: tuple[str, ...] = COLUMNS, min_len: int = 2
) -> DataFrame:
    """(skill_type, name, cnt) over all skill columns in one pass; shorter entries are left out."""
    rows = chosen_rows(analysis, facets)
    parts = F.explode(F.array(*[
        F.struct(F.lit(c).alias("skill_type"), F.col(c).alias("text")) for c in columns
    ]))
    tokens = rows.select(parts.alias("p")).filter(F.col("p.text") != "").select(
        "p.skill_type", F.explode(parse_skill_text(F.col("p.text"))).alias("name")
    ).filter(F.length("name") >= min_len)
    return tokens.groupBy("skill_type", "name").agg(F.count(F.lit(1)).alias("cnt"))


def token_distribution(
    analysis: DataFrame, skill_types: DataFrame, facets: Facets, n: int = 10
) -> DataFrame:
    """Per column: total, share of all entries and its top-n entries (flat); empty columns are absent."""
    counts = token_counts(analysis, facets)
    totals = counts.groupBy("skill_type").agg(F.sum("cnt").alias("total"))
    nested = nested_top(counts, totals, skill_types, COLUMNS, n)
    return flatten_top(nested.filter(F.col("total") > 0))


def token_ranking(analysis: DataFrame, skill_type: str, facets: Facets, n: int = 10) -> DataFrame:
    """Top entries of one column; share of that column's entries."""
    counts = token_counts(analysis, facets, (skill_type,)).select("name", "cnt")
    total = counts.agg(F.sum("cnt").alias("n")).scalar()
    shown = ranked_top_n(counts, [F.desc("cnt"), F.asc("name")], n)
    return shown.withColumn("percentage", percent(F.col("cnt"), total))
