"""Skill co-occurrence around one skill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skillweft.operators.facets import Facets, select_links
from skillweft.operators.lookups import exact_else_contains
from skillweft.operators.ordering import top_n
from skillweft.operators.rankings import jobs_for


def seed_skill(skills: DataFrame, text: str) -> DataFrame:
    """One row at most: the skill meant by the text."""
    same_norm = F.col("normalized_name") == text.strip().lower()
    return exact_else_contains(skills, "name", text, same_norm)


def neighbours(t, text: str, facets: Facets, n: int = 20, exclude_by: str = "id") -> DataFrame:
    """(source, target, weight): skills in the jobs of the seed skill.

    The seed is filtered first, its jobs semi-join the bridge, and weights are
    counted per skill id before names are attached: no pairs are formed.
    """
    seed = seed_skill(t.skills, text)
    seed_id, seed_name = seed.select("id").scalar(), seed.select("name").scalar()
    holders = select_links(
        t.job_skills.filter(F.col("skill_id") == seed_id), jobs_for(t, facets), t.job_analysis, facets
    ).select("job_id")
    weights = (
        t.job_skills.join(holders, "job_id", "left_semi")
        .filter(F.col("skill_id") != seed_id)
        .groupBy("skill_id").agg(F.count(F.lit(1)).alias("weight"))
    )
    names = t.skills.select(F.col("id").alias("skill_id"), F.col("name").alias("target"))
    grouped = weights.join(names, "skill_id").groupBy("target").agg(F.sum("weight").alias("weight"))
    if exclude_by == "name":
        grouped = grouped.filter(F.lower("target") != F.lower(seed_name))
    best = top_n(grouped, [F.desc("weight"), F.asc("target")], n)
    return best.select(seed_name.alias("source"), "target", "weight")


def node_frequencies(t, text: str, links: DataFrame, facets: Facets) -> DataFrame:
    """(id, frequency) for the seed and its neighbours within the same facets.

    A text that matches no skill yields itself with frequency 0.
    """
    seed = seed_skill(t.skills, text).select("name")
    label = F.coalesce(seed.scalar(), F.lit(text.strip()))
    names = (
        t.spark.range(1).select(label.alias("name"))
        .union(links.select(F.col("target").alias("name"))).distinct()
    )
    ids = t.skills.join(names, "name", "left_semi").select(F.col("id").alias("skill_id"), "name")
    wanted = t.job_skills.join(ids, "skill_id", "left_semi")
    counts = (
        select_links(wanted, jobs_for(t, facets), t.job_analysis, facets)
        .groupBy("skill_id").agg(F.count(F.lit(1)).alias("cnt"))
        .join(ids, "skill_id").groupBy("name").agg(F.sum("cnt").alias("cnt"))
    )
    return names.join(counts, "name", "left").select(
        F.col("name").alias("id"), F.coalesce("cnt", F.lit(0).cast("bigint")).alias("frequency")
    )


def neighbour_set(links: DataFrame, node: str | Column) -> DataFrame:
    """Names linked to a node in either direction."""
    outgoing = links.filter(F.col("source") == node).select(F.col("target").alias("name"))
    incoming = links.filter(F.col("target") == node).select(F.col("source").alias("name"))
    return outgoing.union(incoming).distinct()
