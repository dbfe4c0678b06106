"""Weighted match of candidates' skills with the skills that a job title asks for.

Many requests are scored in one job.  Demand is counted per job title text and
skill first, so a target that matches many postings only adds up title-level
counts, and every target's demand list is built once for all its candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skillweft.functions.skills import normalize_skill
from skillweft.functions.titles import clean_title
from skillweft.operators.containment import contained_phrases
from skillweft.operators.ordering import percent, top_per_group
from skillweft.operators.resolve import with_canonical
from skillweft.session import cut_lineage


def matching_titles(targets: DataFrame, jobs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(target_id, keyword_id, title): job groups of the first search stage that finds any.

    Stages: title contains the target or its clean form; the first keyword that
    contains the target; title contains a longer word of the clean form.
    ``targets`` is (target_id, title[, employee_size]).
    """
    wanted = targets.filter(F.trim("title") != "").select(
        "target_id", *(["employee_size"] if "employee_size" in targets.columns else []),
        F.trim("title").alias("asked"), clean_title(F.trim("title")).alias("clean"),
    )
    sized = "employee_size" in targets.columns
    group_keys = ["keyword_id", "job_title", *(["employee_size"] if sized else [])]
    # every search stage looks at the same few distinct titles: find them in one pass over the jobs
    groups = cut_lineage(jobs.select(*group_keys).distinct().withColumnRenamed("job_title", "title"))
    if sized:
        groups = groups.withColumnRenamed("employee_size", "size")
    texts = groups.select(F.lower("title").alias("text")).distinct()

    def by_phrase(phrases: DataFrame) -> DataFrame:
        """(target_id, text) for (target_id, phrase)."""
        hits = contained_phrases(texts, phrases)
        return phrases.join(hits, "phrase").select("target_id", "text").distinct()

    whole = wanted.select("target_id", F.explode(F.array_distinct(
        F.array(F.lower("asked"), F.lower("clean")))).alias("phrase")).filter(F.col("phrase") != "")
    words = wanted.select("target_id", F.explode(F.split(F.lower("clean"), " ")).alias("phrase")).filter(
        F.length("phrase") > 2
    )
    keyword_hits = contained_phrases(
        keywords.select(F.lower("keyword").alias("text")),
        wanted.select(F.lower("asked").alias("phrase")),
    )
    first_keyword = (
        wanted.select("target_id", F.lower("asked").alias("phrase")).join(keyword_hits, "phrase")
        .join(keywords.select(F.lower("keyword").alias("text"), "id"), "text")
        .groupBy("target_id").agg(F.min("id").alias("keyword_id"))
    )
    lowered = groups.withColumn("text", F.lower("title"))
    columns = ["target_id", "keyword_id", "title", *(["size"] if sized else [])]
    sizes = wanted.select("target_id", F.col("employee_size").alias("asked_size")) if sized else None

    def of_size(hits: DataFrame) -> DataFrame:
        if sized:
            hits = hits.join(sizes, "target_id").filter(
                F.coalesce("asked_size", F.lit("")).isin("") | (F.col("asked_size") == F.col("size"))
            )
        return hits.select(*columns).distinct()

    def still_open(rows: DataFrame, *hits: DataFrame) -> DataFrame:
        for found in hits:
            rows = rows.join(found.select("target_id").distinct(), "target_id", "left_anti")
        return rows

    # a target that an earlier stage has settled takes no part in the next one
    in_title = cut_lineage(of_size(lowered.join(by_phrase(whole), "text")))
    in_keyword = of_size(lowered.join(still_open(first_keyword, in_title), "keyword_id"))
    by_word = of_size(lowered.join(by_phrase(still_open(words, in_title, in_keyword)), "text"))
    return in_title.unionByName(in_keyword).unionByName(by_word)


def demand(
    targets: DataFrame, jobs: DataFrame, keywords: DataFrame, links: DataFrame, skills: DataFrame,
    per_type: int = 100,
) -> DataFrame:
    """(target_id, total_jobs, norm, name, demand): top skills per type, merged by normalised name.

    A merged skill keeps the largest demand and the shortest name.
    """
    sized = "employee_size" in targets.columns
    keys = ["keyword_id", "title", *(["size"] if sized else [])]
    groups = jobs.select(
        F.col("id").alias("job_id"), "keyword_id", F.col("job_title").alias("title"),
        *([F.col("employee_size").alias("size")] if sized else []),
    )
    # sizes may be NULL: compare them as text with a marker
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("size", F.coalesce("size", F.lit("\0"))) if sized else df

    matched = cut_lineage(keyed(matching_titles(targets, jobs, keywords)))
    job_counts = keyed(groups).groupBy(*keys).agg(F.count(F.lit(1)).alias("jobs"))
    totals = matched.join(job_counts, keys).groupBy("target_id").agg(F.sum("jobs").alias("total_jobs"))
    used = matched.select(*keys).distinct()
    per_title = (
        links.join(keyed(groups).join(used, keys, "left_semi"), "job_id")
        .groupBy(*keys, "skill_id").agg(F.count(F.lit(1)).alias("cnt"))
    )
    per_target = matched.join(per_title, keys).groupBy("target_id", "skill_id").agg(F.sum("cnt").alias("demand"))
    named = per_target.join(
        skills.select(F.col("id").alias("skill_id"), "name", "normalized_name", "skill_type"), "skill_id"
    )
    if "skill_type" in targets.columns:
        asked = targets.select("target_id", F.col("skill_type").alias("asked_type"))
        named = named.join(asked, "target_id").filter(
            F.coalesce("asked_type", F.lit("all")).isin("all", "") | (F.col("asked_type") == F.col("skill_type"))
        )
    best = top_per_group(
        named, ["target_id", "skill_type"], [F.desc("demand"), F.asc("name"), F.asc("skill_id")], per_type
    )
    norm = F.coalesce(F.nullif("normalized_name", F.lit("")), normalize_skill(F.col("name")))
    # at most three lists of ``per_type`` skills per target, used by scores and details
    merged = best.withColumn("norm", norm).filter(F.col("norm") != "").groupBy("target_id", "norm").agg(
        F.max("demand").alias("demand"),
        F.min_by("name", F.struct(F.length("name"), F.col("name"))).alias("name"),
    )
    return cut_lineage(merged.join(totals, "target_id"))


def user_norms(user_skills: DataFrame, variants: DataFrame) -> DataFrame:
    """(request_id, norm): canonical key of every skill a candidate lists."""
    listed = user_skills.withColumn("skill", F.trim("skill")).filter(F.col("skill") != "")
    resolved = with_canonical(listed.select("request_id", "skill"), variants, skill_type=None)
    return resolved.select("request_id", normalize_skill(F.col("canonical")).alias("norm")).distinct()


def match_scores(requests: DataFrame, wanted: DataFrame, norms: DataFrame) -> DataFrame:
    """(request_id, target_id, match_score, matched, missing, total_jobs) for requests (request_id, target_id)."""
    totals = wanted.groupBy("target_id").agg(
        F.sum("demand").alias("weight"), F.count(F.lit(1)).alias("skills"), F.first("total_jobs").alias("total_jobs")
    )
    hits = (
        requests.join(norms, "request_id").join(wanted.select("target_id", "norm", "demand"), ["target_id", "norm"])
        .groupBy("request_id").agg(F.sum("demand").alias("hit"), F.count(F.lit(1)).alias("matched"))
    )
    zero = F.lit(0).cast("bigint")
    rows = requests.join(totals, "target_id", "left").join(hits, "request_id", "left")
    matched = F.coalesce("matched", zero)
    return rows.select(
        "request_id", "target_id",
        F.when(F.col("weight") > 0, F.round(F.lit(100.0) * F.coalesce("hit", zero) / F.col("weight")))
        .otherwise(0.0).alias("match_score"),
        matched.alias("matched"),
        (F.coalesce("skills", zero) - matched).alias("missing"),
        F.coalesce("total_jobs", zero).alias("total_jobs"),
    )


def match_details(requests: DataFrame, wanted: DataFrame, norms: DataFrame) -> DataFrame:
    """Every wanted skill of every request with its shares and whether the candidate has it.

    A request gets at most three lists of ``per_type`` skills.
    """
    weights = wanted.groupBy("target_id").agg(F.sum("demand").alias("weight"))
    lists = wanted.join(weights, "target_id").groupBy("target_id").agg(F.collect_list(F.struct(
        "norm", "name", "demand",
        percent(F.col("demand"), F.col("total_jobs")).alias("demand_pct"),
        percent(F.col("demand"), F.col("weight")).alias("contribution"),
    )).alias("listed"))
    # requests meet their skills before the lists are spread out, so no listed row is shuffled
    asked = requests.select("request_id", "target_id").distinct()
    have = norms.join(asked, "request_id").join(wanted.select("target_id", "norm"), ["target_id", "norm"], "left_semi").groupBy(
        "request_id", "target_id").agg(F.collect_set("norm").alias("has"))
    rows = requests.join(have, ["request_id", "target_id"], "left").join(lists, "target_id")
    return rows.withColumn("l", F.explode("listed")).drop("listed").select(
        *[c for c in requests.columns], "l.*", F.coalesce(F.array_contains("has", F.col("l.norm")), F.lit(False)).alias("matched"))
