"""Model replies: cleaning and parsing of the returned JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skillweft.functions.text import let, strip

SKILL_LISTS = "STRUCT<tech_stack: ARRAY<STRING>, technical_skill: ARRAY<STRING>, soft_skill: ARRAY<STRING>>"


def json_object(reply: Column) -> Column:
    """Outermost ``{...}`` of a reply without code fences; NULL when there is none."""
    text = strip(reply)
    text = F.regexp_replace(text, r"^```(?:json)?", "")
    text = F.regexp_replace(text, r"```$", "")
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.nullif(found, F.lit(""))


def parse_reply(reply: Column) -> Column:
    """Three lists (missing lists are empty); NULL for a reply that is not valid JSON."""
    # a JSON reader keeps going after an error, so validity is asked for separately
    return let(json_object(reply), lambda text: F.when(
        F.try_parse_json(text).isNotNull(), let(F.from_json(text, SKILL_LISTS), fill_lists)
    ))


def fill_lists(skills: Column) -> Column:
    none = F.array().cast("array<string>")
    names = ("tech_stack", "technical_skill", "soft_skill")
    return F.struct(*[F.coalesce(skills[n], none).alias(n) for n in names])


def parse_batch_reply(jobs: DataFrame, replies: DataFrame) -> DataFrame:
    """One reply covers many jobs: look every (batch_id, job_id) up, empty lists where absent.

    ``replies`` has (batch_id, reply) with the reply a JSON object keyed by job id.
    """
    text = json_object(F.col("reply"))
    entries = replies.filter(F.try_parse_json(text).isNotNull()).select(
        "batch_id", F.explode(F.from_json(text, "MAP<STRING, STRING>")).alias("key", "body")
    ).select("batch_id", F.col("key").try_cast("bigint").alias("job_id"), "body")
    parsed = entries.withColumn("skills", F.from_json("body", SKILL_LISTS))
    return jobs.join(parsed.drop("body"), ["batch_id", "job_id"], "left").select(
        *jobs.columns, fill_lists(F.col("skills")).alias("skills")
    )
