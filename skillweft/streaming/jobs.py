"""Ingest, size and extraction steps chained per micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from skillweft.operators.companies import propagate_sizes
from skillweft.operators.ingest import new_postings
from skillweft.operators.resolve import resolve_replies
from skillweft.session import cut_lineage
from skillweft.streaming.feeds import batch_writer, chain, read_before, run_available


#: Letters that a description needs to be worth an extraction.
MINIMUM_DESCRIPTION = 30


def run_ingest_chain(
    pages: DataFrame, keywords: DataFrame, sizes: DataFrame, replies: DataFrame, known: DataFrame,
    variants: DataFrame, path: str, checkpoint: str, today: Column,
) -> StreamingQuery:
    """List pages -> new jobs -> company sizes -> skills, links and analysis rows, one table each below ``path``.

    Skills found by earlier batches count as known, so their ids are used again and new
    ids go on after them.  A batch that is repeated replaces its own rows of every table
    and does not see them as known.

    ``sizes`` is (company, company_url, employee_size), ``replies`` (link, skills, job_description).
    """
    spark = pages.sparkSession
    columns = ["id", "name", "normalized_name", "skill_type"]
    skill_rows = StructType([StructField("id", LongType())] + [StructField(c, StringType()) for c in columns[1:]])

    def ingest(df: DataFrame, batch: int) -> DataFrame:
        links = StructType([StructField("link", StringType())])
        stored = read_before(spark, f"{path}/jobs", links, batch).select("link")
        return cut_lineage(new_postings(df, stored, keywords, today))

    def size(jobs: DataFrame, batch: int) -> DataFrame:
        blank = jobs.withColumn("company_url", F.lit(None).cast("string")).withColumn(
            "employee_size", F.lit(None).cast("string")
        )
        sized = propagate_sizes(blank, sizes)
        batch_writer(f"{path}/jobs")(sized, batch)
        return jobs

    def extract(jobs: DataFrame, batch: int) -> DataFrame:
        # a job with less to read stays in the queue
        worth = replies.filter(F.length("job_description") >= MINIMUM_DESCRIPTION)
        answered = jobs.select("link").join(worth, "link").withColumnRenamed("link", "job_id")
        before = read_before(spark, f"{path}/skills", skill_rows, batch).drop("batch")
        found = resolve_replies(answered, known.select(*columns).unionByName(before), variants)
        batch_writer(f"{path}/skills")(found["new_skills"].select(*columns), batch)
        batch_writer(f"{path}/links")(found["links"], batch)
        analysed = found["lists"].withColumnRenamed("job_id", "link").join(jobs, "link")
        batch_writer(f"{path}/analysis")(analysed, batch)
        return jobs

    return run_available(pages, checkpoint, chain([ingest, size, extract]))
