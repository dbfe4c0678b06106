"""The job-posting tables with their schemas, for data that already has this shape."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMAS = {
    "keywords": "id INT, keyword STRING, created_at TIMESTAMP_NTZ",
    "jobs": (
        "id INT, keyword_id INT, job_title STRING, company STRING, location STRING, posted_date DATE, source STRING, "
        "link STRING, job_description STRING, status_ekstraksi STRING, created_at TIMESTAMP_NTZ, "
        "company_linkedin_url STRING, employee_size STRING"
    ),
    "skill_types": "id INT, name STRING, description STRING, created_at TIMESTAMP_NTZ",
    "skills": "id INT, skill_type_id INT, name STRING, normalized_name STRING, created_at TIMESTAMP_NTZ",
    "job_skills": "id INT, job_id INT, skill_id INT, created_at TIMESTAMP_NTZ",
    "job_analysis": (
        "id INT, job_id INT, job_title STRING, company STRING, location STRING, posted_date DATE, link STRING, "
        "job_description STRING, keyword STRING, tech_stack STRING, technical_skill STRING, soft_skill STRING, "
        "extracted_at TIMESTAMP_NTZ, ai_model STRING"
    ),
    "company_enrichment": (
        "id INT, company_name STRING, company_linkedin_url STRING, employee_size STRING, linkedin_slug STRING, "
        "source STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
}


class Tables:
    """Model tables under the names the operators use; pass it wherever they take ``t``.

    Skills carry their type's name, jobs their keyword's text.
    """

    def __init__(self, spark: SparkSession, read):
        """``read(name)`` returns a raw table."""
        self.spark = spark
        self._read = read

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str) -> Tables:
        """One parquet table per name below the folder, read with its declared schema."""
        return cls(spark, lambda name: spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}"))

    @cached_property
    def keywords(self) -> DataFrame:
        return self._read("keywords")

    @cached_property
    def skill_types(self) -> DataFrame:
        return self._read("skill_types").select("id", "name", "description")

    @cached_property
    def postings(self) -> DataFrame:
        """Job columns without the keyword text."""
        return self._read("jobs").withColumnsRenamed(
            {"status_ekstraksi": "status", "company_linkedin_url": "company_url"}
        )

    @cached_property
    def jobs(self) -> DataFrame:
        words = self.keywords.select(F.col("id").alias("keyword_id"), "keyword")
        return self.postings.join(words, "keyword_id", "left")

    @cached_property
    def skills(self) -> DataFrame:
        kinds = self.skill_types.select(F.col("id").alias("skill_type_id"), F.col("name").alias("skill_type"))
        return self._read("skills").join(kinds, "skill_type_id")

    @cached_property
    def job_skills(self) -> DataFrame:
        return self._read("job_skills").select("job_id", "skill_id")

    @cached_property
    def job_analysis(self) -> DataFrame:
        """Analysed rows; the company size comes from the job."""
        sizes = self.postings.select(F.col("id").alias("job_id"), "employee_size")
        return self._read("job_analysis").join(sizes, "job_id", "left")

    @cached_property
    def company_enrichment(self) -> DataFrame:
        return self._read("company_enrichment")
