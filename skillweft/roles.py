"""Binds the star-schema test tables to the roles the operators work on.

Every role is a lazy DataFrame over whole tables, and ``SQL`` holds the same
definition for the SQL counterparts.  A user with real tables builds ``Roles``
from them instead.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from skillweft.dictionaries import SKILL_TYPES
from skillweft.sources.readers import read_table, spread_scan

SQL = {
    "skill_types": """
        SELECT * FROM (VALUES (1, 'tech_stack', 'Tech Stack'), (2, 'technical_skill', 'Technical Skill'),
                              (3, 'soft_skill', 'Soft Skill')) AS t(id, name, description)""",
    "keywords": """
        SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INT) AS id, o_orderpriority AS keyword
        FROM orders""",
    "postings": """
        SELECT o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS keyword_id,
               o_orderpriority AS keyword, o_custkey AS company_id, o_orderdate AS posted_date,
               o_orderdate AS created_at,
               CASE o_orderkey % 6
                    WHEN 0 THEN 'Senior Data Engineer'
                    WHEN 1 THEN 'Data Analyst (Remote)'
                    WHEN 2 THEN 'Junior Machine Learning Engineer - Contract'
                    WHEN 3 THEN 'Backend Developer'
                    WHEN 4 THEN 'Lead AI  Engineer [Bandung]'
                    ELSE 'Sales Data Specialist, Remote' END AS job_title,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending'
                    ELSE 'in_progress' END AS status,
               'https://www.linkedin.com/jobs/view/' || CAST(o_orderkey AS VARCHAR) || '/' AS link
        FROM orders""",
    "companies": """
        SELECT c_custkey AS company_id,
               CASE WHEN c_custkey % 50 = 0 THEN '' WHEN c_custkey % 50 = 1 THEN 'N/A'
                    WHEN c_custkey % 50 = 2 THEN NULL ELSE replace(c_name, '#', ' ') END AS company,
               CASE WHEN c_custkey % 31 = 0 THEN NULL
                    WHEN c_custkey % 29 = 0 THEN 'Remote'
                    WHEN c_custkey % 5 = 0 THEN 'Kota ' || n_name || ', ' || r_name
                    WHEN c_custkey % 5 = 1 THEN n_name || ', Indonesia (' || CAST(c_nationkey AS VARCHAR) || ')'
                    WHEN c_custkey % 5 = 2 THEN 'Region ' || r_name
                    WHEN c_custkey % 5 = 3 THEN lower(n_name) || ' / hybrid'
                    ELSE n_name END AS location,
               n_name AS city,
               CASE WHEN c_custkey % 3 = 0 THEN NULL
                    WHEN c_custkey % 13 = 0 THEN ''
                    WHEN c_custkey % 23 = 0 THEN 'https://www.linkedin.com/company/acme-group/'
                    ELSE 'https://www.linkedin.com/company/' || lower(replace(c_name, '#', '-')) || '/'
                    END AS company_url,
               CASE WHEN c_custkey % 7 = 0 THEN NULL
                    WHEN c_custkey % 11 = 0 THEN 'unknown'
                    WHEN 2 * abs(c_acctbal) <= 10 THEN '1-10'
                    WHEN 2 * abs(c_acctbal) <= 50 THEN '11-50'
                    WHEN 2 * abs(c_acctbal) <= 200 THEN '51-200'
                    WHEN 2 * abs(c_acctbal) <= 500 THEN '201-500'
                    WHEN 2 * abs(c_acctbal) <= 1000 THEN '501-1000'
                    WHEN 2 * abs(c_acctbal) <= 5000 THEN '1001-5000'
                    WHEN 2 * abs(c_acctbal) <= 10000 THEN '5001-10000'
                    ELSE '10001+' END AS employee_size
        FROM customer JOIN nation ON n_nationkey = c_nationkey
                      JOIN region ON r_regionkey = n_regionkey""",
    "jobs": """
        SELECT p.*, c.company, c.location, c.city, c.company_url, c.employee_size
        FROM postings p JOIN companies c ON c.company_id = p.company_id""",
    "skills": """
        SELECT p_partkey AS id,
               CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name)
                    WHEN 2 THEN replace(p_name, ' ', '-') ELSE replace(p_name, ' ', '/') END AS name,
               lower(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name)
                    WHEN 2 THEN replace(p_name, ' ', '-') ELSE replace(p_name, ' ', '/') END)
                    AS normalized_name,
               CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'tech_stack'
                    WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'technical_skill'
                    ELSE 'soft_skill' END AS skill_type
        FROM part""",
    "job_skills": """
        SELECT DISTINCT l_orderkey AS job_id, l_partkey AS skill_id FROM lineitem""",
    "job_analysis": """
        SELECT 2 * id + extra AS id, id AS job_id, job_title, company, posted_date, keyword,
               employee_size, link,
               CASE WHEN company_id % 17 = 0 THEN '' WHEN company_id % 19 = 0 THEN 'other'
                    ELSE city END AS location,
               CASE WHEN id % 6 = 0 THEN NULL WHEN id % 6 = 1 THEN ''
                    ELSE city || ', ' || status || ', ' || lower(city) END AS tech_stack,
               CASE WHEN id % 6 = 0 THEN NULL WHEN id % 4 = 0 THEN city
                    ELSE '[''' || city || ''', '' ' || status || ' '']' END AS technical_skill,
               CASE WHEN id % 3 = 0 THEN NULL ELSE 'R,' || status || ', size ' || city
                    END AS soft_skill,
               created_at + INTERVAL 1 DAY AS extracted_at
        FROM jobs CROSS JOIN (VALUES (0), (1)) AS v(extra)
        WHERE extra = 0 OR id % 10 = 0""",
    "company_enrichment": """
        SELECT replace(c_name, '#', ' ') AS company_name,
               CASE WHEN c_acctbal < 0 THEN '' ELSE '51-200' END AS employee_size,
               lower(replace(c_name, '#', '-')) AS linkedin_slug, 'seed' AS source
        FROM customer WHERE c_mktsegment = 'MACHINERY'""",
}

_NEEDS = {
    "jobs": ["postings", "companies"],
    "job_analysis": ["postings", "companies", "jobs"],
}


def with_roles(body: str, *roles: str, **extra: str) -> str:
    """Prefix ``body`` with the role definitions it uses, then with ``extra`` steps."""
    names: list[str] = []
    for role in roles:
        for name in [*_NEEDS.get(role, []), role]:
            if name not in names:
                names.append(name)
    steps = [f"{name} AS ({SQL[name]})" for name in names]
    steps += [f"{name} AS ({text})" for name, text in extra.items()]
    return (f"WITH {', '.join(steps)}\n" if steps else "") + body


class Roles:
    """Role tables for one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def texts(self, name: str) -> DataFrame:
        """A table whose rows are costly to work on, in as many parts as there are cores at least."""
        df = self.table(name)
        keys = ["conv_id", "turn"] if name == "conversations" else df.columns[:1]
        return spread_scan(df, *keys)

    @cached_property
    def skill_types(self) -> DataFrame:
        rows = [(i, name, text) for i, (name, text) in enumerate(SKILL_TYPES, 1)]
        return self.spark.createDataFrame(rows, "id INT, name STRING, description STRING")

    @cached_property
    def keywords(self) -> DataFrame:
        return self.postings.select(F.col("keyword_id").alias("id"), "keyword").distinct()

    @cached_property
    def postings(self) -> DataFrame:
        """Job columns that come from the fact table alone (no company join)."""
        key = F.col("o_orderkey")
        titles = [
            "Senior Data Engineer",
            "Data Analyst (Remote)",
            "Junior Machine Learning Engineer - Contract",
            "Backend Developer",
            "Lead AI  Engineer [Bandung]",
            "Sales Data Specialist, Remote",
        ]
        title = F.element_at(F.array(*map(F.lit, titles)), (key % 6 + 1).cast("int"))
        status = (
            F.when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "O", "pending")
            .otherwise("in_progress")
        )
        return self.table("orders").select(
            key.alias("id"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("keyword_id"),
            F.col("o_orderpriority").alias("keyword"),
            F.col("o_custkey").alias("company_id"),
            F.col("o_orderdate").alias("posted_date"),
            F.col("o_orderdate").alias("created_at"),
            title.alias("job_title"),
            status.alias("status"),
            F.concat(F.lit("https://www.linkedin.com/jobs/view/"), key, F.lit("/")).alias("link"),
        )

    @cached_property
    def companies(self) -> DataFrame:
        key = F.col("c_custkey")
        nation, region = F.col("n_name"), F.col("r_name")
        size = 2 * F.abs("c_acctbal")
        slug = F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("-")))
        name = F.replace(F.col("c_name"), F.lit("#"), F.lit(" "))
        customers = self.table("customer").join(
            self.table("nation"), F.col("n_nationkey") == F.col("c_nationkey")
        ).join(self.table("region"), F.col("r_regionkey") == F.col("n_regionkey"))
        return customers.select(
            key.alias("company_id"),
            F.when(key % 50 == 0, "").when(key % 50 == 1, "N/A").when(key % 50 == 2, None)
            .otherwise(name).alias("company"),
            F.when(key % 31 == 0, None)
            .when(key % 29 == 0, "Remote")
            .when(key % 5 == 0, F.concat(F.lit("Kota "), nation, F.lit(", "), region))
            .when(key % 5 == 1, F.concat(nation, F.lit(", Indonesia ("), "c_nationkey", F.lit(")")))
            .when(key % 5 == 2, F.concat(F.lit("Region "), region))
            .when(key % 5 == 3, F.concat(F.lower(nation), F.lit(" / hybrid")))
            .otherwise(nation).alias("location"),
            nation.alias("city"),
            F.when(key % 3 == 0, None).when(key % 13 == 0, "")
            .when(key % 23 == 0, "https://www.linkedin.com/company/acme-group/")
            .otherwise(F.concat(F.lit("https://www.linkedin.com/company/"), slug, F.lit("/")))
            .alias("company_url"),
            F.when(key % 7 == 0, None).when(key % 11 == 0, "unknown")
            .when(size <= 10, "1-10").when(size <= 50, "11-50").when(size <= 200, "51-200")
            .when(size <= 500, "201-500").when(size <= 1000, "501-1000")
            .when(size <= 5000, "1001-5000").when(size <= 10000, "5001-10000")
            .otherwise("10001+").alias("employee_size"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        return self.postings.join(self.companies, "company_id")

    @cached_property
    def skills(self) -> DataFrame:
        key, words = F.col("p_partkey"), F.col("p_name")
        name = (
            F.when(key % 4 == 0, words)
            .when(key % 4 == 1, F.upper(words))
            .when(key % 4 == 2, F.replace(words, F.lit(" "), F.lit("-")))
            .otherwise(F.replace(words, F.lit(" "), F.lit("/")))
        )
        kind = F.col("p_type")
        return self.table("part").select(
            key.alias("id"),
            name.alias("name"),
            F.lower(name).alias("normalized_name"),
            F.when(kind.isin("STANDARD", "ECONOMY"), "tech_stack")
            .when(kind.isin("MEDIUM", "PROMO"), "technical_skill")
            .otherwise("soft_skill").alias("skill_type"),
        )

    @cached_property
    def job_skills(self) -> DataFrame:
        return (
            self.table("lineitem")
            .select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("skill_id"))
            .distinct()
        )

    @cached_property
    def job_analysis(self) -> DataFrame:
        """One wide row per analysed job; every tenth job was analysed twice."""
        copies = F.when(F.col("id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        rows = self.jobs.withColumn("extra", F.explode(copies))
        key, city = F.col("id"), F.col("city")
        return rows.select(
            (2 * key + F.col("extra")).alias("id"),
            key.alias("job_id"),
            "job_title", "company", "posted_date", "keyword", "employee_size", "link",
            F.when(F.col("company_id") % 17 == 0, "").when(F.col("company_id") % 19 == 0, "other")
            .otherwise(city).alias("location"),
            F.when(key % 6 == 0, None).when(key % 6 == 1, "")
            .otherwise(F.concat_ws(", ", city, "status", F.lower(city))).alias("tech_stack"),
            F.when(key % 6 == 0, None).when(key % 4 == 0, city)
            .otherwise(F.concat(F.lit("['"), city, F.lit("', ' "), "status", F.lit(" ']")))
            .alias("technical_skill"),
            F.when(key % 3 == 0, None)
            .otherwise(F.concat(F.lit("R,"), "status", F.lit(", size "), city)).alias("soft_skill"),
            (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("extracted_at"),
        )

    @cached_property
    def company_enrichment(self) -> DataFrame:
        return self.table("customer").filter(F.col("c_mktsegment") == "MACHINERY").select(
            F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")).alias("company_name"),
            F.when(F.col("c_acctbal") < 0, "").otherwise("51-200").alias("employee_size"),
            F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("-"))).alias("linkedin_slug"),
            F.lit("seed").alias("source"),
        )
