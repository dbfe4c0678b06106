"""Rankings, shares and facet counts."""

from pyspark.sql import functions as F

from skillweft.operators import rankings as rk
from skillweft.operators.facets import Facets
from skillweft.plans.registry import query
from skillweft.roles import with_roles

YEAR_1997 = "p.posted_date >= TIMESTAMP '1997-01-01' AND p.posted_date < TIMESTAMP '1998-01-01'"


def _pct(part: str, whole: str) -> str:
    return (f"CASE WHEN {whole} > 0 THEN round(100.0::DOUBLE * {part} / {whole}, 1) "
            "ELSE 0.0::DOUBLE END AS percentage")


@query("top_skills", with_roles("""
    SELECT s.id AS skill_id, s.name, s.skill_type, count(*) AS cnt
    FROM job_skills js JOIN skills s ON s.id = js.skill_id JOIN postings p ON p.id = js.job_id
    GROUP BY ALL ORDER BY cnt DESC, skill_id LIMIT 20""", "postings", "skills", "job_skills"))
def top_skills(t):
    return rk.top_skills(t, Facets(), 20)


@query("top_skills_faceted", with_roles(f"""
    SELECT s.id AS skill_id, s.name, s.skill_type, count(*) AS cnt
    FROM job_skills js JOIN skills s ON s.id = js.skill_id JOIN jobs p ON p.id = js.job_id
    WHERE p.employee_size = '5001-10000' AND s.skill_type = 'tech_stack' AND {YEAR_1997}
      AND p.keyword = '2-HIGH'
      AND p.id IN (SELECT job_id FROM job_analysis WHERE location = 'NATION_7')
    GROUP BY ALL ORDER BY cnt DESC, skill_id LIMIT 20""",
    "jobs", "skills", "job_skills", "job_analysis"))
def top_skills_faceted(t):
    facets = Facets.of(keyword="2-HIGH", employee_size="5001-10000", location="NATION_7",
                       skill_type="tech_stack", year=1997, month=0)
    return rk.top_skills(t, facets, 20)


@query("top_skills_fanout", with_roles("""
    SELECT s.id AS skill_id, s.name, s.skill_type, count(*) AS cnt
    FROM job_skills js JOIN skills s ON s.id = js.skill_id JOIN postings p ON p.id = js.job_id
    JOIN job_analysis a ON a.job_id = p.id
    WHERE a.location = 'NATION_7'
    GROUP BY ALL ORDER BY cnt DESC, skill_id LIMIT 20""",
    "jobs", "skills", "job_skills", "job_analysis"))
def top_skills_fanout(t):
    return rk.top_skills(t, Facets.of(location="NATION_7", fanout=True), 20)


@query("top_skills_ranked", with_roles(f"""
    SELECT row_number() OVER (ORDER BY cnt DESC, name, skill_type) AS rank, name, skill_type, cnt,
           {_pct('cnt', 'sum(cnt) OVER ()')}
    FROM (SELECT s.name, s.skill_type, count(*) AS cnt
          FROM job_skills js JOIN skills s ON s.id = js.skill_id JOIN postings p ON p.id = js.job_id
          WHERE {YEAR_1997} AND month(p.posted_date) = 3
          GROUP BY ALL ORDER BY cnt DESC, name, skill_type LIMIT 20)""",
    "postings", "skills", "job_skills"))
def top_skills_ranked(t):
    return rk.top_skills_ranked(t, Facets.of(year=1997, month=3), 20)


@query("top_multi_select", with_roles(f"""
    SELECT row_number() OVER (ORDER BY jobs DESC, name) AS rank, name, cnt, jobs, total_jobs,
           {_pct('cnt', 'total_jobs')}
    FROM (SELECT s.name, count(*) AS cnt, count(DISTINCT js.job_id) AS jobs,
                 (SELECT count(*) FROM picked) AS total_jobs
          FROM job_skills js JOIN skills s ON s.id = js.skill_id JOIN picked p ON p.id = js.job_id
          WHERE s.skill_type = 'tech_stack'
          GROUP BY s.name ORDER BY jobs DESC, name LIMIT 10)""",
    "jobs", "skills", "job_skills", "job_analysis",
    picked="""SELECT * FROM jobs WHERE keyword_id IN (1, 3) AND month(posted_date) IN (1, 2, 6)
              AND year(posted_date) IN (1996, 1998)
              AND id IN (SELECT job_id FROM job_analysis WHERE location IN ('NATION_3', 'NATION_7',
              'NATION_11'))"""))
def top_multi_select(t):
    facets = Facets.of(keyword_id="1, 3,", location="NATION_3, NATION_7,NATION_11,", month="1,2,6",
                       year="1996,1998", skill_type="tech_stack", multi=True)
    return rk.top_of_type_multi(t, facets, 10)


_BY_TYPE = f"""
    SELECT row_number() OVER (ORDER BY job_count DESC, skill_name, skill_id) AS rank, skill_id,
           skill_name, skill_type, job_count, total_jobs, {_pct('job_count', 'total_jobs')}
    FROM (SELECT s.id AS skill_id, s.name AS skill_name, s.skill_type,
                 count(DISTINCT js.job_id) AS job_count,
                 (SELECT count(*) FROM postings p WHERE {YEAR_1997}) AS total_jobs
          FROM job_skills js JOIN skills s ON s.id = js.skill_id JOIN postings p ON p.id = js.job_id
          WHERE s.skill_type = 'technical_skill' AND {YEAR_1997}
          GROUP BY ALL ORDER BY job_count DESC, skill_name, skill_id {{limit}})"""


@query("top_by_type", with_roles(_BY_TYPE.format(limit="LIMIT 10"),
                                 "postings", "skills", "job_skills"))
def top_by_type(t):
    facets = Facets.of(skill_type="technical_skill", year=1997, month=13, guarded=True)
    return rk.top_by_type(t, facets, 10)


@query("all_by_type", with_roles(_BY_TYPE.format(limit=""), "postings", "skills", "job_skills"))
def all_by_type(t):
    return rk.top_by_type(t, Facets.of(skill_type="technical_skill", year=1997), None)


@query("by_category", with_roles("""
    SELECT s.skill_type, count(*) AS cnt
    FROM job_skills js JOIN skills s ON s.id = js.skill_id JOIN postings p ON p.id = js.job_id
    WHERE p.keyword = '1-URGENT' AND month(p.posted_date) = 5 GROUP BY ALL""",
    "postings", "skills", "job_skills"))
def by_category(t):
    return rk.by_category(t, Facets.of(keyword="1-URGENT", month=5))


@query("distribution_nested", with_roles(f"""
    SELECT w.name AS skill_type, coalesce(total, 0) AS total,
           CASE WHEN all_total > 0 THEN round(100.0::DOUBLE * coalesce(total, 0) / all_total, 1)
                ELSE 0.0::DOUBLE END AS percentage, b.rank, b.name, b.cnt
    FROM (SELECT name FROM skill_types WHERE name IN ('tech_stack', 'soft_skill')) w
    LEFT JOIN totals x ON x.skill_type = w.name
    LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) b ON b.skill_type = w.name
    CROSS JOIN (SELECT CAST(sum(total) AS BIGINT) AS all_total FROM totals)""",
    "jobs", "skills", "job_skills", "skill_types",
    used="""SELECT s.skill_type, s.name FROM job_skills js JOIN skills s ON s.id = js.skill_id
            JOIN jobs p ON p.id = js.job_id
            WHERE s.skill_type IN ('tech_stack', 'soft_skill') AND p.employee_size = '1001-5000'""",
    totals="SELECT skill_type, count(*) AS total FROM used GROUP BY ALL",
    ranked="""SELECT skill_type, name, count(*) AS cnt, row_number() OVER (PARTITION BY skill_type
              ORDER BY count(*) DESC, name) AS rank FROM used GROUP BY skill_type, name"""))
def distribution_nested(t):
    nested = rk.distribution(t, Facets.of(employee_size="1001-5000"), ("tech_stack", "soft_skill"), 5)
    return rk.flatten_top(nested)


@query("by_location", with_roles(f"""
    SELECT location, cnt, {_pct('cnt', 'sum(cnt) OVER ()')}
    FROM (SELECT location, count(*) AS cnt FROM jobs WHERE keyword_id = 2 GROUP BY ALL
          ORDER BY cnt DESC, location NULLS FIRST LIMIT 10)""", "jobs"))
def by_location(t):
    return rk.jobs_by_location(t, Facets.of(keyword_id=2), 10)


def _top_companies_sql(cols: str, order: str) -> str:
    return f"""
    SELECT row_number() OVER (ORDER BY job_count DESC, {order}) AS rank, {cols}, job_count,
           {_pct('job_count', '(SELECT count(*) FROM holders)')}
    FROM (SELECT {cols}, count(DISTINCT id) AS job_count FROM jobs
          WHERE id IN (SELECT job_id FROM holders) AND company IS NOT NULL AND company <> ''
          GROUP BY ALL ORDER BY job_count DESC, {order} LIMIT 5)"""


_HOLDERS = """SELECT DISTINCT js.job_id FROM job_skills js JOIN postings p ON p.id = js.job_id
              WHERE js.skill_id = (SELECT min(id) FROM skills WHERE lower(normalized_name) = 'red widget')"""


@query("top_companies", with_roles(
    _top_companies_sql("company, company_url", "company NULLS FIRST, company_url NULLS FIRST"),
    "jobs", "skills", "job_skills", holders=_HOLDERS))
def top_companies(t):
    return rk.top_companies(t, " Red Widget ", Facets(), 5)


@query("top_companies_by_name", with_roles(
    _top_companies_sql("company", "company NULLS FIRST"),
    "jobs", "skills", "job_skills", holders=_HOLDERS))
def top_companies_by_name(t):
    return rk.top_companies(t, "red widget", Facets(), 5, by=("company",))


@query("stats_scalars", with_roles("""
    SELECT (SELECT count(*) FROM postings) AS total_jobs,
           (SELECT count(*) FROM job_skills) AS total_skills,
           (SELECT count(*) FROM skills) AS unique_skills,
           (SELECT count(DISTINCT job_id) FROM job_skills) AS processed_jobs""",
    "postings", "skills", "job_skills"))
def stats_scalars(t):
    return rk.overall_numbers(t)


@query("skills_per_type", with_roles("""
    SELECT ty.name, count(s.id) AS cnt
    FROM (SELECT name FROM skill_types UNION ALL SELECT 'language') ty
    LEFT JOIN skills s ON s.skill_type = ty.name GROUP BY ALL""", "skill_types", "skills"))
def skills_per_type(t):
    types = t.skill_types.select("name").union(t.spark.range(1).select(F.lit("language")))
    return rk.counts_with_zeros(types, t.skills, "name", "skill_type")


@query("jobs_per_company_outer", with_roles("""
    SELECT c.company_id, c.company, c.city, count(p.id) AS cnt
    FROM companies c LEFT JOIN postings p ON p.company_id = c.company_id GROUP BY ALL""",
    "companies", "postings"))
def jobs_per_company_outer(t):
    left = t.companies.select("company_id", "company", "city")
    return rk.counts_with_zeros(left, t.postings, "company_id", "company_id")


@query("jobs_per_keyword", with_roles("""
    SELECT k.id, k.keyword, count(p.id) AS cnt
    FROM keywords k LEFT JOIN (SELECT * FROM postings WHERE status = 'pending'
         AND keyword_id <> 4) p ON p.keyword_id = k.id GROUP BY ALL""", "keywords", "postings"))
def jobs_per_keyword(t):
    waiting = t.postings.filter((F.col("status") == "pending") & (F.col("keyword_id") != 4))
    return rk.counts_with_zeros(t.keywords, waiting, "id", "keyword_id")


@query("size_natural_sort", with_roles("""
    SELECT employee_size, count(*) AS cnt,
           coalesce(CAST(nullif(regexp_extract(employee_size, '\\d+'), '') AS BIGINT), 999999)
           AS sort_key FROM jobs
    WHERE employee_size IS NOT NULL AND employee_size <> '' GROUP BY ALL""", "jobs"))
def size_natural_sort(t):
    return rk.size_counts(t.jobs).orderBy("sort_key", "employee_size")


@query("skill_list", with_roles("""
    SELECT row_number() OVER (ORDER BY cnt DESC, name) AS position, name, cnt
    FROM (SELECT s.name, count(*) AS cnt FROM skills s JOIN job_skills js ON js.skill_id = s.id
          GROUP BY s.name)""", "skills", "job_skills"))
def skill_list(t):
    return rk.skills_by_frequency(t)


@query("skill_suggestions", with_roles("""
    SELECT s.name, count(*) AS cnt FROM skills s JOIN job_skills js ON js.skill_id = s.id
    WHERE contains(lower(s.name), 'wid') GROUP BY s.name ORDER BY cnt DESC, s.name LIMIT 8""",
    "skills", "job_skills"))
def skill_suggestions(t):
    return rk.suggest(t, " Wid", 8)


@query("skill_page", with_roles("""
    SELECT s.id, s.name, s.normalized_name, s.skill_type,
           (SELECT count(*) FROM job_skills js WHERE js.skill_id = s.id) AS job_count
    FROM (SELECT * FROM skills WHERE skill_type = 'soft_skill' ORDER BY id LIMIT 20 OFFSET 40) s""",
    "skills", "job_skills"))
def skill_page(t):
    return rk.skill_page(t, 40, 20, "soft_skill")


@query("top_ten_overall", with_roles("""
    SELECT s.name, s.skill_type, count(*) AS cnt, row_number() OVER
           (ORDER BY count(*) DESC, s.name, s.skill_type) AS rank
    FROM skills s JOIN job_skills js ON js.skill_id = s.id
    GROUP BY s.name, s.skill_type ORDER BY rank LIMIT 10""", "skills", "job_skills"))
def top_ten_overall(t):
    return rk.top_skills_ranked(t, Facets(), 10).drop("percentage")


_OVERVIEW = """
    SELECT k.id AS keyword_id, k.keyword, count(p.id) AS total_jobs,
           count(*) FILTER (p.id IS NOT NULL AND (p.status = 'completed' OR js.job_id IS NOT NULL))
               AS completed_jobs,
           max(p.created_at) AS last_scraped_at,
           arg_max(p.job_title, (p.created_at, p.id)) AS latest_job_title
    FROM keywords k LEFT JOIN postings p ON p.keyword_id = k.id
    LEFT JOIN (SELECT DISTINCT job_id FROM job_skills) js ON js.job_id = p.id GROUP BY ALL"""


@query("scrape_overview", with_roles("""
    SELECT *, greatest(total_jobs - completed_jobs, 0) AS pending_jobs,
           CASE WHEN total_jobs > 0 THEN round(100.0::DOUBLE * completed_jobs / total_jobs, 1)
                ELSE 0.0::DOUBLE END AS extraction_rate FROM o""",
    "keywords", "postings", "job_skills", o=_OVERVIEW))
def scrape_overview(t):
    return rk.keyword_overview(t.postings, t.job_skills, t.keywords)


@query("scrape_overview_totals", with_roles("""
    SELECT count(*) AS total_keywords, CAST(sum(total_jobs) AS BIGINT) AS total_jobs,
           CAST(sum(completed_jobs) AS BIGINT) AS total_completed,
           CAST(sum(greatest(total_jobs - completed_jobs, 0)) AS BIGINT) AS total_pending FROM o""",
    "keywords", "postings", "job_skills", o=_OVERVIEW))
def scrape_overview_totals(t):
    return rk.overview_totals(rk.keyword_overview(t.postings, t.job_skills, t.keywords))
