"""Lookups, joins, lists and pages."""

from pyspark.sql import functions as F

from skillweft.functions.titles import clean_title_text
from skillweft.operators import facet_lists as fl
from skillweft.operators import lookups as lk
from skillweft.operators import network as nw
from skillweft.operators import ordering as od
from skillweft.operators import rankings as rk
from skillweft.operators.facets import Facets, any_column_contains, contains_any, long_enough, or_default, present
from skillweft.plans.registry import query
from skillweft.roles import with_roles


@query("unprocessed_jobs", with_roles(
    "SELECT id FROM postings WHERE id NOT IN (SELECT job_id FROM job_skills)", "postings", "job_skills"))
def unprocessed_jobs(t):
    return lk.unprocessed_jobs(t.postings, t.job_skills)


@query("blank_analysis", with_roles("""
    SELECT DISTINCT job_id AS id FROM job_analysis WHERE coalesce(trim(tech_stack), '') = ''
      AND coalesce(trim(technical_skill), '') = '' AND coalesce(trim(soft_skill), '') = ''""",
    "job_analysis"))
def blank_analysis(t):
    return lk.blank_analysis_jobs(t.postings, t.job_analysis)


@query("not_enriched", with_roles("""
    SELECT company, count(*) AS job_count FROM jobs
    WHERE company IS NOT NULL AND company NOT IN ('', 'N/A')
      AND company NOT IN (SELECT company_name FROM company_enrichment) GROUP BY company""",
    "jobs", "company_enrichment"))
def not_enriched(t):
    return lk.companies_to_enrich(t.jobs, t.company_enrichment).orderBy(F.desc("job_count"), "company")


@query("latest_per_key", with_roles("""
    SELECT company_id, id, job_title, created_at FROM postings
    QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, id DESC) = 1""",
    "postings"))
def latest_per_key(t):
    rows = t.postings.select("company_id", "id", "job_title", "created_at")
    return lk.latest_per_key(rows, ["company_id"], [F.desc("created_at"), F.desc("id")])


@query("latest_url", with_roles("""
    SELECT company, arg_max(company_url, id) AS company_url FROM jobs
    WHERE company <> '' AND company_url <> '' GROUP BY company""", "jobs"))
def latest_url(t):
    return lk.latest_url(t.jobs)


@query("null_safe_join", with_roles("""
    SELECT j.id, j.company, j.company_url, m.biggest
    FROM jobs j JOIN m ON j.company = m.company AND j.company_url IS NOT DISTINCT FROM m.company_url""",
    "jobs", m="SELECT company, company_url, max(id) AS biggest FROM jobs GROUP BY ALL"))
def null_safe_join(t):
    rows = t.jobs.select("id", "company", "company_url")
    groups = rows.groupBy("company", "company_url").agg(F.max("id").alias("biggest"))
    return lk.null_safe_match(rows, groups, ["company"], ["company_url"])


@query("missing_urls", with_roles("""
    SELECT id, company FROM jobs WHERE company_url IS NULL OR company_url = ''""", "jobs"))
def missing_urls(t):
    return lk.missing_urls(t.jobs).select("id", "company")


@query("fallback_search", with_roles("""
    SELECT id, job_title, stage FROM staged WHERE stage = (SELECT min(stage) FROM staged)""",
    "jobs", "keywords",
    staged="""SELECT id, job_title, CASE
        WHEN contains(lower(job_title), 'engineer platform') OR contains(lower(job_title), 'senior engineer platform - remote') THEN 1
        WHEN keyword_id = (SELECT min(id) FROM keywords WHERE contains(lower(keyword), 'senior engineer platform - remote')) THEN 2
        WHEN contains(lower(job_title), 'engineer') OR contains(lower(job_title), 'platform') THEN 3 END AS stage
        FROM jobs WHERE employee_size = '1001-5000' AND stage IS NOT NULL"""))
def fallback_search(t):
    title = "Senior Engineer Platform - Remote"
    rows = lk.search_jobs(t.jobs, t.keywords, title, clean_title_text(title), "1001-5000")
    return rows.select("id", "job_title", F.col("stage").cast("int").alias("stage"))


@query("fallback_search_keyword", with_roles("""
    SELECT id, job_title, 2 AS stage FROM postings
    WHERE keyword_id = (SELECT min(id) FROM keywords WHERE contains(lower(keyword), 'high'))""",
    "postings", "keywords"))
def fallback_search_keyword(t):
    rows = lk.search_jobs(t.postings, t.keywords, "High", "High")
    return rows.select("id", "job_title", F.col("stage").cast("int").alias("stage"))


@query("exact_else_contains", with_roles("""
    SELECT id, name, skill_type, CASE WHEN lower(name) = 'red' THEN 1 ELSE 2 END AS stage FROM skills
    WHERE contains(lower(name), 'red') ORDER BY stage, id LIMIT 1""", "skills"))
def exact_else_contains(t):
    row = lk.exact_else_contains(t.skills, "name", " Red ")
    return row.select("id", "name", "skill_type", F.col("stage").cast("int").alias("stage"))


@query("single_row", with_roles(
    "SELECT id, job_id, location FROM job_analysis WHERE job_id = 30 ORDER BY id LIMIT 1", "job_analysis"))
def single_row(t):
    return lk.single_row(t.job_analysis, "job_id", 30).select("id", "job_id", "location")


@query("title_contains_any", with_roles("""
    SELECT id, job_title FROM postings WHERE contains(lower(job_title), 'analyst')
       OR contains(lower(job_title), 'ai  engineer')""", "postings"))
def title_contains_any(t):
    return t.postings.filter(contains_any("job_title", ["Analyst", "ai  Engineer"])).select("id", "job_title")


@query("any_column_search", """
    SELECT * FROM part WHERE contains(lower(CAST(p_partkey AS VARCHAR)), 'brand#1')
      OR contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1')
      OR contains(lower(p_type), 'brand#1')""")
def any_column_search(t):
    return any_column_contains(t.table("part"), "Brand#1")


@query("defaults_and_iso_dates", with_roles("""
    SELECT id, coalesce(nullif(company, ''), 'N/A') AS company,
           coalesce(nullif(location, ''), 'Indonesia') AS location,
           strftime(posted_date, '%Y-%m-%d') AS posted_on,
           strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM jobs""", "jobs"))
def defaults_and_iso_dates(t):
    return t.jobs.select(
        "id", or_default("company", "N/A").alias("company"),
        or_default("location", "Indonesia").alias("location"),
        F.date_format("posted_date", "yyyy-MM-dd").alias("posted_on"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )


@query("long_enough_texts", "SELECT doc_id, lang FROM documents WHERE length(text) >= 50")
def long_enough_texts(t):
    return t.table("documents").filter(long_enough("text", 50)).select("doc_id", "lang")


@query("present_locations", with_roles("""
    SELECT location, count(*) AS cnt FROM job_analysis
    WHERE location IS NOT NULL AND location NOT IN ('', 'other', 'Remote') GROUP BY ALL""", "job_analysis"))
def present_locations(t):
    return rk.value_counts(t.job_analysis, "location", "other", "Remote")


@query("present_companies", with_roles("""
    SELECT id, company FROM jobs WHERE company IS NOT NULL AND company NOT IN ('', 'N/A')""", "jobs"))
def present_companies(t):
    return t.jobs.filter(present("company", "N/A")).select("id", "company")


@query("facet_counts", with_roles("""
    SELECT 'keyword' AS facet, keyword AS value, count(*) AS cnt, CAST(0 AS BIGINT) AS sort_key FROM jobs GROUP BY keyword
    UNION ALL SELECT * FROM (SELECT 'company', company, count(*) AS c, 0 FROM jobs
        WHERE company <> '' GROUP BY company ORDER BY c DESC, company LIMIT 100)
    UNION ALL SELECT 'employee_size', employee_size, count(*),
        coalesce(CAST(nullif(regexp_extract(employee_size, '\\d+'), '') AS BIGINT), 999999)
        FROM jobs WHERE employee_size <> '' GROUP BY employee_size
    UNION ALL SELECT 'month', CAST(month(posted_date) AS VARCHAR), count(*), month(posted_date) FROM jobs GROUP BY month(posted_date)
    UNION ALL SELECT 'year', CAST(year(posted_date) AS VARCHAR), count(*), -year(posted_date) FROM jobs GROUP BY year(posted_date)
    UNION ALL SELECT 'city', location, count(*), 0 FROM job_analysis
        WHERE location NOT IN ('', 'other', 'Remote') GROUP BY location
    UNION ALL SELECT 'skill_type', name, NULL, 0 FROM skill_types
    UNION ALL SELECT 'last_extraction', strftime(max(extracted_at), '%Y-%m-%dT%H:%M:%S'), NULL, 0
        FROM job_analysis""", "jobs", "job_analysis", "skill_types"))
def facet_counts(t):
    return fl.filter_options(t)


@query("months_and_years", with_roles("""
    SELECT list_sort(list(DISTINCT CAST(month(posted_date) AS INT))) AS months,
           list_reverse_sort(list(DISTINCT CAST(year(posted_date) AS INT))) AS years FROM postings""", "postings"))
def months_and_years(t):
    return fl.months_and_years(t.postings)


@query("skill_type_list", with_roles("""
    SELECT ty.id, ty.name, coalesce(nullif(ty.description, ''), ty.name) AS description, count(s.id) AS skill_count
    FROM skill_types ty LEFT JOIN skills s ON s.skill_type = ty.name GROUP BY ALL""", "skill_types", "skills"))
def skill_type_list(t):
    listed = rk.counts_with_zeros(t.skill_types, t.skills, "name", "skill_type", "skill_count")
    return listed.withColumn("description", F.coalesce(F.nullif("description", F.lit("")), "name"))


@query("job_list", with_roles("""
    SELECT id, job_title, company, coalesce(nullif(location, ''), 'Indonesia') AS location, keyword,
           strftime(posted_date, '%Y-%m-%d') AS posted_date,
           strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at
    FROM (SELECT * FROM jobs WHERE keyword = '2-HIGH' AND month(posted_date) = 4
          AND id IN (SELECT job_id FROM job_analysis WHERE location = 'NATION_2')
          ORDER BY posted_date DESC, id LIMIT 50)""", "jobs", "job_analysis"))
def job_list(t):
    return fl.job_list(t, Facets.of(keyword="2-HIGH", month=4, location="NATION_2"), 50)


@query("analysis_page", with_roles("""
    SELECT id, job_id, job_title, company, location, keyword,
           strftime(extracted_at, '%Y-%m-%dT%H:%M:%S') AS extracted_at,
           (SELECT count(*) FROM picked) AS total
    FROM picked ORDER BY extracted_at DESC, id LIMIT 100 OFFSET 50""", "job_analysis",
    picked="""SELECT * FROM job_analysis WHERE year(posted_date) = 1997 AND employee_size = '5001-10000'
              AND location IN ('NATION_1', 'NATION_2', 'NATION_5')"""))
def analysis_page(t):
    facets = Facets.of(year=1997, employee_size="5001-10000",
                       location="NATION_1,NATION_2,NATION_5", multi=True)
    return fl.analysis_page(t.job_analysis, facets, 50, 100)


@query("page_offset", with_roles(
    "SELECT id, keyword, posted_date FROM postings ORDER BY posted_date DESC, id LIMIT 25 OFFSET 200",
    "postings"))
def page_offset(t):
    rows = t.postings.select("id", "keyword", "posted_date")
    return od.page(rows, [F.desc("posted_date"), F.asc("id")], 200, 25)


@query("page_keyset", with_roles(
    "SELECT id, keyword FROM postings WHERE id > 5000 ORDER BY id LIMIT 25", "postings"))
def page_keyset(t):
    return od.page_after(t.postings.select("id", "keyword"), "id", 5000, 25)


@query("user_sorted_page", """
    SELECT p_partkey, p_name, p_brand FROM part ORDER BY lower(p_brand) DESC, p_partkey LIMIT 20 OFFSET 20""")
def user_sorted_page(t):
    rows = t.table("part").select("p_partkey", "p_name", "p_brand")
    return od.page(rows, [*od.user_order(rows, "p_brand", "desc"), F.asc("p_partkey")], 20, 20)


@query("batches", with_roles("""
    SELECT id, CAST((r - 1) // 20 AS BIGINT) AS batch_id, (r - 1) % 20 + 1 AS batch_pos
    FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM postings
          WHERE id NOT IN (SELECT job_id FROM job_skills))""", "postings", "job_skills"))
def batches(t):
    waiting = lk.unprocessed_jobs(t.postings, t.job_skills)
    return od.batches(waiting, [F.asc("id")], 20)


@query("number_all_jobs", with_roles("""
    SELECT id, keyword, row_number() OVER (ORDER BY keyword, posted_date DESC, id) AS row_no
    FROM postings""", "postings"))
def number_all_jobs(t):
    rows = t.postings.select("id", "keyword", "posted_date")
    numbered = od.number_all(rows, [F.asc("keyword"), F.desc("posted_date"), F.asc("id")])
    return numbered.select("id", "keyword", "row_no")


@query("recent_items", """
    SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 5""")
def recent_items(t):
    rows = t.table("events").select("event_id", "ts", "event_type")
    return od.top_n(rows, [F.desc("ts"), F.desc("event_id")], 5)


_EGO = dict(
    seed="""SELECT id, name FROM skills WHERE lower(name) = 'red widget' OR normalized_name = 'red widget'
            ORDER BY id LIMIT 1""",
    picked="SELECT id FROM jobs WHERE keyword_id = 2 AND employee_size = '5001-10000'",
    links="""SELECT (SELECT name FROM seed) AS source, s.name AS target, count(*) AS weight
             FROM job_skills js JOIN skills s ON s.id = js.skill_id
             WHERE js.job_id IN (SELECT job_id FROM job_skills WHERE skill_id = (SELECT id FROM seed)
                                 AND job_id IN (SELECT id FROM picked))
               AND s.id <> (SELECT id FROM seed)
             GROUP BY s.name ORDER BY weight DESC, target LIMIT 20""",
)
_EGO_FACETS = Facets.of(keyword_id=2, employee_size="5001-10000")


@query("cooccurrence_ego", with_roles("SELECT * FROM links", "jobs", "skills", "job_skills", **_EGO))
def cooccurrence_ego(t):
    return nw.neighbours(t, "Red Widget", _EGO_FACETS)


@query("cooccurrence_nodes", with_roles("""
    SELECT n.name AS id, (SELECT count(*) FROM job_skills js JOIN skills s ON s.id = js.skill_id
                          WHERE s.name = n.name AND js.job_id IN (SELECT id FROM picked)) AS frequency
    FROM (SELECT name FROM seed UNION SELECT target FROM links) n""",
    "jobs", "skills", "job_skills", **_EGO))
def cooccurrence_nodes(t):
    links = nw.neighbours(t, "Red Widget", _EGO_FACETS)
    return nw.node_frequencies(t, "Red Widget", links, _EGO_FACETS)


@query("cooccurrence_unknown_seed", """
    SELECT 'no such skill' AS id, CAST(0 AS BIGINT) AS frequency""")
def cooccurrence_unknown_seed(t):
    links = nw.neighbours(t, "no such skill", Facets())
    return nw.node_frequencies(t, "no such skill", links, Facets())


@query("neighbour_set", with_roles("""
    SELECT target AS name FROM links WHERE source = (SELECT name FROM seed)
    UNION SELECT source FROM links WHERE target = (SELECT name FROM seed)""", "jobs", "skills", "job_skills", **_EGO))
def neighbour_set(t):
    seed_name = nw.seed_skill(t.skills, "Red Widget").select("name").scalar()
    return nw.neighbour_set(nw.neighbours(t, "Red Widget", _EGO_FACETS), seed_name)
