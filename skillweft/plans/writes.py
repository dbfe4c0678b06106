"""Inserts, updates, deletes, ingest, monitoring and exports."""

from pyspark.sql import functions as F

from skillweft import dictionaries as d
from skillweft.operators import companies as co
from skillweft.operators import ingest as ig
from skillweft.operators import quality as ql
from skillweft.operators import rewrite as rw
from skillweft.operators.lookups import unprocessed_jobs
from skillweft.plans import sqltext as q
from skillweft.plans.companies import FILL_URLS, found_urls
from skillweft.plans.registry import query
from skillweft.plans.texts import KEYWORDS, keyword_table
from skillweft.roles import with_roles
from skillweft.session import fresh_folder
from skillweft.sources import readers as rd
from skillweft.sources import writers as wr
from skillweft.sources.folders import KeyedFolders


def finished_links(t):
    return t.postings.filter(F.col("status") == "completed").select("link")


@query("append_absent", with_roles("""
    SELECT link, arg_min(id, (created_at, id)) AS id FROM (SELECT job_title AS link, id, created_at FROM postings)
    WHERE link NOT IN ('Backend Developer') GROUP BY link""", "postings"))
def append_absent(t):
    """Titles as keys, so that many new rows share one."""
    rows = t.postings.select(F.col("job_title").alias("link"), "id", "created_at")
    stored = t.spark.createDataFrame([("Backend Developer",)], "link STRING")
    return rw.append_absent(stored, rows, "link", F.struct("created_at", "id")).select("link", "id")


@query("append_new_links", with_roles("""
    SELECT link, id FROM postings WHERE link NOT IN (SELECT link FROM postings WHERE status = 'completed')""", "postings"))
def append_new_links(t):
    return rw.append_absent(finished_links(t), t.postings.select("link", "id"), "link", F.struct("id"))


@query("seed_keywords", with_roles(f"""
    SELECT keyword FROM keywords UNION ALL SELECT keyword FROM ({KEYWORDS})""", "keywords"))
def seed_keywords(t):
    once = rw.seed(t.keywords.select("keyword"), keyword_table(t).select("keyword"), "keyword")
    return rw.seed(once, keyword_table(t).select("keyword"), "keyword")


def _incoming(t):
    """Fetched companies; those of one nation were fetched twice with different slugs."""
    slug = F.when(F.col("c_nationkey") > 3, F.lower("c_mktsegment"))
    again = F.when(F.col("c_nationkey") % 3 == 0, F.array(slug, F.lit("later"), F.lit(None).cast("string")))
    return t.table("customer").filter(F.col("c_acctbal") > 0).select(
        F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")).alias("company_name"),
        F.when(F.col("c_acctbal") > 5000, "501-1000").otherwise("").alias("employee_size"),
        F.explode(F.coalesce(again, F.array(slug))).alias("linkedin_slug"), F.lit("fetched").alias("source"),
    )


_UPSERT = with_roles("""
    SELECT coalesce(o.company_name, n.company_name) AS company_name,
           CASE WHEN o.company_name IS NULL THEN n.employee_size
                WHEN coalesce(n.employee_size, '') <> '' THEN n.employee_size ELSE o.employee_size END AS employee_size,
           CASE WHEN n.company_name IS NOT NULL THEN n.linkedin_slug ELSE o.linkedin_slug END AS linkedin_slug,
           CASE WHEN n.company_name IS NOT NULL THEN n.source ELSE o.source END AS source
    FROM company_enrichment o FULL JOIN (SELECT replace(c_name, '#', ' ') AS company_name,
        CASE WHEN c_acctbal > 5000 THEN '501-1000' ELSE '' END AS employee_size,
        CASE WHEN c_nationkey % 3 = 0 AND NOT coalesce(c_nationkey > 3 AND lower(c_mktsegment) > 'later', false) THEN 'later'
             WHEN c_nationkey > 3 THEN lower(c_mktsegment) END AS linkedin_slug, 'fetched' AS source
        FROM customer WHERE c_acctbal > 0) n ON n.company_name = o.company_name""", "company_enrichment")


def _upsert(table, incoming):
    return rw.upsert(table, incoming, "company_name", ["linkedin_slug", "source"], ["employee_size"])


@query("upsert", _UPSERT)
def upsert(t):
    return _upsert(t.company_enrichment, _incoming(t))


def in_place(t, table, key, incoming, rewrite):
    """The table dealt into folders, changed there, and read again."""
    stored = KeyedFolders.create(table, fresh_folder(t.spark, "keyed"), key, folders=16)
    stored.change(incoming, rewrite)
    return stored.read()


@query("keyed_upsert", _UPSERT)
def keyed_upsert(t):
    return in_place(t, t.company_enrichment, "company_name", _incoming(t), _upsert)


_UPSERT_ANALYSIS = with_roles("""
    SELECT p.id AS job_id, p.job_title, CASE WHEN p.status = 'pending' THEN 'Bandung' ELSE a.location END AS location,
           CASE WHEN p.status = 'pending' THEN p.keyword ELSE a.tech_stack END AS tech_stack
    FROM postings p LEFT JOIN (SELECT job_id, arg_min(location, id) AS location, arg_min(tech_stack, id) AS tech_stack
                               FROM job_analysis WHERE year(posted_date) < 1998 GROUP BY job_id) a ON a.job_id = p.id
    WHERE p.status = 'pending' OR a.job_id IS NOT NULL""", "postings", "job_analysis")


def _analysis(t):
    """Stored and fresh rows."""
    stored = t.job_analysis.filter(F.year("posted_date") < 1998).groupBy("job_id").agg(
        F.first("job_title").alias("job_title"), F.min_by("location", "id").alias("location"),
        F.min_by("tech_stack", "id").alias("tech_stack"),
    )
    fresh = t.postings.filter(F.col("status") == "pending").select(
        F.col("id").alias("job_id"), "job_title", F.lit("Bandung").alias("location"), F.col("keyword").alias("tech_stack")
    )
    return stored, fresh


@query("upsert_analysis", _UPSERT_ANALYSIS)
def upsert_analysis(t):
    return rw.upsert_analysis(*_analysis(t))


@query("keyed_upsert_analysis", _UPSERT_ANALYSIS)
def keyed_upsert_analysis(t):
    stored, fresh = _analysis(t)
    return in_place(t, stored, "job_id", fresh, rw.upsert_analysis)


_PARTIAL_UPDATE = with_roles("""
    SELECT j.id, j.job_title, coalesce(x.company, j.company) AS company, coalesce(x.location, j.location) AS location
    FROM jobs j LEFT JOIN (SELECT s_suppkey AS id, CASE WHEN s_acctbal > 0 THEN s_name END AS company,
        CASE WHEN s_nationkey > 9 THEN 'Cimahi' ELSE 'Bogor' END AS location FROM supplier) x ON x.id = j.id""", "jobs")


def _patches(t):
    """Two patches per job: one with the company, both with a place."""
    rows = t.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name"), "s_acctbal", "s_nationkey")
    patches = rows.select(
        "id", F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("company"), F.lit("Bogor").alias("location")
    ).union(rows.select("id", F.lit(None).cast("string"), F.when(F.col("s_nationkey") > 9, "Cimahi")))
    return t.jobs.select("id", "job_title", "company", "location"), patches


@query("partial_update", _PARTIAL_UPDATE)
def partial_update(t):
    return rw.patch(*_patches(t), "id")


@query("keyed_partial_update", _PARTIAL_UPDATE)
def keyed_partial_update(t):
    stored, patches = _patches(t)
    return in_place(t, stored, "id", patches, lambda rows, incoming: rw.patch(rows, incoming, "id"))


@query("keyed_fill_urls", FILL_URLS)
def keyed_fill_urls(t):
    stored = t.jobs.select("id", "company", "company_url")
    return in_place(t, stored, "company", found_urls(t), co.fill_urls).select("id", "company_url")


_CASCADE = {
    "jobs": ("SELECT id FROM postings WHERE keyword_id <> 2", ["id"]),
    "job_skills": ("SELECT job_id, skill_id FROM job_skills WHERE job_id IN (SELECT id FROM postings WHERE keyword_id <> 2)",
                   ["job_id", "skill_id"]),
    "job_analysis": ("SELECT id, job_id FROM job_analysis WHERE job_id IN (SELECT id FROM postings WHERE keyword_id <> 2)",
                     ["id", "job_id"]),
    "keywords": ("SELECT id, keyword FROM keywords WHERE id <> 2", ["id", "keyword"]),
}


def _without_keyword(t):
    tables = {"keywords": t.keywords, "jobs": t.postings, "job_skills": t.job_skills, "job_analysis": t.job_analysis}
    return rw.delete_keywords(tables, t.spark.createDataFrame([(2,)], "id INT"))


def _register_cascade(name, sql, columns):
    needs = ["postings", *([name] if name not in ("jobs",) else [])]

    @query(f"cascade_delete_{name}", with_roles(sql, *needs))
    def run(t):
        return _without_keyword(t)[name].select(*columns)


for _name, (_sql, _columns) in _CASCADE.items():
    _register_cascade(_name, _sql, _columns)


@query("delete_skills", with_roles("""
    SELECT job_id, skill_id FROM job_skills WHERE skill_id NOT IN (SELECT id FROM skills WHERE skill_type = 'soft_skill')""",
    "skills", "job_skills"))
def delete_skills(t):
    gone = t.skills.filter(F.col("skill_type") == "soft_skill").select("id")
    return rw.delete_skills({"skills": t.skills, "job_skills": t.job_skills}, gone)["job_skills"]


@query("reset_derived", with_roles("""
    SELECT 'job_skills' AS name, CAST(0 AS BIGINT) AS cnt UNION ALL SELECT 'jobs', count(*) FROM postings
    UNION ALL SELECT 'skills', 0""", "postings"))
def reset_derived(t):
    tables = {"jobs": t.postings, "skills": t.skills, "job_skills": t.job_skills}
    kept = wr.reset_derived(tables, keep={"jobs"})
    counts = [df.agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(n).alias("name"), "cnt") for n, df in kept.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query("reconcile", with_roles("""
    SELECT (SELECT count(*) FROM postings WHERE status = 'completed') AS before,
           (SELECT count(*) FROM postings WHERE status <> 'completed') AS added,
           (SELECT count(*) FROM postings) AS after, true AS balanced""", "postings"))
def reconcile(t):
    new = rw.append_absent(finished_links(t), t.postings.select("link"), "link")
    return rw.reconcile(finished_links(t), new, t.postings).select("before", "added", "after", "balanced")


@query("requeue_empty_jobs", with_roles("""
    SELECT a.id, a.job_id FROM job_analysis a WHERE a.job_id IN (SELECT job_id FROM job_skills)""",
    "job_analysis", "job_skills"))
def requeue_empty_jobs(t):
    """Analysed rows left after jobs without skills are put back into the queue."""
    waiting = unprocessed_jobs(t.postings, t.job_skills)
    return rw.delete_keys(t.job_analysis, waiting, "job_id").select("id", "job_id")


def list_pages(t):
    """One list page per job with its card; title, company and place come from the job."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    page = F.concat(
        F.lit('<html><body><ul class="r"><li class="ad">ad</li><li><div class="base-card"><a class="base-card__full-link x" href="'
              'https://id.linkedin.com/jobs/view/role-at-x-'), F.col("id"), F.lit('?refId=1&amp;trk=2"><span>open</span></a>'
              '<h3 class="base-search-card__title">\n  '), text("job_title"), F.lit('  </h3><h4 class="base-search-card__subtitle">'
              '<a href="/c">'), text("company"), F.lit('</a></h4><span class="job-search-card__location"> '), text("location"),
        F.lit(' </span><time datetime="'), F.date_format("posted_date", "yyyy-MM-dd"), F.lit('">new</time></div></li></ul></body></html>'),
    )
    return rd.spread(t.jobs, "id").select(F.col("id").alias("page_id"), "keyword_id", page.alias("html"))


CARDS = """SELECT id, coalesce(company, '') AS company, coalesce(location, '') AS location, posted_date, keyword_id,
    job_title, link, status FROM jobs"""


@query("html_cards", with_roles("""
    SELECT id AS page_id, trim(job_title) AS title, company, location, strftime(posted_date, '%Y-%m-%d') AS date FROM c""",
    "jobs", c=CARDS))
def html_cards(t):
    return ig.cards(list_pages(t)).select("page_id", "title", "company", "location", "date")


@query("ingest_postings", with_roles(f"""
    SELECT link, title_clean AS job_title, company, coalesce(nullif(location, ''), 'Indonesia') AS location,
           coalesce((SELECT arg_min(k.id, (-length(k.keyword), k.id)) FROM kw k
                     WHERE len(list_filter(string_split(lower(k.keyword), ' '),
                               lambda w: NOT contains(lower(title_clean), w))) = 0), keyword_id) AS keyword_id,
           CAST(posted_date AS DATE) AS posted_date
    FROM (SELECT *, {q.clean_title('job_title')} AS title_clean FROM c)
    WHERE status <> 'completed' AND {q.any_in('lower(title_clean)', d.ROLE_TERMS)}
      AND NOT {q.any_in('lower(title_clean)', d.ROLE_EXCLUSIONS)}""", "jobs", c=CARDS, kw=KEYWORDS))
def ingest_postings(t):
    return ig.new_postings(list_pages(t), finished_links(t), keyword_table(t), F.lit("2000-01-01").cast("date"))


@query("posting_details", with_roles("""
    SELECT link, CASE WHEN id % 3 = 0 THEN '' ELSE repeat(job_title || ' at work. ', 12) || 'End' END AS job_description,
           CASE WHEN id % 3 = 1 AND company_url <> '' THEN company_url END AS company_url FROM jobs""", "jobs"))
def posting_details(t):
    """Description and company address from detail pages; a third of the jobs has none."""
    text = F.concat(F.repeat(F.concat("job_title", F.lit(" at work. ")), F.lit(12)), F.lit("End"))
    link = F.when((F.col("id") % 3 == 1) & (F.coalesce("company_url", F.lit("")) != ""),
                  F.concat(F.lit('<a href="'), "company_url", F.lit('?trk=x">c</a>'))).otherwise(F.lit(""))
    pages = rd.spread(t.jobs.filter(F.col("id") % 3 != 0), "id").select("link", F.concat(
        F.lit("<html><body>"), link, F.lit('<main><div class="description">'), text, F.lit("</div></main></body></html>")
    ).alias("html"))
    return ig.with_details(t.jobs.select("link"), pages).select("link", "job_description", "company_url")


def run_events(t):
    """Events as items of monitored runs: one run per user."""
    kind = F.element_at(F.create_map(*[F.lit(x) for x in (
        "view", "start", "click", "start", "signup", "skip", "error", "error", "purchase", "complete")]), F.col("event_type"))
    return t.table("events").select(
        F.col("user_id").alias("run_id"), F.get_json_object("props", "$.k").cast("bigint").alias("item_id"), "ts",
        kind.alias("event"), F.floor("value").alias("duplicates"),
    )


@query("run_summary", """
    WITH e AS (SELECT user_id AS run_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, ts, event_type,
                      CAST(floor(value) AS BIGINT) AS duplicates FROM events),
    s AS (SELECT run_id, count(DISTINCT item_id) AS total, count(*) FILTER (event_type = 'purchase') AS completed,
                 count(*) FILTER (event_type = 'signup') AS skipped, count(*) FILTER (event_type = 'error') AS errors,
                 CAST(coalesce(sum(duplicates) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS duplicates,
                 CAST(epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 AS BIGINT) AS elapsed_seconds
          FROM e GROUP BY run_id),
    x AS (SELECT *, completed + skipped + errors AS done,
                 greatest(elapsed_seconds / (completed + skipped + errors) * (total - (completed + skipped + errors)), 0) AS rest FROM s)
    SELECT run_id, total, completed, skipped, errors, duplicates,
           round(100.0::DOUBLE * done / greatest(total, 1), 1) AS percentage, elapsed_seconds,
           CASE WHEN elapsed_seconds < 60 THEN elapsed_seconds || 's'
                WHEN elapsed_seconds < 3600 THEN elapsed_seconds // 60 || 'm ' || elapsed_seconds % 60 || 's'
                ELSE elapsed_seconds // 3600 || 'h ' || (elapsed_seconds % 3600) // 60 || 'm' END AS elapsed,
           CASE WHEN done = 0 THEN 'calculating...' WHEN rest < 60 THEN CAST(floor(rest) AS BIGINT) || 's'
                WHEN rest < 3600 THEN CAST(floor(rest) AS BIGINT) // 60 || 'm ' || CAST(floor(rest) AS BIGINT) % 60 || 's'
                ELSE CAST(floor(rest) AS BIGINT) // 3600 || 'h ' || (CAST(floor(rest) AS BIGINT) % 3600) // 60 || 'm' END AS remaining
    FROM x""")
def run_summary(t):
    return ql.run_summary(run_events(t))


@query("run_item_states", """
    SELECT run_id, item_id, CASE last_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'skipped' WHEN 'error' THEN 'error'
           ELSE 'processing' END AS status
    FROM (SELECT user_id AS run_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
                 arg_max(event_type, ts) AS last_type FROM events GROUP BY ALL)""")
def run_item_states(t):
    return ql.item_states(run_events(t)).select("run_id", "item_id", "status")


@query("run_recent_items", """
    SELECT user_id AS run_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
           coalesce(max(ts) FILTER (event_type IN ('purchase', 'signup', 'error')),
                    min(ts) FILTER (event_type IN ('view', 'click'))) AS changed
    FROM events GROUP BY ALL ORDER BY changed DESC, item_id LIMIT 5""")
def run_recent_items(t):
    return ql.recent_items(run_events(t), 5).select("run_id", "item_id", "changed")


@query("csv_round_trip", """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
           CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer""")
def csv_round_trip(t):
    """Export with empty fields for NULL, read back as text."""
    rows = t.table("customer").select(
        "c_custkey", "c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment")
    )
    path = fresh_folder(t.spark, "csv-export")
    wr.export_csv(rows, path)
    back = t.spark.read.option("header", True).csv(path)
    return back.na.fill("")


@query("word_list_source", """
    SELECT DISTINCT trim(s) AS skill FROM (SELECT unnest(string_split(replace(text, '. ', chr(10)), chr(10))) AS s FROM benchmark)
    WHERE trim(s) <> '' AND NOT contains(s, ',')""")
def word_list_source(t):
    """Sentences written as a one-column list: those with commas have too many fields and are dropped."""
    sentences = t.table("benchmark").select(
        F.explode(F.split(F.replace("text", F.lit(". "), F.lit("\n")), "\n")).alias("skill")
    ).filter(F.trim("skill") != "")
    path = fresh_folder(t.spark, "word-list")
    sentences.write.text(path)
    return rd.read_word_list(t.spark, path).distinct()


@query("size_cache", """
    SELECT CAST(event_id AS VARCHAR) AS key, CASE WHEN event_type = 'view' THEN '1-10' ELSE '51-200' END AS size FROM events
    WHERE event_type IN ('view', 'click') AND ts > TIMESTAMP '2024-01-01'""")
def size_cache(t):
    """JSON cache written and read with its validity rule: known labels younger than 30 days."""
    size = F.when(F.col("event_type") == "view", "1-10").when(F.col("event_type") == "click", "51-200").otherwise("big")
    rows = t.table("events").select(
        F.col("event_id").cast("string").alias("key"), size.alias("size"), F.col("event_type").alias("company"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
    )
    path = fresh_folder(t.spark, "size-cache")
    rows.write.json(path)
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    labels = [label for _, _, label in d.SIZE_RANGES]
    return rd.read_size_cache(t.spark, path, labels, now).select("key", "size")


@query("first_present_columns", """
    SELECT c_custkey AS id, c_name AS company, CAST(NULL AS VARCHAR) AS url FROM customer""")
def first_present_columns(t):
    return rd.first_present(t.table("customer"), {
        "id": ["id", "C_CUSTKEY"], "company": ["company_name", "c_name"], "url": ["company_url", "link"],
    })
