"""Monthly trends, spines and period comparison."""

from pyspark.sql import functions as F

from skillweft.operators import trends as tr
from skillweft.operators.facets import Facets
from skillweft.operators.ordering import top_n
from skillweft.plans.registry import query
from skillweft.roles import with_roles

USED = """SELECT strftime(p.posted_date, '%Y-%m') AS month, s.id AS skill_id, s.name, s.skill_type,
                 p.id AS job_id, p.keyword_id
          FROM job_skills js JOIN skills s ON s.id = js.skill_id JOIN postings p ON p.id = js.job_id"""
MODEL = ("postings", "skills", "job_skills")


@query("timeline_pivot", with_roles("""
    SELECT month, count(*) FILTER (skill_type = 'tech_stack') AS tech_stack,
           count(*) FILTER (skill_type = 'technical_skill') AS technical_skill,
           count(*) FILTER (skill_type = 'soft_skill') AS soft_skill, count(*) AS total
    FROM used WHERE keyword_id = 3 GROUP BY ALL ORDER BY month DESC LIMIT 12""", *MODEL, used=USED))
def timeline_pivot(t):
    types = ("tech_stack", "technical_skill", "soft_skill")
    return tr.timeline(t, Facets.of(keyword_id=3), types, 12)


@query("trend_monthly", with_roles("""
    SELECT CAST(substr(month, 1, 4) AS INT) AS year, CAST(substr(month, 6, 2) AS INT) AS month_num,
           month, name, skill_type, count(*) AS cnt
    FROM used WHERE skill_type = 'soft_skill' GROUP BY ALL""", *MODEL, used=USED))
def trend_monthly(t):
    return tr.year_and_month(tr.monthly_skill_counts(t, Facets.of(skill_type="soft_skill")))


@query("trend_named_skills", with_roles("""
    SELECT month, name, skill_type, count(*) AS cnt
    FROM used WHERE name IN ('red widget', 'BLUE BOLT') GROUP BY ALL""", *MODEL, used=USED))
def trend_named_skills(t):
    counts = tr.monthly_skill_counts(t, Facets())
    return counts.filter(F.col("name").isin("red widget", "BLUE BOLT"))


@query("skill_series", with_roles("""
    SELECT month, count(*) AS cnt FROM used
    WHERE skill_id = (SELECT min(id) FROM skills WHERE name = 'red widget') GROUP BY ALL""",
    *MODEL, used=USED))
def skill_series(t):
    return tr.skill_series(t, "red widget", Facets())


@query("month_totals", with_roles("""
    SELECT strftime(posted_date, '%Y-%m') AS month, count(DISTINCT id) AS total_jobs
    FROM postings GROUP BY ALL""", "postings"))
def month_totals(t):
    return tr.job_totals_per_month(t.postings)


@query("top_per_month", with_roles("""
    SELECT m.month, m.total_jobs, r.skill_id, r.name, r.skill_type, r.cnt, r.rank
    FROM (SELECT strftime(posted_date, '%Y-%m') AS month, count(*) AS total_jobs FROM postings
          WHERE year(posted_date) = 1998 GROUP BY 1) m
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY month ORDER BY cnt DESC, name, skill_id) AS rank
               FROM (SELECT month, skill_id, name, skill_type, count(*) AS cnt FROM used GROUP BY ALL)
               QUALIFY rank <= 5) r USING (month)""", *MODEL, used=USED))
def top_per_month(t):
    return tr.top_per_month(t, Facets.of(year=1998), 5)


@query("months_nested", with_roles("""
    SELECT m.month, m.total_jobs, coalesce(string_agg(r.rank || ' ' || r.name || ' ' || r.cnt, '; ' ORDER BY r.rank), '') AS skills
    FROM (SELECT strftime(posted_date, '%Y-%m') AS month, count(*) AS total_jobs FROM postings
          WHERE year(posted_date) = 1998 GROUP BY 1) m
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY month ORDER BY cnt DESC, name, skill_id) AS rank
               FROM (SELECT month, skill_id, name, skill_type, count(*) AS cnt FROM used GROUP BY ALL)
               QUALIFY rank <= 5) r USING (month) GROUP BY ALL""", *MODEL, used=USED))
def months_nested(t):
    """One row per month with its first five skills as a list."""
    nested = tr.nest_months(tr.top_per_month(t, Facets.of(year=1998), 5))
    entries = F.transform("skills", lambda s: F.concat_ws(" ", s["rank"].cast("string"), s["name"], s["cnt"].cast("string")))
    return nested.select("month", "total_jobs", F.array_join(entries, "; ").alias("skills"))


@query("all_per_month_one_type", with_roles("""
    SELECT m.month, m.total_jobs, r.skill_id, r.name, r.skill_type, r.cnt, r.rank
    FROM (SELECT strftime(posted_date, '%Y-%m') AS month, count(*) AS total_jobs FROM postings
          WHERE year(posted_date) = 1998 AND month(posted_date) IN (2, 3) GROUP BY 1) m
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY month ORDER BY cnt DESC, name, skill_id) AS rank
               FROM (SELECT month, skill_id, name, skill_type, count(*) AS cnt FROM used
                     WHERE skill_type = 'tech_stack' GROUP BY ALL)) r USING (month)""",
    *MODEL, used=USED))
def all_per_month_one_type(t):
    facets = Facets.of(year=1998, month="2,3", skill_type="tech_stack")
    return tr.top_per_month(t, facets, None)


@query("month_spine", with_roles("""
    SELECT g.name, g.month, coalesce(c.cnt, 0) AS cnt
    FROM (SELECT k.name, strftime(m.d, '%Y-%m') AS month
          FROM (SELECT DISTINCT name FROM counts) k,
               (SELECT unnest(generate_series(hi - INTERVAL 11 MONTH, hi, INTERVAL 1 MONTH)) AS d
                FROM (SELECT strptime(max(month) || '-01', '%Y-%m-%d') AS hi FROM counts)) m) g
    LEFT JOIN counts c ON c.name = g.name AND c.month = g.month""", *MODEL, used=USED,
    counts="""SELECT month, name, count(*) AS cnt FROM used WHERE keyword_id = 1
              AND skill_type = 'tech_stack' GROUP BY ALL"""))
def month_spine(t):
    facets = Facets.of(keyword_id=1, skill_type="tech_stack")
    return tr.month_spine(tr.monthly_skill_counts(t, facets, ("name",)), "name")


@query("month_spine_year_gaps", with_roles("""
    SELECT g.name, g.month, c.cnt
    FROM (SELECT k.name, strftime(m.d, '%Y-%m') AS month
          FROM (SELECT DISTINCT name FROM counts WHERE month LIKE '1996%') k,
               (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-12-01',
                                              INTERVAL 1 MONTH)) AS d) m) g
    LEFT JOIN counts c ON c.name = g.name AND c.month = g.month""", *MODEL, used=USED,
    counts="""SELECT month, name, count(*) AS cnt FROM used WHERE keyword_id = 1
              AND skill_type = 'soft_skill' GROUP BY ALL"""))
def month_spine_year_gaps(t):
    facets = Facets.of(keyword_id=1, skill_type="soft_skill")
    counts = tr.monthly_skill_counts(t, facets, ("name",))
    return tr.month_spine(counts, "name", continuous=False, year=1996)


@query("last_periods", with_roles("""
    SELECT month, skill_type, count(*) AS cnt FROM used
    WHERE month IN (SELECT DISTINCT month FROM used ORDER BY month DESC LIMIT 6) GROUP BY ALL""",
    *MODEL, used=USED))
def last_periods(t):
    return tr.last_periods(tr.monthly_skill_counts(t, Facets(), ("skill_type",)), "month", 6)


_CARD = "SELECT month, name, count(*) AS cnt FROM used WHERE skill_type = 'tech_stack' GROUP BY ALL"


@query("trend_card", with_roles("""
    SELECT name, months, mean_cnt, sum_cnt, max_cnt, first_cnt, last_cnt,
           CASE WHEN months >= 2 THEN CASE WHEN last_cnt > first_cnt THEN 'up' ELSE 'down' END END
               AS direction,
           CASE WHEN months >= 2 THEN abs(last_cnt - first_cnt) END AS change
    FROM (SELECT name, count(*) AS months, round(avg(cnt), 1) AS mean_cnt,
                 CAST(sum(cnt) AS BIGINT) AS sum_cnt, max(cnt) AS max_cnt,
                 arg_min(cnt, month) AS first_cnt, arg_max(cnt, month) AS last_cnt
          FROM counts GROUP BY name)""", *MODEL, used=USED, counts=_CARD))
def trend_card(t):
    facets = Facets.of(skill_type="tech_stack")
    return tr.trend_card(tr.monthly_skill_counts(t, facets, ("name",)), "name")


@query("first_last_window", with_roles("""
    SELECT name, month, cnt,
           first_value(cnt) OVER w AS first_cnt, last_value(cnt) OVER w AS last_cnt
    FROM counts WINDOW w AS (PARTITION BY name ORDER BY month
                             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    *MODEL, used=USED, counts=_CARD))
def first_last_window(t):
    facets = Facets.of(skill_type="tech_stack")
    counts = tr.monthly_skill_counts(t, facets, ("name",))
    return tr.with_first_last(counts, "name").select("name", "month", "cnt", "first_cnt", "last_cnt")


def _period(year: int) -> str:
    return f"""SELECT s.name, count(*) AS cnt
        FROM job_skills js JOIN skills s ON s.id = js.skill_id JOIN postings p ON p.id = js.job_id
        WHERE year(p.posted_date) = {year} GROUP BY s.name ORDER BY cnt DESC, s.name LIMIT 60"""


@query("period_compare", with_roles("""
    SELECT a.name AS name_before, a.cnt AS cnt_before, b.name AS name_after, b.cnt AS cnt_after,
           CASE WHEN a.name IS NULL THEN 'NEW' WHEN b.name IS NULL THEN 'OUT' ELSE 'TETAP' END AS status
    FROM a FULL OUTER JOIN b ON lower(a.name) = lower(b.name)""",
    *MODEL, a=_period(1996), b=_period(1999)))
def period_compare(t):
    order = [F.desc("cnt"), F.asc("name")]
    before = top_n(tr.period_counts(t, Facets.of(year=1996)), order, 60)
    after = top_n(tr.period_counts(t, Facets.of(year=1999)), order, 60)
    return tr.compare_periods(before, after)


@query("month_labels", with_roles("""
    SELECT strftime(posted_date, '%Y-%m') AS month, strftime(posted_date, '%b %Y') AS label,
           count(*) AS cnt FROM postings GROUP BY ALL""", "postings"))
def month_labels(t):
    months = t.postings.groupBy(tr.month_key().alias("month")).agg(F.count(F.lit(1)).alias("cnt"))
    return months.select("month", tr.month_label(F.col("month")).alias("label"), "cnt")
