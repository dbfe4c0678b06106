"""The operators on job-posting tables in their own shape."""

import datetime as dt

import pytest

from skillweft.operators import facet_lists, matcher, network, rankings, skilltext, trends
from skillweft.operators.facets import Facets
from skillweft.tables import SCHEMAS, Tables

NOW = dt.datetime(2024, 5, 1, 8, 0)


def day(text):
    return dt.date.fromisoformat(text) if text else None


ROWS = {
    "keywords": [(1, "Data Engineer", NOW), (2, "Data Analyst", NOW), (3, "Unused", NOW)],
    "jobs": [
        (1, 1, "Data Engineer", "Acme", "Bandung", day("2024-01-10"), "x", "l1", "", "completed", NOW, "u1", "11-50"),
        (2, 1, "Data Engineer", "Acme", None, day("2024-02-10"), "x", "l2", "", "pending", NOW, None, "11-50"),
        (3, 2, "Data Analyst", "", "Bogor", day("2024-02-20"), "x", "l3", "", "pending", NOW, None, None),
        (4, 2, "Analyst", "N/A", "Bogor", day(None), "x", "l4", "", "pending", NOW, None, "1-10"),
    ],
    "skill_types": [(7, "tech_stack", "", NOW), (5, "technical_skill", "", NOW), (9, "soft_skill", "", NOW)],
    "skills": [(1, 7, "Python", "python", NOW), (2, 7, "SQL", "sql", NOW), (3, 9, "Python", "python", NOW), (4, 5, "ETL", "etl", NOW)],
    "job_skills": [(1, 1, 1, NOW), (2, 1, 2, NOW), (3, 2, 1, NOW), (4, 2, 3, NOW), (5, 3, 2, NOW), (6, 3, 4, NOW)],
    "job_analysis": [
        (1, 1, "t", "Acme", "Bandung", day("2024-01-10"), "l1", "", "Data Engineer", "Python, SQL", "['ETL', 'R']", None, NOW, "m"),
        (2, 1, "t", "Acme", "Bandung", day("2024-01-10"), "l1", "", "Data Engineer", "Python", None, "", NOW, "m"),
        (3, 3, "t", "", "Bogor", day("2024-02-20"), "l3", "", "Data Analyst", "SQL", "ETL", "Teamwork", NOW, "m"),
    ],
    "company_enrichment": [(1, "Acme", "u1", "11-50", "acme", "seed", NOW, NOW)],
}


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("model")
    for name, rows in ROWS.items():
        spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.parquet(f"{folder}/{name}")
    return Tables.from_folder(spark, str(folder))


def test_top_by_type_counts_jobs(t):
    got = rankings.top_by_type(t, Facets.of(skill_type="tech_stack", year=2024), 10).collect()
    assert [(r.rank, r.skill_name, r.job_count, r.total_jobs, r.percentage) for r in got] == [
        (1, "Python", 2, 3, 66.7), (2, "SQL", 2, 3, 66.7)]


def test_location_facet_and_fanout(t):
    once = rankings.top_skills(t, Facets.of(location="Bandung")).collect()
    twice = rankings.top_skills(t, Facets.of(location="Bandung", fanout=True)).collect()
    assert [r.cnt for r in once] == [1, 1] and [r.cnt for r in twice] == [2, 2]


def test_company_and_keyword_facets(t):
    got = rankings.top_skills_ranked(t, Facets.of(keyword="Data Engineer", company="Acme", employee_size="11-50"), 10).collect()
    assert [(r.name, r.skill_type, r.cnt, r.percentage) for r in got] == [
        ("Python", "tech_stack", 2, 50.0), ("Python", "soft_skill", 1, 25.0), ("SQL", "tech_stack", 1, 25.0)]


def test_distribution_keeps_empty_types(t):
    got = {r.skill_type: r for r in rankings.distribution(t, Facets.of(keyword_id=1), ("tech_stack", "technical_skill")).collect()}
    assert (got["tech_stack"].total, got["tech_stack"].percentage) == (3, 100.0)
    assert (got["technical_skill"].total, got["technical_skill"].top_skills) == (0, None)


def test_undated_jobs_have_no_month(t):
    got = {(r.month, r.name): r.cnt for r in trends.monthly_skill_counts(t, Facets()).collect()}
    assert got[("2024-02", "SQL")] == 1 and {m for m, _ in got} == {"2024-01", "2024-02"}


def test_companies_skip_blanks_but_count_them(t):
    got = rankings.top_companies(t, "sql", Facets()).collect()
    assert [(r.company, r.job_count, r.percentage) for r in got] == [("Acme", 1, 50.0)]


def test_network_excludes_the_seed_by_id(t):
    links = network.neighbours(t, "python", Facets())
    assert {(r.source, r.target, r.weight) for r in links.collect()} == {("Python", "SQL", 1), ("Python", "Python", 1)}
    by_name = network.neighbours(t, "python", Facets(), exclude_by="name")
    assert [r.target for r in by_name.collect()] == ["SQL"]
    nodes = {r.id: r.frequency for r in network.node_frequencies(t, "python", links, Facets()).collect()}
    assert nodes == {"Python": 3, "SQL": 2}


def test_overview_keeps_unused_keywords(t):
    got = {r.keyword: r for r in rankings.keyword_overview(t.postings, t.job_skills, t.keywords).collect()}
    assert (got["Data Engineer"].completed_jobs, got["Data Analyst"].completed_jobs, got["Data Analyst"].extraction_rate) == (2, 1, 50.0)
    assert (got["Unused"].total_jobs, got["Unused"].latest_job_title) == (0, None)


def test_text_columns(t):
    got = {(r.skill_type, r.name): r.cnt for r in skilltext.token_counts(t.job_analysis, Facets()).collect()}
    assert got == {("tech_stack", "Python"): 2, ("tech_stack", "SQL"): 2, ("technical_skill", "ETL"): 2, ("soft_skill", "Teamwork"): 1}
    top = skilltext.top_tokens(t.job_analysis, "tech_stack", Facets.of(employee_size="11-50"), 5).collect()
    assert [(r.token, r.cnt, r.total_jobs) for r in top] == [("Python", 1, 2), ("Python, SQL", 1, 2)]


def test_filter_options(t):
    got = {(r.facet, r.value): r.cnt for r in facet_lists.filter_options(t).collect()}
    assert got[("company", "Acme")] == 2 and ("company", "") not in got and got[("year", "2024")] == 3
    assert got[("city", "Bandung")] == 2 and ("keyword", "Unused") not in got


def test_matcher_with_size_and_type(t, spark):
    targets = spark.createDataFrame([(1, "Data Engineer", "11-50", "all"), (2, "Analyst", "", "technical_skill"), (3, "zzz", None, None)],
                                    "target_id int, title string, employee_size string, skill_type string")
    got = {(r.target_id, r.norm): (r.demand, r.total_jobs) for r in
           matcher.demand(targets, t.postings, t.keywords, t.job_skills, t.skills).collect()}
    assert got == {(1, "python"): (2, 2), (1, "sql"): (1, 2), (2, "etl"): (1, 2)}
