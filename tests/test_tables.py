"""Rewrites, ordering, facets and resolution on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skillweft.operators import fuzzy, lookups, ordering, rewrite, trends
from skillweft.operators import resolve as rs
from skillweft.operators.facets import Facets, date_predicate, filter_rows
from skillweft.operators.matcher import match_details, match_scores
from skillweft.operators.titles import match_keyword
from skillweft.sources import readers, writers


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_upsert_keeps_old_size_for_blank_new_one(spark):
    old = spark.createDataFrame([("a", "1-10", "s", 1), ("b", "11-50", "s", 2)], "k string, size string, slug string, n int")
    new = spark.createDataFrame([("a", "", None), ("c", "x", "y")], "k string, size string, slug string")
    got = rows(rewrite.upsert(old, new, "k", ["slug"], ["size"]))
    assert got == [("a", "1-10", None, 1), ("b", "11-50", "s", 2), ("c", "x", "y", None)]


def test_append_and_seed_are_idempotent(spark):
    old = spark.createDataFrame([("a", 1)], "k string, n int")
    new = spark.createDataFrame([("a", 5), ("b", 3), ("b", 2)], "k string, n int")
    assert rows(rewrite.append_absent(old, new, "k", F.col("n"))) == [("b", 2)]
    once = rewrite.seed(old, new, "k")
    assert once.count() == rewrite.seed(once, new, "k").count() == 2


def test_repeated_update_keys_do_not_multiply_rows(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "a", None)], "id int, k string, v string")
    new = spark.createDataFrame([("a", "p"), ("a", "q")], "k string, v string")
    assert rows(rewrite.update_by_key(old, new, "k", "v")) == [(1, "a", "q"), (2, "a", "q")]
    assert rows(rewrite.update_by_key(old, new, "k", "v", only_null=True)) == [(1, "a", "x"), (2, "a", "q")]


def test_patch_and_delete(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, a string, b string")
    patches = spark.createDataFrame([(1, None, "z")], "id int, a string, b string")
    assert rows(rewrite.patch(old, patches, "id")) == [(1, "a", "z"), (2, "b", "y")]
    keys = spark.createDataFrame([(1,)], "id int")
    links = spark.createDataFrame([(1, 5), (2, 5)], "job_id int, skill_id int")
    left = rewrite.delete_jobs({"jobs": old, "job_skills": links, "job_analysis": links}, keys)
    assert rows(left["jobs"], "id") == [(2,)] and rows(left["job_skills"]) == [(2, 5)]


@pytest.mark.parametrize("n", [1, 37, 500])
def test_number_all_is_the_position(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % 101).alias("k"), "id")
    got = ordering.number_all(df, [F.desc("k"), F.asc("id")], "no").collect()
    want = sorted(((r.k, r.id) for r in got), key=lambda p: (-p[0], p[1]))
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r.no)] == want
    assert sorted(r.no for r in got) == list(range(1, n + 1))


def test_unlimited_rank_per_group(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), "id")
    got = ordering.top_per_group(df, ["g"], [F.desc("id")], None).collect()
    for g in range(3):
        mine = sorted((r for r in got if r.g == g), key=lambda r: -r.id)
        assert [r.rank for r in mine] == list(range(1, 101))


def test_sort_keys(spark):
    df = spark.createDataFrame([("10,001+",), ("51-200",), ("x",), (None,)], "s string")
    got = [r.k for r in df.select(ordering.first_number("s").alias("k")).collect()]
    assert got == [10, 51, 999999, 999999]


def test_facets_skip_falsy_and_split_lists():
    assert Facets.of(keyword_id="1, 2,,", location="", month=0, multi=True) == Facets(keyword_ids=(1, 2))
    assert Facets.of(month=13, year=1800, guarded=True) == Facets()
    assert not Facets.of(skill_type="x").touches_jobs()


def test_month_and_year_become_ranges(spark):
    df = spark.createDataFrame([(dt.date(2023, 12, 31),), (dt.date(2024, 2, 29),), (dt.date(2024, 3, 1),), (None,)], "posted_date date")
    assert filter_rows(df, Facets.of(year=2024, month=2)).count() == 1
    assert filter_rows(df, Facets.of(year="2023,2024", month="12,3")).count() == 2
    assert date_predicate("posted_date", (), ()) is None


def test_fallback_stage(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "bcd"), (3, "x")], "id int, t string")
    stages = [F.contains("t", F.lit("zzz")), F.contains("t", F.lit("bc")), F.lit(True)]
    assert rows(lookups.first_stage_only(df, stages), "id", "stage") == [(1, 2), (2, 2)]


def test_blank_analysis_counts_nulls(spark):
    jobs = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    analysis = spark.createDataFrame([(1, "", "", ""), (2, None, "", " "), (3, "x", "", "")],
                                     "job_id int, tech_stack string, technical_skill string, soft_skill string")
    assert rows(lookups.blank_analysis_jobs(jobs, analysis)) == [(1,), (2,)]
    assert rows(lookups.blank_analysis_jobs(jobs, analysis, nulls_count=False)) == [(1,)]


def test_month_spine_fills_gaps(spark):
    df = spark.createDataFrame([("a", "2024-01", 2), ("a", "2024-03", 1), ("b", "2023-01", 5)], "k string, month string, cnt bigint")
    filled = trends.month_spine(df, "k").collect()
    assert len(filled) == 24 and sum(r.cnt for r in filled if r.k == "a") == 3
    gaps = trends.month_spine(df, "k", continuous=False).collect()
    assert {r.k for r in gaps} == {"a"} and sum(r.cnt is None for r in gaps) == 10
    year = trends.month_spine(df, "k", year=2024, today=dt.date(2024, 5, 9)).collect()
    assert sorted({r.month for r in year}) == [f"2024-0{m}" for m in range(1, 6)]


def test_compare_periods_ignores_case(spark):
    a = spark.createDataFrame([("SQL", 3), ("R", 1)], "name string, cnt bigint")
    b = spark.createDataFrame([("sql", 4), ("Go", 2)], "name string, cnt bigint")
    assert {(r.name_before, r.name_after): r.status for r in trends.compare_periods(a, b).collect()} == {
        ("SQL", "sql"): "TETAP", ("R", None): "OUT", (None, "Go"): "NEW"}


def test_keyword_match_prefers_the_longest(spark):
    titles = spark.createDataFrame([("Big Data Engineer",), ("Engineering of data",), ("Cook",), (None,)], "job_title string")
    keywords = spark.createDataFrame([(1, "Data"), (2, "Data Engineer"), (3, "x y z")], "id int, keyword string")
    got = {r.job_title: r.matched_id for r in match_keyword(titles, keywords).collect()}
    assert got == {"Big Data Engineer": 2, "Engineering of data": 2, "Cook": None, None: None}


VARIANTS = [("tech_stack", "Python", "python", 1), ("tech_stack", "Python", "python dev", 2), ("tech_stack", "C#", "dotnet", 3),
            ("tech_stack", ".NET", "dotnet", 4), ("technical_skill", "Machine Learning", "machine learning", 5),
            ("soft_skill", "Teamwork", "teamwork", 6), ("tech_stack", "Scikit-learn", "scikit-learn", 7)]
KNOWN = [(1, "Python", "python", "tech_stack"), (2, "Machine Learning", "machine learning", "technical_skill"),
         (3, "communication", "communication", "soft_skill"), (4, "data warehouse design", "data warehouse design", "technical_skill"),
         (5, "data visualization", "data visualization", "technical_skill")]


@pytest.fixture(scope="module")
def model(spark):
    return (spark.createDataFrame(KNOWN, "id int, name string, normalized_name string, skill_type string"),
            spark.createDataFrame(VARIANTS, "category string, canonical string, variant string, seq int"))


def test_canonical_first_and_last(spark, model):
    _, variants = model
    df = spark.createDataFrame([("dotnet", "tech_stack"), ("ML", "soft_skill"), ("zzz", None)], "skill string, skill_type string")
    got = {r.skill: (r.canonical, r.found) for r in rs.with_canonical(df, variants).collect()}
    assert got == {"dotnet": ("C#", True), "ML": ("Machine Learning", True), "zzz": ("zzz", False)}
    lookup = {r.norm: r.canonical for r in rs.canonical_lookup(variants).collect()}
    assert lookup["dotnet"] == ".NET" and lookup["py"] == "Python" and lookup["scikit learn"] == "Scikit-learn"


def test_match_cascade(spark, model):
    known, variants = model
    asked = [("cloud",), ("Python Dev",), ("kemampuan komunikasi",), ("data warehouse desing",), ("Quantum Knitting",), ("teamwork",), ("dataviz",)]
    raw = spark.createDataFrame(asked, "skill string").withColumn("skill_type", F.lit("tech_stack"))
    got = {r.skill: r for r in rs.match_skills(raw, known, variants).collect()}
    assert (got["cloud"].method, got["cloud"].action) == ("generic", "rejected")
    assert (got["Python Dev"].method, got["Python Dev"].matched_id) == ("canonical", 1)
    assert (got["kemampuan komunikasi"].method, got["kemampuan komunikasi"].matched_id) == ("canonical", 3)
    assert (got["dataviz"].method, got["dataviz"].matched_id) == ("synonym", 5)
    assert got["data warehouse desing"].matched_id == 4 and got["data warehouse desing"].score >= 85
    assert (got["Quantum Knitting"].action, got["Quantum Knitting"].final_type) == ("insert_new", "tech_stack")
    assert (got["teamwork"].method, got["teamwork"].final_type) == ("new", "soft_skill")


def test_replies_to_links(spark, model):
    known, variants = model
    skills = {"tech_stack": ["Python", "python", "Quantum Knitting"], "technical_skill": ["Teamwork spirit"], "soft_skill": []}
    replies = spark.createDataFrame([(7, skills, "We do python and quantum knitting")],
                                    "job_id bigint, skills struct<tech_stack:array<string>,technical_skill:array<string>,soft_skill:array<string>>, "
                                    "job_description string")
    out = rs.resolve_replies(replies, known, variants)
    added = {r.normalized_name: r.id for r in out["new_skills"].collect()}
    assert added == {"quantum knitting": 6, "teamwork spirit": 7}
    assert rows(out["links"]) == [(7, 1), (7, 6), (7, 7)]
    assert out["lists"].first().asDict() == {"job_id": 7, "tech_stack": "Python, Quantum Knitting", "technical_skill": None,
                                             "soft_skill": "Teamwork spirit"}


def test_merge_conserves_links(spark, model):
    _, variants = model
    skills = spark.createDataFrame([(1, "Data-Mining", "x", "tech_stack"), (2, "data mining", "x", "tech_stack"),
                                    (3, "python dev", "x", "tech_stack"), (4, "data mining", "x", "soft_skill")],
                                   "id int, name string, normalized_name string, skill_type string")
    links = spark.createDataFrame([(10, 1), (10, 2), (11, 2), (11, 3), (12, 4)], "job_id int, skill_id int")
    out = rs.merge_vocabulary(skills, links, variants)
    assert rows(out["links"]) == [(10, 1), (11, 1), (11, 3), (12, 4)]
    assert rows(out["skills"], "id", "name", "normalized_name") == [
        (1, "Data-Mining", "data mining"), (3, "Python", "python"), (4, "data mining", "data mining")]
    again = rs.merge_vocabulary(out["skills"], out["links"], variants)
    assert rows(again["links"]) == rows(out["links"]) and rows(again["skills"]) == rows(out["skills"])


def test_vocabulary_scores(spark):
    names = spark.createDataFrame([("sql server",), ("spark",), ("zzz",)], "text string")
    entries = spark.createDataFrame([("server sql",), ("sparks",), ("never",)], "text string")
    matches = fuzzy.best_vocabulary(names, entries, 80)
    got = fuzzy.evaluate_vocabulary(matches, names, entries).first()
    assert (got.tp, got.fp, got.fn) == (2, 1, 1) and got.f1 == pytest.approx(2 / 3)


def test_match_scores(spark):
    wanted = spark.createDataFrame([(1, "a", "A", 6, 10), (1, "b", "B", 2, 10)], "target_id int, norm string, name string, demand bigint, total_jobs bigint")
    requests = spark.createDataFrame([(1, 1), (2, 1), (3, 9)], "request_id int, target_id int")
    norms = spark.createDataFrame([(1, "a"), (1, "z")], "request_id int, norm string")
    got = {r.request_id: (r.match_score, r.matched, r.missing) for r in match_scores(requests, wanted, norms).collect()}
    assert got == {1: (75.0, 1, 1), 2: (0.0, 0, 2), 3: (0.0, 0, 0)}


def test_word_list_and_cache(spark, tmp_path):
    (tmp_path / "words.csv").write_text('sql\n"quoted"\ntoo,many\n\n  spark  \n')
    assert rows(readers.read_word_list(spark, str(tmp_path / "words.csv"))) == [('"quoted"',), ("spark",), ("sql",)]
    cache = spark.createDataFrame([("a", "1-10", "x", "2024-01-01T00:00:00"), ("b", "odd", "x", "2024-01-20T00:00:00"),
                                   ("c", "11-50", "x", "2024-01-02T00:00:01"), ("d", "1-10", "x", "never")],
                                  "key string, size string, company string, timestamp string")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    assert rows(readers.valid_cache_rows(cache, ["1-10", "11-50"], now), "key") == [("c",)]


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "x,y")], "k string, v string")
    writers.export_csv(df.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert sorted(text.split()) == ["a,", 'b,"x,y"', "k,v"]


def test_details_shuffle_no_listed_row(spark):
    requests = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (3, 11), (4, 12), (None, 10), (5, None)], "request_id int, target_id int")
    wanted = spark.createDataFrame(
        [(10, 8, "sql", "SQL", 4), (10, 8, "rust", "Rust", 2), (11, 3, "sql", "Sql", 0)],
        "target_id int, total_jobs int, norm string, name string, demand long")
    norms = spark.createDataFrame([(1, "sql"), (2, "java"), (3, "rust"), (None, "sql"), (9, "sql"), (1, None)], "request_id int, norm string")
    got = match_details(requests, wanted, norms)
    assert got.columns == ["request_id", "target_id", "norm", "name", "demand", "demand_pct", "contribution", "matched"]
    ten = lambda i, hit: [(i, 10, "sql", "SQL", 4, 50.0, 66.7, hit), (i, 10, "rust", "Rust", 2, 25.0, 33.3, False)]
    want = ten(1, True) * 2 + ten(2, False) + ten(None, False) + [(3, 11, "sql", "Sql", 0, 0.0, 0.0, False)]
    assert rows(got) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().optimizedPlan().toString()  # the lists are spread out behind all joins
    assert plan.index("explode(listed") < plan.index("Join")


def test_stored_keys_go_before_the_first_row_is_picked(spark):
    old = spark.createDataFrame([("a",), (None,)], "k string")
    new = spark.createDataFrame([("a", 5), ("b", 3), ("b", 2), (None, 7), (None, 6)], "k string, n int")
    added = rewrite.append_absent(old, new, "k", F.col("n"))
    assert rows(added) == [("b", 2), (None, 6)]
    assert rows(rewrite.append_absent(old, new, "k").select("k")) == [("b",), (None,)]
    plan = added._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join")
