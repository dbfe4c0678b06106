"""Title, skill, reply and size expressions on small inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skillweft.dictionaries import SKILL_ALIASES
from skillweft.functions import replies as rp
from skillweft.functions import sizes as sz
from skillweft.functions import skills as sk
from skillweft.functions import text as tx
from skillweft.functions import titles as ti
from skillweft.operators.containment import whole_word_phrases


def apply(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_title(spark):
    titles = ["Senior Data Scientist - Remote (Contract)", "Junior Machine Learning Engineer (Full Time)",
              "Lead AI  Engineer [Bandung]", "ml engineer, Remote", "Sr Data-Driven bi analyst", None, "(Senior) Data"]
    want = ["Data Scientist", "Machine Learning Engineer", "AI Engineer", "ML Engineer", "Data-driven BI Analyst", "", "Data"]
    assert apply(spark, titles, ti.clean_title) == want
    assert [ti.clean_title_text(t) for t in titles if t] == [w for t, w in zip(titles, want) if t]


def test_excluded_and_roles(spark):
    titles = ["Backend Engineer", "Data Backend", "Data Engineer", "Chronic hr lead", "Databackend", "Sales Data Analyst"]
    assert apply(spark, titles, ti.is_excluded) == [True, True, False, True, False, True]
    assert apply(spark, titles, ti.is_target_role) == [False, False, True, False, False, False]


def test_normalize_skill(spark):
    skills = ["  Kemampuan Komunikasi yang baik ", "CI/CD", "Node.js", "(C++)", "problem-solving", "A,  B - C", "",
              None, "ünïté R&D", "C#", "berpikir kritis"]
    want = ["communication", "ci cd", "node.js", "c++", "problem solving", "a b   c", "", "", "ünïté rd", "c#",
            "critical thinking"]
    assert apply(spark, skills, sk.normalize_skill) == want


def test_normalize_skill_is_stable(spark):
    skills = ["CI/CD", "Data-Analysis", "  x  y ", "R&D / Ops", "a, b"]
    once = apply(spark, skills, sk.normalize_skill)
    collapsed = [" ".join(s.split()) for s in once]
    assert [" ".join(s.split()) for s in apply(spark, once, sk.normalize_skill)] == collapsed


def test_classify_and_synonyms(spark):
    assert apply(spark, ["Data", "Team communication", "spark", "", " ML "], sk.classify) == [
        "GENERIC", "Soft Skill", "unknown", "unknown", "GENERIC"]
    assert apply(spark, ["sklearn", "strong komunikasi", "zzz"], sk.synonym) == ["scikit-learn", "communication", None]
    assert apply(spark, ["golang", "strong komunikasi"], lambda c: sk.synonym(c, loose=False)) == ["go", None]


def test_reclassify_keeps_first(spark):
    reply = {"tech_stack": ["Python", "python", "SQL"], "technical_skill": ["Team-Work ability", "Data Mining", "data mining"],
             "soft_skill": ["Leadership"]}
    row = spark.createDataFrame([(reply,)], f"s {rp.SKILL_LISTS}").select(sk.reclassify(F.col("s")).alias("s")).first().s
    assert row.asDict() == {"tech_stack": ["Python", "SQL"], "technical_skill": ["Data Mining"],
                            "soft_skill": ["Leadership", "Team-Work ability"]}


def test_grounding(spark):
    text = "We use Python programming, ML and C++ on html pages. CI/CD pipelines."
    skills = {"tech_stack": ["Python", "ml", "C++", "tm", "Java"], "soft_skill": ["Leadership"],
              "technical_skill": ["Machine Learning", "Deep Learning", "Python Programming Guru", "Python Golang Rust"]}
    row = spark.createDataFrame([(skills, text)], f"s {rp.SKILL_LISTS}, t string").select(
        sk.keep_grounded(F.col("s"), F.col("t")).alias("s")).first().s
    assert row.tech_stack == ["Python", "ml", "C++"]
    assert row.technical_skill == ["Machine Learning", "Python Programming Guru"]
    assert row.soft_skill == ["Leadership"]


def test_replies(spark):
    replies = ['```json\n{"tech_stack": ["a"], "soft_skill": null}\n```', 'Sure: {"technical_skill": ["b"]} done',
               "{broken", "", None, "no json"]
    got = apply(spark, replies, rp.parse_reply)
    assert got[0].asDict() == {"tech_stack": ["a"], "technical_skill": [], "soft_skill": []}
    assert got[1].technical_skill == ["b"]
    assert got[2:] == [None] * 4


def test_batch_reply(spark):
    jobs = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 20)], "batch_id int, job_id bigint")
    replies = spark.createDataFrame(
        [(1, 'x {"10": {"tech_stack": ["a"]}, "11": "oops"} y'), (2, '{"20": {"tech_stack": ["a"]')], "batch_id int, reply string")
    got = {r.job_id: r.skills.tech_stack for r in rp.parse_batch_reply(jobs, replies).collect()}
    assert got == {10: ["a"], 11: [], 12: [], 20: []}


def test_parse_skill_text(spark):
    assert apply(spark, ["['a', ' b']", "x, y ,z"], sk.parse_skill_text) == [["a", " b"], ["x", "y", "z"]]
    assert apply(spark, ["x, y"], lambda c: sk.parse_skill_text(c, scalar=True)) == [["x, y"]]


@pytest.mark.parametrize("text, want", [
    ("51-200", "51-200"), ("501–1000", "501-1,000"), ("1,001 to 5,000", "1,001-5,000"), ("less than 50 people", "11-50"),
    ("10.001+", "10,001+"), ("750", "501-1,000"), ("0", None), ("none", None), ("25-100", "11-50"),
])
def test_normalize_size(spark, text, want):
    assert apply(spark, [text], sz.normalize_size) == [want]


def test_sizes(spark):
    assert apply(spark, [0, 10, 11, 10001, -1, None], sz.size_label, "bigint") == ["1-10", "1-10", "11-50", "10001+", None, None]
    texts = ["Acme has 5,200 employees", "Company size: 51-200", '"numberOfEmployees": "1,200"', "201 to 500 staff", "nothing"]
    assert apply(spark, texts, sz.size_from_text) == ["5,001-10,000", "51-200", "1,001-5,000", "201-500", None]
    # numbers without separators are read three digits at a time: 5000 gives 500 and 0
    texts = ["5rb - 10rb karyawan", "1.000 - 5.000", "1-50", ""]
    assert apply(spark, texts, sz.largest_number_label) == ["201-500", "1,001-5,000", "11-50", None]
    assert apply(spark, ["501-1,000", "501-1000", "x"], sz.size_order) == [5, 5, None]
    row = spark.range(1).select(
        sz.range_label(F.lit(501), F.lit(1000)).alias("a"), sz.range_label(F.lit(3), F.lit(None).cast("int")).alias("b"),
        sz.range_label(F.lit(0), F.lit(10)).alias("c")).first()
    assert tuple(row) == ("501-1000", "10001+", "1-10")


def test_small_texts(spark):
    assert apply(spark, ["toli-toli utara", "DKI JAKARTA"], tx.title_case) == ["Toli-Toli Utara", "Dki Jakarta"]
    assert apply(spark, ["Bogor (12)", "Bogor (x)"], tx.strip_count) == ["Bogor", "Bogor (x)"]
    assert apply(spark, [45.0, 200.0, 7500.0], tx.format_duration, "double") == ["45s", "3m 20s", "2h 5m"]


def test_whole_word_phrases_equal_a_regex_per_pair(spark):
    """Every pair tested with the boundaries as written: inner gaps, odd ends, letters of other scripts, repeats."""
    rng = random.Random(9)
    words = ["data", "big", "c", "é", "Kota", "x1", "日本", "data_x", "a"]
    gaps = [" ", "  ", "-", ", ", "\n", "+", "."]
    text = lambda n: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n))
    texts = [text(rng.randrange(12)) for _ in range(80)] + ["", " ", "c++", "c++ and c", "...", None]
    phrases = [text(rng.randrange(1, 4))[: rng.choice([None, -1])] for _ in range(150)] + ["c++", "data", "big data", "", "+", "kota"]
    got = whole_word_phrases(
        spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    want = {
        (t, p) for t in texts if t is not None for p in phrases
        if re.search(rf"\b{re.escape(p)}\b", t) and re.search(r"\w", p)
    }
    rows = [(r.text, r.phrase) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 100


def test_wide_rows_are_read_in_place_where_there_are_splits_enough(spark, tmp_path):
    from skillweft.sources.readers import spread_scan

    cores = spark.sparkContext.defaultParallelism
    for files, moved in ((cores, False), (1, True)):
        path = str(tmp_path / str(files))
        spark.range(100).withColumn("html", F.lit("x")).repartition(files).write.parquet(path)
        key = "spark.sql.files.openCostInBytes"
        before = spark.conf.get(key)
        spark.conf.set(key, spark.conf.get("spark.sql.files.maxPartitionBytes"))  # a split for every file
        try:
            plan = spread_scan(spark.read.parquet(path), "id")._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set(key, before)
        assert ("Exchange" in plan) == moved


def test_numbers_meet_on_long_pieces(spark):
    """Phrases of digits share short pieces with most texts; each is compared with few."""
    from skillweft.operators import containment as ct

    texts = spark.range(2000).select(F.format_string("firm %09d", "id").alias("text"))
    phrases = spark.range(0, 4000, 40).select(F.format_string("%09d", "id").alias("phrase"))
    keys = ct._own_pieces(F.col("phrase"))
    pairs = ct._anchored(texts, ct.pieces(F.col("text"), (8,)), phrases, keys)
    assert pairs.count() < 1000
    found = {(r.text, r.phrase) for r in ct.contained_phrases(texts, phrases).collect()}
    assert found == {(f"firm {i:09d}", f"{i:09d}") for i in range(0, 2000, 40)}


def test_long_and_short_words_are_found_in_either_way(spark, monkeypatch):
    from skillweft.operators import containment as ct

    texts = ["a data engineer of machine learning", "extraordinarily-long-word-here x", "b"]
    phrases = ["engineer data", "extraordinarily-long-word", "a", "b", "machine zz", "x extra", "\u4e16"]
    want = {(t, p) for t in texts for p in phrases if all(w in t for w in p.split())}
    for few in (ct.FEW, 0):
        monkeypatch.setattr(ct, "FEW", few)
        found = ct.contained_words(spark.createDataFrame([(t,) for t in texts], "text string"),
                                   spark.createDataFrame([(p,) for p in phrases], "phrase string"))
        assert {(r.text, r.phrase) for r in found.collect()} == want


def test_list_expressions_are_worked_out_once(spark):
    """No lambda holds the expression of a whole list or text, which it would work out for every entry."""
    row = spark.createDataFrame(
        [(["Team Work", "sql", "SQL", "", "rust"], "We use SQL, and Team-Work.")], "skills array<string>, source string")
    kept = lambda items: sk.dedup_keep_first(F.filter(items, lambda s: ~sk.looks_soft(s)))
    lists = F.struct(F.col("skills").alias("tech_stack"), kept(F.col("skills")).alias("technical_skill"), F.col("skills").alias("soft_skill"))
    both = row.select(sk.keep_grounded(lists, F.col("source")).alias("s"))
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("source#") <= 3 and plan.count("RLIKE \\\\Q") <= 1
    got = both.first().s
    assert got.tech_stack == ["Team Work", "sql", "SQL"] and got.technical_skill == ["sql"]


def test_reply_of_nulls_and_broken_replies(spark):
    replies = ['```json\nx {"tech_stack": ["a", null], "soft_skill": null} y```', "{broken", None, "no object", "{}"]
    got = apply(spark, replies, rp.parse_reply)
    assert [None if g is None else tuple(g) for g in got] == [(["a", None], [], []), None, None, None, ([], [], [])]


def test_entries_are_grounded_like_a_search_of_the_text(spark):
    """Single words are looked up among the text's words, all other entries by their letters."""
    rng, letters = random.Random(4), ["a", "b", "ml", "1", "é", "+", ".", "-", " ", " ", "'", "K"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(150)] + [None, "", "Machine-Learning js"]
    skills = ["".join(rng.choices(letters, k=rng.randint(0, 5))) for _ in range(60)] + [None, "machine learning", "javascript", "ml k1 K"]

    def light(s):
        return re.sub(r"\s+", " ", s.lower().replace("-", " ")).strip(" ")

    def token(text, word):
        return word != "" and re.search(rf"(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])", text) is not None

    def wanted(skill, text):
        key, text, words = light(skill), light(text or ""), [w for w in light(skill).split(" ") if len(w) >= 3]
        short = dict(SKILL_ALIASES).get(key, [])
        return key != "" and (token(text, key) or any(token(text, a) for a in short)
                              or bool(words) and sum(token(text, w) for w in words) >= 0.6 * len(words))

    rows = spark.createDataFrame([(t, skills) for t in texts], "t string, s array<string>")
    lists = F.struct(F.col("s").alias("tech_stack"), F.col("s").alias("technical_skill"), F.col("s").alias("soft_skill"))
    for row in rows.select("t", sk.keep_grounded(lists, F.col("t")).alias("k")).collect():
        assert row.k.tech_stack == row.k.technical_skill == [s for s in skills if s is not None and wanted(s, row.t)], row.t
    plan = rows.select(sk.keep_grounded(lists, F.col("t")).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert r"\A[a-z0-9]+\z" in plan  # no pattern is built for a single word
