"""Leader clustering against a plain loop over the names."""

import random

import pytest
from pyspark.sql import functions as F

from skillweft.functions.similarity import skill_score
from skillweft.operators import resolve as rs
from skillweft.operators.leaders import lead

VARIANTS = "category string, canonical string, variant string, seq int"


def loop(order, score):
    """name -> leader, one after another; ``score(a, b)`` of a later and an earlier name, 0 if unlike."""
    leaders, joined = [], {}
    for name in order:
        best = max(((score(name, other), -place, other) for place, other in enumerate(leaders)), default=(0, 0, None))
        if best[0] > 0:
            joined[name] = best[2]
        else:
            leaders.append(name)
            joined[name] = name
    return joined


@pytest.mark.parametrize("seed,density", [(1, 0.03), (2, 0.15), (3, 0.6)])
def test_rounds_equal_the_loop(spark, seed, density):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(70)]
    rng.shuffle(names)
    rank = {name: i for i, name in enumerate(names, 1)}
    pairs = {(b, a): rng.choice([85.0, 90.0, 95.5]) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < density}
    groups = [(name, f"g{rng.randrange(25)}") for name in names for _ in range(rng.choice([0, 0, 1, 2]))]
    keys = {name: {g for n, g in groups if n == name} for name in names}
    got = lead(
        spark.createDataFrame(list(rank.items()), "node string, rank bigint"),
        spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "later string, earlier string, score double"),
        spark.createDataFrame(groups, "node string, key string"),
    )
    want = loop(names, lambda a, b: 100.0 if keys[a] & keys[b] else pairs.get((a, b), 0))
    assert {r.node: r.leader for r in got.collect()} == want


def test_a_chain_settles_and_nothing_is_left_out(spark):
    """Each name resembles the one before only: every second one leads."""
    nodes = spark.createDataFrame([(f"c{i}", i) for i in range(9)], "node string, rank bigint")
    pairs = spark.createDataFrame([(f"c{i}", f"c{i - 1}", 90.0) for i in range(1, 9)], "later string, earlier string, score double")
    none = spark.createDataFrame([], "node string, key string")
    got = {r.node: r.leader for r in lead(nodes, pairs, none).collect()}
    assert got == {f"c{i}": f"c{i - i % 2}" for i in range(9)}
    assert lead(nodes.limit(0), pairs.limit(0), none).collect() == []


def spellings(rng):
    roots = ["graph databases", "stream processing", "quantum knitting", "data lineage", "feature stores", "graph database"]
    out = []
    for _ in range(60):
        text = list(rng.choice(roots))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice(["", "x", text[at] * 2])
        out.append("".join(text).strip())
    return list(dict.fromkeys(out))


def test_near_spellings_of_one_batch_become_one_skill(spark):
    """Links equal those of a loop that stores each new skill before the next name comes."""
    names = spellings(random.Random(5))
    variants = spark.createDataFrame([("tech_stack", "Python", "python", 0)], VARIANTS)
    known = spark.createDataFrame([(3, "Python", "python", "tech_stack")], "id bigint, name string, normalized_name string, skill_type string")
    empty = {"technical_skill": [], "soft_skill": []}
    replies = spark.createDataFrame(
        [(job, {"tech_stack": [name, "Python"], **empty}, f"Uses {name} and python daily") for job, name in enumerate(names)],
        "job_id bigint, skills struct<tech_stack:array<string>,technical_skill:array<string>,soft_skill:array<string>>, job_description string")
    found = rs.resolve_replies(replies, known, variants)
    norms = {r.skill: r.norm for r in found["matches"].filter("action = 'insert_new'").collect()}
    order = list(dict.fromkeys(norms[n] for n in names if n in norms))
    want = loop(order, lambda a, b: s if (s := skill_score(a, b, 85.0)) >= 85 else 0)
    stored = {r.id: r.normalized_name for r in found["new_skills"].collect()}
    assert sorted(stored.values()) == sorted(set(want.values())) and len(set(want.values())) < len(order) / 2
    links = {(r.job_id, stored[r.skill_id]) for r in found["links"].collect() if r.skill_id != 3}
    assert links == {(job, want[norms[name]]) for job, name in enumerate(names) if name in norms}


def test_shared_inputs_of_a_resolution_are_read_once(spark):
    """The dictionary and the known skills feed many joins; their rows are worked out a single time."""
    reads = {name: spark.sparkContext.accumulator(0) for name in ("variants", "known")}

    def counted(rows, name):
        count = reads[name]

        def read(text):
            count.add(1)
            return text

        return rows.withColumn(rows.columns[1], F.udf(read, "string")(F.col(rows.columns[1])))

    variants = counted(spark.createDataFrame([("tech_stack", "Python", "python", 0)], VARIANTS), "variants")
    known = counted(spark.createDataFrame(
        [(3, "Python", "python", "tech_stack")], "id bigint, name string, normalized_name string, skill_type string"), "known")
    replies = spark.createDataFrame(
        [(1, {"tech_stack": ["pytohn", "Python", "Rust"], "technical_skill": [], "soft_skill": []}, "pytohn, python and rust")],
        "job_id bigint, skills struct<tech_stack:array<string>,technical_skill:array<string>,soft_skill:array<string>>, job_description string")
    found = rs.resolve_replies(replies, known, variants)
    assert found["links"].count() == 3 - (found["matches"].filter("skill = 'pytohn' and matched_id = 3").count())
    assert [r.tech_stack for r in found["lists"].collect()] == ["Python, Rust, pytohn"]
    assert {name: count.value for name, count in reads.items()} == {"variants": 1, "known": 1}
