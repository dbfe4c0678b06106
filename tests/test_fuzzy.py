"""The similarity joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from skillweft.functions import similarity as sim
from skillweft.operators import fuzzy


def slow_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def words(rng, n):
    syllables = ["da", "ta", "en", "gi", "neer", "ing", "s", "ql", "py", "thon", "r", "mo", "del", "a", "cloud"]
    out = set()
    while len(out) < n:
        size = rng.choice([1, 1, 2, 2, 3, 4])
        out.add(" ".join("".join(rng.choices(syllables, k=rng.choice([1, 2, 3]))) for _ in range(size)))
    return sorted(out)


def test_lcs_matches_table():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choices("abcd ", k=rng.randint(0, 12)))
        b = "".join(rng.choices("abcd ", k=rng.randint(0, 12)))
        assert sim.lcs_length(a, b) == slow_lcs(a, b)


@pytest.mark.parametrize("a, b, score", [
    ("sql", "sql server", 100.0),
    ("machine learning", "learning machine", 100.0),
    ("python", "pyhton", 100 * 10 / 12),
    ("", "x", 0.0),
])
def test_token_set(a, b, score):
    assert sim.token_set_ratio(a, b) == pytest.approx(score)


def test_partial_window():
    assert sim.partial_ratio("sql", "postgresql 14") == 100.0
    assert sim.partial_ratio("abcd", "xxabxcdxx") == 75.0


def test_candidates_lose_nothing(spark):
    rng = random.Random(7)
    pool = words(rng, 420)
    rng.shuffle(pool)
    raw, known = pool[:260], pool[200:]  # 60 texts on both sides
    a = spark.createDataFrame([(x,) for x in raw], "text string")
    b = spark.createDataFrame([(x,) for x in known], "text string")
    got = {(r.a, r.b) for r in fuzzy.candidates(a, b, 85).collect()}
    need = {(x, y) for x in raw for y in known if sim.skill_score(x, y, 85) >= 85}
    assert len(need) > 200
    assert need <= got
    assert len(got) < 0.7 * len(raw) * len(known)


@pytest.mark.parametrize("plain", [False, True])
def test_dealing_heavy_pieces_changes_no_candidate(spark, monkeypatch, plain):
    rng = random.Random(11)
    pool = [w + " data" for w in words(rng, 300)]
    a = spark.createDataFrame([(x,) for x in pool[:200]], "text string")
    b = spark.createDataFrame([(x,) for x in pool[100:]], "text string")
    found = []
    for heavy in (10**6, 4):
        monkeypatch.setattr(fuzzy, "HEAVY", heavy)
        found.append({(r.a, r.b) for r in fuzzy.candidates(a, b, 85, plain).collect()})
    score = (lambda x, y: sim.token_sort_ratio(x, y)) if plain else (lambda x, y: sim.skill_score(x, y, 85))
    need = {(x, y) for x in pool[:200] for y in pool[100:] if score(x, y) >= 85 and (not plain or slow_ratio(x, y) >= 85)}
    assert found[0] == found[1] and need <= found[1] and len(need) > 100


def slow_ratio(a, b):
    return 200 * slow_lcs(a, b) / (len(a) + len(b))


@pytest.mark.parametrize("plain", [False, True])
def test_a_frequent_piece_fills_no_key(spark, monkeypatch, plain):
    """Every text holds one piece; no key of the join gathers more than about ``HEAVY`` texts."""
    monkeypatch.setattr(fuzzy, "HEAVY", 50)
    rng = random.Random(13)
    texts = [f"{'x' * rng.randrange(1, 60)}{i}" for i in range(2000)]
    held = spark.createDataFrame([(t, "dat") for t in texts] + [("alone", "rar")], "other string, piece string")
    keys = spark.createDataFrame([("xxxx data", "dat"), ("rare", "rar")], "text string, piece string")
    frequency = held.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    asking, dealt = fuzzy.deal_heavy(keys, held, frequency, 80, plain)
    most = dealt.groupBy("piece", "salt", "band").count().agg(F.max("count")).first()[0]
    assert most < 2 * 50 and dealt.count() == 2001
    met = asking.join(dealt, ["piece", "salt", "band"]).select("text", "other").collect()
    reach = {t for t in texts if 200 * min(len(t), 9) >= 80 * (len(t) + 9)} if plain else set(texts)
    assert len(met) == len(set(met)) and reach <= {r.other for r in met if r.text == "xxxx data"}
    assert [r.other for r in met if r.text == "rare"] == ["alone"]
    if plain:
        assert len(met) < 0.7 * len(texts)


@pytest.mark.parametrize("threshold", [60, 80, 85, 95])
def test_similar_lengths_lie_in_neighbouring_bands(spark, threshold):
    lengths = spark.range(0, 400).select(F.col("id").alias("n"), fuzzy.length_band(F.col("id"), threshold).alias("band"))
    band = {r.n: r.band for r in lengths.collect()}
    for a in range(1, 400):
        for b in range(a, 400):
            if 200 * a >= threshold * (a + b):
                assert band[b] - band[a] <= 1


def test_repeated_word_is_found(spark):
    a = spark.createDataFrame([("aa aa aa aa",)], "text string")
    b = spark.createDataFrame([("aa aa aa aab",)], "text string")
    assert fuzzy.candidates(a, b, 85).count() == 1


def test_best_vocabulary_is_brute_force(spark):
    rng = random.Random(3)
    pool = words(rng, 300)
    names, vocabulary = pool[:120], [w[::-1] if i % 9 == 0 else " ".join(w.split()[::-1]) for i, w in enumerate(pool[60:])]
    a = spark.createDataFrame([(x,) for x in names], "text string")
    b = spark.createDataFrame([(x,) for x in sorted(set(vocabulary))], "text string")
    got = {r.text: (r.entry, r.score) for r in fuzzy.best_vocabulary(a, b, 80).collect()}
    want = {}
    for name in names:
        best = min(((-sim.token_sort_ratio(name, v), v) for v in set(vocabulary)))
        if -best[0] >= 80:
            want[name] = (best[1], -best[0])
    assert len(want) > 30
    assert got == want


def test_best_known_scores(spark):
    rng = random.Random(5)
    pool = words(rng, 200)
    raw, known = pool[:90] + ["sklearn", "komunikasi"], pool[60:] + ["scikit-learn", "communication", "r"]
    a = spark.createDataFrame([(x,) for x in raw], "text string")
    b = spark.createDataFrame(list(enumerate(known)), "id int, text string")
    got = {r.text: r for r in fuzzy.best_known(a, b, 85).collect()}
    assert got["sklearn"].known_text == "scikit-learn"
    assert got["komunikasi"].known_text == "communication"
    for text in raw:
        scores = [sim.skill_score(text, k, 85) for k in known]
        if text in known:
            assert got[text].known_text == text and got[text].score == 100.0
        elif max(scores) >= 85 and got[text].score < 100:
            assert got[text].score == pytest.approx(max(scores))
            assert got[text].known_id == scores.index(max(scores))
        elif max(scores) < 85 and text in got:
            assert got[text].score == 100.0  # shared synonym


def test_texts_with_a_full_score_are_not_compared_letter_by_letter(spark, monkeypatch):
    rng = random.Random(17)
    pool = words(rng, 260)
    raw = pool[:150] + ["xqxqxqz", "data  model", "model data", "q"]
    known = pool[120:] + ["xqxqxqy", "model big data", "data"]
    a = spark.createDataFrame([(x,) for x in raw], "text string")
    b = spark.createDataFrame([(i // 2, k) for i, k in enumerate(known)], "id int, text string")  # two names an id
    asked, plain = [], fuzzy.candidates
    monkeypatch.setattr(fuzzy, "candidates", lambda left, right, *more: asked.append(
        {r.text for r in left.select("text").collect()}) or plain(left, right, *more))
    got = {r.text: r for r in fuzzy.best_known(a, b, 85).collect()}
    full = set()
    for text in raw:
        scores = [(sim.skill_score(text, k, 85), -(i // 2)) for i, k in enumerate(known)]
        if text in known:
            assert got[text].known_text == text
        elif max(scores)[0] == 100:
            full.add(text)
            if not any(text == k for k in known) and got[text].score == 100 and got[text].known_id != -max(scores)[1]:
                assert spark.createDataFrame([(text,)], "t string").select(fuzzy.synonym(F.col("t"))).first()[0]
        elif text in got:
            assert got[text].score == 100 or (got[text].score, -got[text].known_id) == max(scores)
        else:
            assert max(scores)[0] < 85
    assert len(full) > 30 and len(asked) == 1 and not full & asked[0]
    assert "xqxqxqz" in asked[0] and got["xqxqxqz"].known_text == "xqxqxqy"
