"""Hard negatives against scores of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("skillweft.llm")

from skillweft.llm import hard_negatives, queries  # noqa: E402

SCHEMA = "vec_id bigint, embedding array<{}>, label int, id int, vector string, leaf int, rank string, score double"


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, l, 5, "v", 2, "r", 0.5) for i, v, l in rows], SCHEMA.format(kind))


def brute(rows, shift=True, positives=5, negatives=10, step=100):
    taken = []
    for place, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if shift and i is not None and i % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        taken.append((place, i, label, [math.floor(256 * x) for x in v]))
    out = []
    for place, i, label, v in taken:
        if i is None or i % step:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w)), math.inf if j is None else j, p, m) for p, j, m, w in taken if p != place
        )
        for minus, j, _, _ in [x for x in scored if x[3] == label][:positives]:
            fit = [x for x in scored if x[3] != label and 30 * -minus <= 100 * -x[0] <= 90 * -minus][:negatives]
            out += [
                (i, None if j == math.inf else j, k, None if n == math.inf else n, -minus, -score)
                for k, (score, n, _, _) in enumerate(fit, 1)
            ]
    return sorted(map(repr, out))


def mined(vectors, **options):
    return sorted(repr(tuple(r)) for r in hard_negatives.mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0, **options).collect())


def clustered(seed, count, dims=12, labels=4):
    """Unit vectors around a few centres, as a float column holds them."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels * 2, dims))
    rows = []
    for i in range(count):
        label = int(rng.integers(labels))
        v = centres[2 * label + int(rng.integers(2))] + rng.normal(size=dims) * 0.5
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], label))
    return rows


def test_query_equals_all_pairs(spark, tmp_path):
    rows = clustered(1, 900)
    rows += [(100, rows[0][1], 2), (100, rows[0][1], 2), (None, rows[3][1], 1), (None, rows[100][1], rows[100][2])]
    rows += [(901, None, 1), (902, rows[5][1], None), (903, [None, 1.0], 1), (904, [math.nan] * 12, 1),
             (905, [math.inf] * 12, 0), (906, [], 1), (1000, [0.5, 0.25], 3), (1100, [0.1] * 20, 0), (-200, rows[7][1], 9)]
    vectors_of(spark, rows).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(repr(tuple(r)) for r in queries.op13(spark, str(tmp_path)).collect())
    expected = brute(rows)
    assert got == expected and len(got) > 200


@pytest.mark.parametrize("row_block,anchor_block,leaf_rows,fanout,sample", [(7, 2, 20, 3, 600), (4096, 1024, 50, 4, 64), (50, 1024, 10_000, 8, 8)])
def test_blocks_and_trees_of_any_size_agree(spark, monkeypatch, row_block, anchor_block, leaf_rows, fanout, sample):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", row_block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", anchor_block)
    rows = clustered(2, 700)
    got = mined(vectors_of(spark, rows), leaf_rows=leaf_rows, fanout=fanout, sample=sample)
    assert got == brute(rows, shift=False)


def test_a_third_of_all_rows_is_one_vector(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 64)
    rows = clustered(3, 600)
    same = rows[0][1]
    rows = [(i, same if i % 3 == 0 else v, label) for i, v, label in rows]
    assert mined(vectors_of(spark, rows), leaf_rows=40, fanout=4) == brute(rows, shift=False)


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    for size, kind in ((1e5, "double"), (2e6, "double"), (1e25, "float")):
        rows = [(i, [float(np.float32(rng.uniform(-size, size))) for _ in range(6)], i % 3) for i in range(120)]
        got = mined(vectors_of(spark, rows, kind))
        if size < 1e20:
            assert got == brute(rows, shift=False)


def test_zero_and_negative_scores(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, 2.0], 2), (4, [-0.5, 0.0], 2), (5, [0.0, 0.0], 3)]
    assert mined(vectors_of(spark, rows)) == brute(rows, shift=False)


def test_no_rows_and_no_anchors(spark):
    assert mined(vectors_of(spark, [])) == []
    assert mined(vectors_of(spark, [(1, [1.0], 1), (2, [1.0], 2)])) == []
    assert mined(vectors_of(spark, [(0, [], 1), (1, [], 1), (2, [], 2)])) == brute([(0, [], 1), (1, [], 1), (2, [], 2)], shift=False)


def test_ranges_leave_subtrees_out():
    """On separated groups an anchor's narrow annulus meets few leaves, and never loses a row inside it."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 200
    rows = np.floor(centres[rng.integers(20, size=4000)] + rng.normal(size=(4000, 16)) * 4)
    radius2 = float((rows**2).sum(axis=1).max())
    tree = hard_negatives.HyperplaneTree(rows[:1000], radius2, len(rows), 4, 100)
    seen = {}
    leaf = tree.index(rows, seen)
    tree.set_ranges([(*key, *span) for key, span in seen.items()])
    scores = rows[:50] @ rows.T
    low, high = np.sort(scores, axis=1)[:, -30], np.sort(scores, axis=1)[:, -5]
    visited = [(number, j) for number, own in tree.visits(rows[:50], low, high) for j in own]
    met = set(visited)
    for j in range(50):
        inside = np.flatnonzero((scores[j] >= low[j]) & (scores[j] <= high[j]))
        assert {(int(leaf[k]), j) for k in inside} <= met
    assert len(visited) < 0.4 * 50 * tree.leaves
