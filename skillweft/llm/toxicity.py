"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its lower-cased words and their beginnings of four and six bytes;
each present term is one binary feature named by a 32-bit hash.  The machine

    score = sigmoid(bias + sum w_i + sum_{i<j} <v_i, v_j>)

learns a weight per term and, through the factors ``v``, one for every pair, such as an
insult together with the mention of a group, which additive weights miss.

Training rows are a bounded sample: the ``sample_rows`` labelled documents with the
smallest hash of their id.  Their term lists meet in one task, where the ``max_terms``
terms that tell the classes apart best (chi-square, in at least ``min_docs`` documents
of the rarer class) get parameters, which are fitted by full-batch Adam steps.  The model is at most ``max_terms`` rows of ``factors + 2``
numbers; it is collected and broadcast, and all documents are scored where they are.

Cases: null or empty texts have no terms and score the bias alone; without labelled
rows, or with one class only, every score is the share of the positive class (0 without
rows); repeated documents score alike; null labels are left out; a null ``doc_id`` is
scored but never trained on; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from skillweft.llm.worker import bound_batches, process_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PREFIXES = (4, 6)


def terms_of(text: str | None) -> np.ndarray:
    """Distinct hashed terms of a text."""
    import xxhash

    if not text:
        return np.zeros(0, np.int64)
    words = set(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    terms = set(words)
    for size in PREFIXES:
        terms.update([b"^" + w[:size] for w in words if len(w) >= size])
    return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, terms), np.int64, len(terms)))


def _segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive row ranges of ``values``, some of them empty."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[ends] - total[starts]


def _places(names: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Where those of the terms that are among the sorted names stand."""
    if not len(names) or not len(terms):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(names, terms), len(names) - 1)
    return at[names[at] == terms]


def fit(
    rows: list[np.ndarray], labels: np.ndarray, max_terms: int, min_docs: int, factors: int, steps: int,
    rate: float = 0.1, decay: float = 5e-4, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(term hashes, parameters [w, v...] per term, bias)."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        bias = np.inf if share else -np.inf
        return np.zeros(0, np.int64), np.zeros((0, factors + 1)), bias
    rarer = 1.0 if share <= 0.5 else 0.0
    names, own = np.unique(np.concatenate([r for r, y in zip(rows, labels) if y == rarer]), return_counts=True)
    names, own = names[own >= min_docs], own[own >= min_docs]
    places = [_places(names, row) for row in rows]
    counts = np.bincount(np.concatenate(places), minlength=len(names))
    base = share if rarer else 1 - share
    tells = (own - counts * base) ** 2 / np.maximum(counts * base * (1 - base), 1e-9)
    best = np.sort(np.lexsort((names, -tells))[:max_terms])
    names = names[best]
    places = [_places(best, at) for at in places]
    index = np.concatenate(places)
    ends = np.cumsum([len(at) for at in places])
    starts = np.concatenate([[0], ends[:-1]])
    row_of = np.repeat(np.arange(len(rows)), ends - starts)
    by_term = np.argsort(index, kind="stable")  # for gradients, summed term by term
    term_ends = np.cumsum(np.bincount(index, minlength=len(names)))
    term_starts = np.concatenate([[0], term_ends[:-1]])
    rows_by_term = row_of[by_term]
    # both classes weigh alike in the sum up to the square root of their odds
    weight = np.where(labels == 1, np.sqrt((1 - share) / share), 1.0)
    weight /= weight.sum()
    rng = np.random.default_rng(seed)
    theta = np.zeros((len(names), factors + 1))
    theta[:, 1:] = rng.normal(0, 0.01, (len(names), factors))
    bias = float(np.log(share / (1 - share)))
    rates = np.array([rate] + [rate / 10] * factors)  # pairs refine what single terms tell
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    b_first = b_second = 0.0
    for step in range(1, steps + 1):
        sums = _segment_sums(theta[index], starts, ends)
        squares = _segment_sums((theta[:, 1:] ** 2).sum(1)[index], starts, ends)
        score = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)
        error = weight * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels)
        carried = np.column_stack([error, error[:, None] * sums[:, 1:]])
        gradient = _segment_sums(carried[rows_by_term], term_starts, term_ends)
        mass = _segment_sums(error[rows_by_term], term_starts, term_ends)
        gradient[:, 1:] -= mass[:, None] * theta[:, 1:]
        gradient += decay * theta
        b_gradient = error.sum()
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        b_first = 0.9 * b_first + 0.1 * b_gradient
        b_second = 0.99 * b_second + 0.01 * b_gradient**2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        theta -= rates * (first / fix1) / (np.sqrt(second / fix2) + 1e-8)
        bias -= rate * (b_first / fix1) / (np.sqrt(b_second / fix2) + 1e-8)
    return names, theta, bias


def score(terms: np.ndarray, names: np.ndarray, theta: np.ndarray, bias: float) -> float:
    """Probability of label 1 for one document's terms."""
    value = bias
    if len(names) and len(terms):
        known = theta[_places(names, terms)]
        v = known[:, 1:]
        value += known[:, 0].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
    if np.isinf(value):  # a model of one class
        return float(value > 0)
    return float(1 / (1 + np.exp(-np.clip(value, -700, 700))))


def train(
    docs: DataFrame, labelled: DataFrame, sample_rows: int = 12_000, max_terms: int = 1_024,
    min_docs: int = 5, factors: int = 4, steps: int = 100,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Model from ``docs(doc_id, text)`` and ``labelled(doc_id, label)``."""
    bound_batches(docs.sparkSession)
    chosen = (
        labelled.selectExpr("cast(doc_id as bigint) as sample_id", "cast(label as int) as label")
        .filter("sample_id is not null and label in (0, 1)")
        .groupBy("sample_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("sample_id"), "sample_id")
        .limit(sample_rows)  # the documented bound of the training sample
    )
    texts = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("sample_id")
    )

    def to_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_cache("toxicity")
        for batch in batches:
            found = [terms_of(t.as_py()).astype("<u4").tobytes() for t in batch.column(1)]
            arrays = [batch.column(0), batch.column(2), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "label", "terms"])

    rows = texts.select("doc_id", "text", "label").mapInArrow(to_terms, "doc_id bigint, label int, terms binary")

    def fit_sample(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["doc_id", "terms"]).drop_duplicates("doc_id")
        lists = [np.frombuffer(t, "<u4").astype(np.int64) for t in sample["terms"]]
        names, theta, bias = fit(lists, sample["label"].to_numpy(float), max_terms, min_docs, factors, steps)
        return pd.DataFrame({
            "names": [names.astype("<i8").tobytes()], "theta": [theta.astype("<f8").tobytes()], "bias": [bias],
        })

    fitted = rows.withColumn("model", F.lit(0)).groupBy("model").applyInPandas(fit_sample, "names binary, theta binary, bias double").collect()
    if not fitted:
        return np.zeros(0, np.int64), np.zeros((0, factors + 1)), -np.inf
    model = fitted[0]  # one row, bounded by max_terms
    names = np.frombuffer(model["names"], "<i8")
    return names, np.frombuffer(model["theta"], "<f8").reshape(len(names), factors + 1), model["bias"]


def score_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """``docs`` with a further column ``score``; the columns stay as they are."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = "score"
    while name in docs.columns:
        name = "_" + name
    ordered = docs.select("text", *[c for c in docs.columns if c != "text"])
    schema = ordered.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_cache("toxicity")
        names, theta, bias = sent.value
        for batch in batches:
            scores = [score(terms_of(t.as_py()), names, theta, bias) for t in batch.column(0)]
            arrays = [*batch.columns, pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, name])

    return ordered.mapInArrow(run, schema).select(*docs.columns, F.col(name).alias(name))


def drop_toxic(docs: DataFrame, labelled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents that score below the threshold, columns as they are."""
    scored = score_documents(docs, train(docs, labelled))
    name = scored.columns[-1]
    return scored.filter(F.col(name) < threshold).drop(name)
