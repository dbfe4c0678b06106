"""Removal of long passages that also stand in an earlier document, by seed and extend.

Seeds are winnowed anchors: of the ``gram``-word sequences in every window of ``window``
words the one with the smallest hash (the rightmost of equals) is the window's anchor.
Equal windows have equal anchors at equal places, so two documents share a window only
if they share an anchor.  Consecutive windows with the same anchor form a run; a run
with its words from the first to the last window is the anchor's context.

1. Anchors are joined on their hash over all documents; those of one document leave.
2. Extension as far as the context reaches: a context that also stands in a smaller
   ``doc_id`` is a repeat as a whole.  Only the smallest document of each context goes
   on, so thousands of copies leave one row.
3. Where an anchor has several contexts, its window is extended word by word in both
   directions inside the run, and each extension is compared with those of the other
   contexts.
4. Overlapping repeats of a document merge into maximal ones; their words are removed.

Runs and extensions are named by 64-bit hashes, compared only within one anchor.
Every row is keyed by hash or document; minima are combined before each shuffle.

Cases: null or empty texts have no words and keep an empty text; texts shorter than
``window`` words keep all; rows that share a ``doc_id`` never remove from each other
but each loses what stands in a smaller one; a row with a null ``doc_id`` loses nothing
and removes nothing; other columns are ignored; an empty table gives no rows.  Very
long texts are read in slices of windows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from skillweft.llm.components import stored
from skillweft.llm.worker import bound_batches, process_cache, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SLICE = 1 << 20  # windows looked at together
_PLACE_BITS = 21  # more places than a slice has
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: str | None) -> list[bytes]:
    return text_bytes(text).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _powers(base: int, count: int) -> np.ndarray:
    cache = process_cache("substrings")
    known = cache.get(("powers", base))
    if known is None or len(known) < count:
        size = max(count, 4096)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        known = cache["powers", base] = np.cumprod(steps)
    return known[:count]


def range_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of word ranges, equal for equal words wherever they stand."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(_BASE, len(hashes)), out=sums[1:])
    found = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(hashes) + 1)[starts]
    found ^= found >> np.uint64(31)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(29))


def anchors(hashes: np.ndarray, window: int, gram: int) -> list[tuple]:
    """(anchor hash, context hash, first window, last window) of the runs of one document."""
    found = []
    grams = window - gram + 1
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    for low in range(0, len(hashes) - window + 1, _SLICE):
        part = hashes[low : low + _SLICE + window - 1]
        places = np.arange(len(part) - gram + 1)
        named = range_hashes(part, places, places + gram)
        # smallest hash first, of equal ones the rightmost
        smallest = (named & ~mask) | (mask - places.astype(np.uint64))
        reach = 1
        while 2 * reach <= grams:
            smallest = np.minimum(smallest[:-reach], smallest[reach:])
            reach *= 2
        if reach < grams:
            smallest = np.minimum(smallest[: -(grams - reach)], smallest[grams - reach :])
        place = (mask - (smallest & mask)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        context = range_hashes(part, first, last + window)
        found.append((named[place[first]].view(np.int64), context.view(np.int64), first + low, last + low))
    return found


def _anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            rows = 0

            def flush():
                columns = [np.concatenate(c) for c in zip(*held)]
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["doc_id", "anchor", "context", "first", "last"]
                )

            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for one in anchors(word_hashes(words_of(text.as_py())), window, gram):
                    held.append((np.full(len(one[0]), doc, np.int64), *one))
                    rows += len(one[0])
                if rows > 100_000:
                    yield flush()
                    held, rows = [], 0
            if held:
                yield flush()

    schema = "doc_id bigint, anchor bigint, context bigint, first bigint, last bigint"
    return docs.mapInArrow(run, schema)


def _extensions(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """Every window of the given runs: ``doc_id``, ``anchor``, ``extension`` (hash), ``first``."""
    per_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("runs"))
    rows = docs.join(per_doc, "doc_id").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                hashes = word_hashes(words_of(text.as_py()))
                values = own.values
                first = values.field("first").to_numpy()
                last = values.field("last").to_numpy()
                inside = last + window <= len(hashes)  # of rows that share a doc_id, another text's runs
                first, last = first[inside], last[inside]
                anchor = values.field("anchor").to_numpy()[inside]
                count = last - first + 1
                starts = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(starts), doc, np.int64)), pa.array(np.repeat(anchor, count)),
                    pa.array(range_hashes(hashes, starts, starts + window).view(np.int64)), pa.array(starts),
                ], ["doc_id", "anchor", "extension", "first"])

    return rows.mapInArrow(run, "doc_id bigint, anchor bigint, extension bigint, first bigint")


def repeats(docs: DataFrame, window: int = 50, gram: int = 10) -> DataFrame:
    """Word ranges that also stand in a smaller ``doc_id``: ``doc_id``, ``low``, ``high`` (past the end)."""
    runs = stored(_anchor_rows(docs, window, gram), "anchors")
    met = runs.groupBy("anchor").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"),
        F.min("context").alias("one"), F.max("context").alias("other"),
    ).filter("least < most").select("anchor", (F.col("one") != F.col("other")).alias("several"))
    # minima are stored before they are joined back: a join of two plain tables can split hot anchors
    seeds = stored(runs.join(stored(met, "shared-anchors"), "anchor"), "seeds")
    owner = stored(seeds.groupBy("anchor", "context").agg(F.min("doc_id").alias("owner")), "contexts")
    placed = seeds.join(owner, ["anchor", "context"])
    whole = placed.filter("owner < doc_id").select(
        "doc_id", F.col("first").alias("low"), (F.col("last") + window).alias("high")
    )
    open_runs = placed.filter("several and owner = doc_id").select("doc_id", "anchor", "first", "last")
    extended = stored(_extensions(docs, open_runs, window), "extensions")
    earliest = extended.groupBy("anchor", "extension").agg(
        F.min("doc_id").alias("owner"), F.max("doc_id").alias("latest")
    ).filter("owner < latest").drop("latest")
    partly = extended.join(earliest, ["anchor", "extension"]).filter("owner < doc_id").select(
        "doc_id", F.col("first").alias("low"), (F.col("first") + window).alias("high")
    )
    return whole.unionByName(partly)


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 10) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``removed`` (maximal word
    ranges) and ``kept`` (the other words joined by one space)."""
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    docs = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    bound_batches(docs.sparkSession)
    found = repeats(docs.filter("doc_id is not null"), window, gram)
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    rows = docs.join(per_doc.withColumnRenamed("doc_id", "range_doc"), F.col("doc_id") == F.col("range_doc"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        for batch in batches:
            out: list[tuple] = []
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = words_of(text.as_py())
                merged: list[dict] = []
                if own.is_valid:
                    low = own.values.field("low").to_numpy()
                    high = own.values.field("high").to_numpy()
                    for i in np.argsort(low, kind="stable"):
                        if high[i] > len(words):
                            continue  # of another text with this doc_id
                        if merged and low[i] <= merged[-1]["high"]:
                            merged[-1]["high"] = max(merged[-1]["high"], int(high[i]))
                        else:
                            merged.append({"low": int(low[i]), "high": int(high[i])})
                kept, at = [], 0
                for one in merged:
                    kept += words[at : one["low"]]
                    at = one["high"]
                kept += words[at:]
                joined = b" ".join(kept).decode("utf-8", "surrogatepass")
                out.append((doc, len(words), len(words) - len(kept), merged, joined))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pair, pa.string()]
                names = ["doc_id", "n_words", "n_removed", "removed", "kept"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.select("doc_id", "text", "ranges").mapInArrow(
        run,
        "doc_id bigint, n_words bigint, n_removed bigint, "
        "removed array<struct<low: bigint, high: bigint>>, kept string",
    )
