"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's windows.

Benchmark items and documents are normalised alike: A-Z are lower-cased and words are
runs of characters other than ASCII separators and punctuation.  Every run of
``window`` item words (a shorter item as a whole) is one pattern.  A document is
scanned once; matches are mapped back to word numbers and to code point offsets of the
original text.

The automaton runs over word numbers, so a window of ten words is ten nodes.  It is
built in each worker from the items' words; long items are cut into overlapping pieces
first, and pieces are dealt into shards of at most ``shard_nodes`` nodes, one automaton
each.  With several shards every row gets a number, the documents are scanned once per shard, and what is
found is put together by that number: the result does not depend on the number of shards.
Shards pass through the driver one at a time.

Cases: null or empty texts have no words and no hits; items without words are ignored;
items that share a window are all reported; repeated documents and rows that share a
``doc_id`` or have none are scanned each for itself; an empty benchmark leaves every
document clean; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import string
import sys
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from skillweft.llm.components import stored
from skillweft.llm.worker import bound_batches, process_cache, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_KEPT = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c in _KEPT else 32 for c in range(256)
)  # A-Z to a-z, separators to a space
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SCHEMA = (
    "doc_id bigint, n_words bigint, hit_words array<bigint>, items array<bigint>, "
    "spans array<struct<start: bigint, end: bigint>>"
)


def words_of(text: str | None) -> list[bytes]:
    """Normalised words of a text."""
    return text_bytes(text).translate(_FOLD).split()


class WindowAutomaton:
    """Aho-Corasick automaton over the word windows of (item, words) pieces."""

    def __init__(self, pieces: list[tuple[int, str]], window: int):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        self.sizes: list[int] = []
        self.owners: list[tuple[int, ...]] = []
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for item, text in pieces:
            words = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text))
            size, alone = min(window, len(words)), (item,)
            for i in range(len(words) - size + 1 if size else 0):
                key = words[i : i + size]
                known = self.trie.get(key, -1)
                if known < 0:
                    self.trie.add_word(key, len(self.sizes))
                    self.sizes.append(size)
                    self.owners.append(alone)
                elif item not in self.owners[known]:
                    self.owners[known] += alone
        if self.sizes:
            self.trie.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[int], list[int], list[dict]]:
        """(words, items, hit word numbers, their places in the original text) of one document."""
        words = words_of(text)
        hits: set[int] = set()
        items: set[int] = set()
        if self.sizes and words:
            for last, found in self.trie.iter(tuple(map(self.numbers.get, words, itertools.repeat(0)))):
                hits.update(range(last - self.sizes[found] + 1, last + 1))
                items.update(self.owners[found])
        if not hits:
            return len(words), [], [], []
        numbers = sorted(hits)
        places = [m.span() for m in _WORD.finditer(text)]
        return len(words), sorted(items), numbers, [{"start": places[k][0], "end": places[k][1]} for k in numbers]


def spans_of(numbers: list[int], places: list[dict]) -> tuple[list[int], list[dict]]:
    """Distinct word numbers in order, and the spans that runs of them cover."""
    spans: list[dict] = []
    own = dict(zip(numbers, places))
    ordered = sorted(own)
    for number in ordered:
        if number - 1 in own:
            spans[-1]["end"] = own[number]["end"]
        else:
            spans.append(dict(own[number]))
    return ordered, spans


_PLACES = "array<struct<start: bigint, end: bigint>>"
_PLACE_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_LONGS = pa.list_(pa.int64())


def _scan_with(docs: DataFrame, pieces: list[tuple[int, str]], window: int, hits_only: bool) -> DataFrame:
    """All columns but the text of ``docs`` with what :meth:`WindowAutomaton.scan` finds."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    keys = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = process_cache("decontamination")
        if cache.get("benchmark") != (window, sent.value):
            cache["benchmark"] = (window, sent.value)
            cache["automaton"] = WindowAutomaton(sent.value, window)
        built = cache["automaton"]
        kinds = [pa.int64(), _LONGS, _LONGS, _PLACE_TYPE]
        names = [*keys, "n_words", "items", "hit_words", "places"]
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [built.scan(text.as_py()) for text in batch.column(len(keys))]
            kept = batch.select(keys)
            if hits_only:
                there = [i for i, f in enumerate(found) if f[1]]
                kept, found = kept.take(pa.array(there, pa.int64())), [found[i] for i in there]
            columns = list(zip(*found)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, columns, kinds)], names)

    shape = "".join(f"{c} bigint, " for c in keys)
    return docs.select(*keys, "text").mapInArrow(
        run, f"{shape}n_words bigint, items array<bigint>, hit_words array<bigint>, places {_PLACES}"
    )


def _with_spans(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = [spans_of(n, p) for n, p in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            items = [sorted(set(x)) for x in batch.column(2).to_pylist()]
            arrays = [pa.array([m[0] for m in merged], _LONGS), pa.array(items, _LONGS), pa.array([m[1] for m in merged], _PLACE_TYPE)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *arrays], ["doc_id", "n_words", "hit_words", "items", "spans"])

    return found.select("doc_id", "n_words", "items", "hit_words", "places").mapInArrow(run, SCHEMA)


def item_pieces(benchmark: DataFrame, window: int, piece: int = 1000) -> DataFrame:
    """(item_id, words, nodes): every window of every item stands in one piece of at most ``piece`` windows."""
    folded = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.regexp_extract_all(folded, F.lit(_WORD.pattern), F.lit(0))
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(piece))
    cut = items.select("item_id", F.col("w"), F.explode(starts).alias("at")).select(
        "item_id", F.slice("w", F.col("at") + 1, F.lit(piece + window - 1)).alias("w"))
    size = F.least(F.lit(window), F.size("w"))
    return cut.select("item_id", F.array_join("w", " ").alias("words"), ((F.size("w") - size + 1) * size).alias("nodes"))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_nodes: int = 2_000_000
) -> DataFrame:
    """Per document: ``n_words``, hit word numbers, items found and spans of the original text.

    A worker holds one automaton of some ``shard_nodes`` nodes (about 100 bytes each).
    """
    bound_batches(docs.sparkSession)
    pieces = item_pieces(benchmark, window)
    nodes = pieces.agg(F.coalesce(F.sum("nodes"), F.lit(0))).first()[0]
    shards = max(1, -(-nodes // shard_nodes))
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")

    def shard(number: int) -> list[tuple[int, str]]:  # a bounded share of the benchmark
        own = pieces.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(shards)) == number)
        return sorted((r["item_id"], r["words"]) for r in own.filter("item_id is not null").collect())

    if shards == 1:
        return _with_spans(_scan_with(rows, shard(0), window, hits_only=False))
    numbered = stored(rows.withColumn("row", F.monotonically_increasing_id()), "decontamination-rows")
    parts = [stored(_scan_with(numbered, shard(k), window, hits_only=k > 0), "decontamination-hits") for k in range(shards)]
    # as many rows for one document as there are shards
    merged = reduce(DataFrame.unionByName, parts).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("items", "hit_words", "places")],
    )
    return _with_spans(merged)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Documents without any window of the benchmark; all columns stay as they are."""
    name = "_doc_no"
    while name in docs.columns:
        name += "_"
    hit = find_contamination(docs, benchmark, window).filter(F.size("items") > 0)
    hit = hit.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit[name]), "left_anti")
