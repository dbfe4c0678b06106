"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

Each five-word shingle is hashed once; the highest bits choose one of 128 bins and a bin
keeps its smallest hash.  An empty bin takes the value of the first filled bin in its
own fixed pseudo-random order of all bins (the same order in every document), which is
what optimal densification asks for.  Of each bin's value the lowest 8 bits are stored,
two hexadecimal digits per bin.  Two fingerprints agree by chance in a share
``c = 1/256`` of the bins, so the likeness is ``(share of equal bins - c) / (1 - c)``,
not below 0.

Everything is column expressions over arrays inside one row: nothing is shuffled to
build a fingerprint, and a very long text is one array.

Cases: null or empty texts, and texts of white space, have the empty fingerprint; two
empty ones have likeness 1, an empty and a filled one 0; texts of fewer than five words
have their whole word sequence as one shingle; equal texts have equal fingerprints;
other columns are ignored by ``fingerprint`` and kept by none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from skillweft.llm.components import stored
from skillweft.operators.ordering import number_all

BINS, BITS = 128, 8
_SHIFT = 56  # of 63 hash bits the upper 7 choose the bin
_EMPTY = (1 << _SHIFT) - 1
_PROBES = 6

# orders of the bins: bin i looks at (step_i * t + start_i) mod 128 for t = 0, 1, ...
_rng = np.random.default_rng(20_240_517)
_STEPS = [int(x) | 1 for x in _rng.integers(0, BINS, BINS)]
_STARTS = [int(x) for x in _rng.integers(0, BINS, BINS)]
_BACK = [pow(x, -1, BINS) for x in _STEPS]


def shingle_hashes(text: Column, size: int = 5) -> tuple[Column, Column]:
    """(words, hashes of the word shingles given a column ``words``)."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), "")
    hashes = F.when(
        F.size("words") > 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0))),
            # behind the last word there is null, which the hash passes over
            lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get("words", i + j) for j in range(size)]), 1),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    return words, hashes


def _value(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_EMPTY))


def _bin(x: Column) -> Column:
    return F.shiftright(x, _SHIFT)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with a column ``name`` holding the fingerprint of column ``text``."""
    words, hashes = shingle_hashes(F.col(text))
    fillers = F.array(*[F.lit((i << _SHIFT) | _EMPTY).cast("bigint") for i in range(BINS)])
    steps, starts, back = (F.array(*map(F.lit, x)) for x in (_STEPS, _STARTS, _BACK))
    low = F.lit(BINS - 1)

    def donor(i: Column) -> Column:
        found = None
        for t in range(_PROBES):
            at = (F.get(steps, i) * t + F.get(starts, i)).bitwiseAND(low)
            seen = _value(F.get("bins", at)) != _EMPTY
            found = F.when(seen, F.get("bins", at)) if found is None else found.when(seen, F.get("bins", at))
        # few bins are filled: of those the one that comes first in the order of bin i
        place = F.array_min(
            F.transform(
                "filled",
                lambda x: ((_bin(x) - F.get(starts, i)) * F.get(back, i)).bitwiseAND(low) * BINS + _bin(x),
            )
        )
        return found.otherwise(F.get("bins", place.bitwiseAND(low).cast("int")))

    kept = F.transform(
        "bins", lambda x, i: F.when(_value(x) != _EMPTY, x).otherwise(donor(i)).bitwiseAND(F.lit((1 << BITS) - 1))
    )
    return (
        df.withColumn("words", words)
        .withColumn("hashes", hashes)
        .drop("words")
        .withColumn("sorted", F.sort_array(F.concat("hashes", fillers)))
        .withColumn("any", F.size("hashes") > 0)
        .drop("hashes")
        .withColumn(
            "bins",  # the first entry of each bin: its smallest hash, or the filler
            F.filter("sorted", lambda x, i: (i == 0) | (_bin(x) != _bin(F.get("sorted", i - 1)))),
        )
        .drop("sorted")
        .withColumn("filled", F.filter("bins", lambda x: _value(x) != _EMPTY))
        .withColumn(
            name,
            F.when(
                F.col("any"),
                F.array_join(F.transform(kept, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), ""),
            ).otherwise(F.lit("")),
        )
        .drop("bins", "filled", "any")
    )


def likeness(left: Column, right: Column) -> Column:
    """Estimated Jaccard coefficient from two fingerprints."""
    digits = BITS // 4
    equal = F.aggregate(
        F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0),
        lambda n, i: n
        + F.substr(left, i * digits + 1, F.lit(digits)).eqNullSafe(F.substr(right, i * digits + 1, F.lit(digits))).cast("int"),
    )
    chance = 1 / (1 << BITS)
    filled = F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))
    return (
        F.when(left == right, F.lit(1.0)).when((left == "") | (right == ""), F.lit(0.0)).otherwise(filled)
    )


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every row."""
    found = with_fingerprint(docs.select("doc_id", F.col(text).alias("text")), "text", "fingerprint")
    return found.select("doc_id", "fingerprint")


def neighbours(docs: DataFrame) -> DataFrame:
    """``this_id``, ``next_id`` in ascending order of ids (the first after the last) and the
    number of code points ``need`` that the longest text of ``this_id`` takes from the next.

    Only ids and lengths are sorted, over range partitions."""
    ids = docs.groupBy("doc_id").agg(F.max(F.char_length(F.coalesce("text", F.lit("")))).alias("n"))
    numbered = stored(number_all(ids, [F.col("doc_id")], "place"), "places")
    count = numbered.count()
    after = F.when(F.col("place") == count, F.lit(1).cast("bigint")).otherwise(F.col("place") + 1)
    mine = numbered.select(
        F.col("doc_id").alias("this_id"), F.floor(F.col("n") / 4).cast("int").alias("need"), after.alias("after")
    )
    other = numbered.select(F.col("doc_id").alias("next_id"), "place")
    return stored(mine.join(other, mine["after"] == other["place"]).select("this_id", "next_id", "need"), "neighbours")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last quarter replaced by the beginning of the next
    document.  Rows that share a ``doc_id`` are each compared; the next document is then
    represented by its smallest text beginning and smallest fingerprint.  A null
    ``doc_id`` is the first of all ids.
    """
    docs = docs.selectExpr("cast(doc_id as bigint) as doc_id", "coalesce(text, '') as text")
    beside = neighbours(docs)
    start = (
        docs.join(beside, docs["doc_id"].eqNullSafe(beside["next_id"]))
        .groupBy("this_id").agg(F.min(F.expr("left(text, need)")).alias("start"))
    )
    n = F.char_length("text")
    rows = docs.join(start, docs["doc_id"].eqNullSafe(start["this_id"])).select(
        "doc_id", n.cast("bigint").alias("n_chars"), "text",
        F.concat(F.expr("left(text, char_length(text) - char_length(text) div 4)"),
                 F.expr("left(start, cast(char_length(text) div 4 as int))")).alias("edited"),
    )
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = with_fingerprint(rows, "text", "fingerprint").drop("text")
    rows = with_fingerprint(rows, "edited", "edited_fingerprint").drop("edited")
    rows = stored(rows, "fingerprints")
    later = rows.groupBy("doc_id").agg(F.min("fingerprint").alias("next_fingerprint")).withColumnRenamed("doc_id", "later_id")
    linked = rows.join(beside, rows["doc_id"].eqNullSafe(beside["this_id"])).drop("this_id", "need")
    linked = linked.join(later, linked["next_id"].eqNullSafe(later["later_id"]))
    return linked.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
