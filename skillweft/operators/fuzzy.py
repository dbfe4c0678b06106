"""Similarity joins that compare candidate pairs only, and lose none.

Why no match is lost.  Take a text of length n that is the longer one of a
similar pair, or the one (almost) inside the other.  With a threshold of T
percent it differs from its counterpart, which has n, n - 1 or fewer letters, by
at most (100 - T) / 100 of the letters of both, counted as insertions and
deletions; their number is even for equal lengths and odd for a difference of
one.  ``edit_limit`` is the largest such number.  Cut the words of the text into
more pieces than that: at least one is untouched, and of any ``limit + r`` pieces at
least r are.  It is enough to join on the ``limit + r`` rarest pieces, which keeps
frequent pieces out of the join, and to score only pairs that agree on r of them
(r is ``AGREE``, or what the number of pieces allows).  Either text of a pair can
be the one that was cut, so both directions run.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from skillweft.functions.similarity import skill_score_udf, token_sort_udf
from skillweft.functions.skills import synonym
from skillweft.operators.containment import FEW, contained_words, pieces
from skillweft.operators.ordering import number_all
from skillweft.session import cut_lineage


_BITS = 62
AGREE = 3  # pieces that a pair must share before it is scored
HEAVY = 500  # texts that hold a piece before it is dealt into blocks


def edit_limit(length: Column, threshold: int) -> Column:
    """Most insertions and deletions that a text of this length survives."""
    slack = 100 - threshold
    equal = F.floor(length * 2 * slack / 100)
    shorter = F.floor((2 * length - 1) * slack / 100)
    return F.greatest(
        equal - equal % 2, shorter - (shorter + 1) % 2, loss_limit(length, threshold), F.lit(0)
    ).cast("int")


def loss_limit(length: Column, threshold: int) -> Column:
    """Most letters of the text that the other text may lack."""
    return F.floor(length * (200 - 2 * threshold) / (200 - threshold)).cast("int")


def piece_masks(found: Column) -> list[Column]:
    """Set of text pieces as bits of two longs."""

    def half(which: int) -> Column:
        spots = F.transform(found, lambda p: F.pmod(F.hash(p), F.lit(2 * _BITS)) - which * _BITS)
        mine = F.filter(spots, lambda i: (i >= 0) & (i < _BITS))
        one = F.lit(1).cast("bigint")
        return F.aggregate(
            mine, F.lit(0).cast("bigint"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", one, i))
        )

    return [half(0), half(1)]


def _missing(mine: str, theirs: str) -> Column:
    """Lower bound of the pieces of one mask that the other text lacks."""
    return reduce(lambda a, b: a + b, [
        F.bit_count(F.col(f"{mine}{i}").bitwiseAND(F.bitwise_not(f"{theirs}{i}"))) for i in (0, 1)
    ])


def _mask_columns(found: Column, name: str) -> list[Column]:
    return [m.alias(f"{name}{i}") for i, m in enumerate(piece_masks(found))]


def _cut_word(word: Column, size: int) -> Column:
    """Nearly equal pieces of at most ``size`` letters."""
    count = F.ceil(F.length(word) / size).cast("int")
    start = lambda i: F.floor(i * F.length(word) / count).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.substr(word, start(i) + 1, start(i + 1) - start(i))
    )


def _cut_words(words: Column, size: int) -> Column:
    return F.flatten(F.transform(words, lambda w: _cut_word(w, size)))


def cut_pieces(texts: DataFrame, threshold: int) -> DataFrame:
    """(text, lost, pieces) with disjoint pieces as long as their number allows, and masks of the letters
    and of two ways to cut the words into two-letter pieces."""
    words = F.array_distinct(F.filter(F.split("text", " "), lambda w: w != ""))
    rows = texts.select("text").distinct().withColumn("words", words).filter(F.size("words") > 0)
    tails = F.filter(F.transform("words", lambda w: F.substr(w, F.lit(2))), lambda w: w != "")
    rows = rows.select(
        "text", edit_limit(F.length("text"), threshold).alias("lost"),
        loss_limit(F.length("text"), threshold).alias("gone"),
        *[_cut_words(F.col("words"), n).alias(f"cut{n}") for n in (1, 2, 3)],
        _cut_words(tails, 2).alias("shifted"),
    )
    chosen = F.when(F.size("cut3") > F.col("lost"), F.col("cut3")).when(
        F.size("cut2") > F.col("lost"), F.col("cut2")
    ).otherwise(F.col("cut1"))  # texts that repeat one word have too few pieces: then every letter is a key
    return rows.select(
        "text", "lost", "gone", chosen.alias("pieces"), *_mask_columns(F.col("cut1"), "letters"),
        *_mask_columns(F.col("cut2"), "pairs"), *_mask_columns(F.col("shifted"), "shifted"),
    )


def rare_pieces(cut: DataFrame, frequency: DataFrame) -> DataFrame:
    """The ``lost + AGREE`` rarest pieces of every text: how often each was cut, and the number to ``agree`` on."""
    rows = cut.join(frequency, "piece", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("text").orderBy("n", "piece")  # the pieces of one text
    taken = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.col("lost") + AGREE)
    each = taken.groupBy("text", "piece").agg(F.count(F.lit(1)).alias("times"), F.max("lost").alias("lost"))
    whole = F.sum("times").over(Window.partitionBy("text"))
    return each.select("text", "piece", "times", F.greatest(whole - F.col("lost"), F.lit(1)).alias("agree"))


def length_band(length: Column, threshold: int) -> Column:
    """Number of a band of lengths: texts whose whole ratio reaches the threshold lie at most one band apart."""
    ratio = (200 - threshold) / threshold
    return F.floor(F.log(F.greatest(length, F.lit(1))) / F.lit(math.log(ratio) + 1e-6)).cast("int")


def deal_heavy(
    keys: DataFrame, held: DataFrame, frequency: DataFrame, threshold: int, plain: bool
) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``salt`` and ``band``, alike for all rows of a rare piece.

    A text of a heavy piece stands in one block; a key meets all of them, in the bands it can reach.
    """
    heavy = frequency.filter(F.col("n") > HEAVY).select("piece", F.ceil(F.col("n") / F.lit(HEAVY)).alias("salts"))
    blocks, zero = F.coalesce("salts", F.lit(1)), F.lit(0)
    banded = F.col("salts").isNotNull() if plain and threshold > 0 else F.lit(False)
    dealt = held.join(heavy, "piece", "left").withColumns({
        "salt": F.pmod(F.xxhash64("other"), blocks), "band": F.when(banded, length_band(F.length("other"), threshold)).otherwise(zero),
    }).drop("salts")
    own = length_band(F.length("text"), threshold)
    reached = F.when(banded, F.array(own - 1, own, own + 1)).otherwise(F.array(zero))
    asking = keys.join(heavy, "piece", "left").withColumn("salt", F.explode(F.sequence(zero.cast("bigint"), blocks - 1)))
    return asking.withColumn("band", F.explode(reached)).drop("salts"), dealt


def _one_direction(source: DataFrame, target: DataFrame, threshold: int, plain: bool = False) -> DataFrame:
    held = target.select("text").distinct().select(
        F.col("text").alias("other"), *_mask_columns(pieces(F.col("text"), (1,)), "other_letters"),
        *_mask_columns(pieces(F.col("text"), (1, 2)), "other_pairs"), F.explode(pieces(F.col("text"))).alias("piece"),
    )
    cut = cut_pieces(source, threshold)
    exploded = cut.select("text", "lost", F.explode("pieces").alias("piece"))
    wanted = exploded.select("piece").distinct()
    frequency = held.select("piece").join(wanted, "piece", "left_semi").groupBy("piece").agg(
        F.count(F.lit(1)).alias("n")
    )
    keys, held = deal_heavy(
        rare_pieces(exploded, frequency).join(cut.drop("pieces"), "text"), held, frequency, threshold, plain)
    # bit counts before any scoring: no more pieces may be missing than edits are allowed
    near = keys.join(held, ["piece", "salt", "band"]).filter(
        (_missing("letters", "other_letters") <= F.col("gone"))
        & (_missing("pairs", "other_pairs") <= F.col("lost"))
        & (_missing("shifted", "other_pairs") <= F.col("lost"))
    )
    if plain:  # the shorter text bounds the shared letters
        short = F.least(F.length("text"), F.length("other"))
        near = near.filter(200 * short >= threshold * (F.length("text") + F.length("other")))
    shared = near.groupBy("text", "other").agg(F.sum("times").alias("times"), F.max("agree").alias("agree"))
    return shared.filter("times >= agree").select("text", "other")


def candidates(left: DataFrame, right: DataFrame, threshold: int, plain: bool = False) -> DataFrame:
    """Distinct (a, b) with ``a`` from left and ``b`` from right that may reach the threshold.

    ``plain``: only the ratio of the whole texts counts, not words or windows.
    """
    forward = _one_direction(left, right, threshold, plain).select(F.col("text").alias("a"), F.col("other").alias("b"))
    backward = _one_direction(right, left, threshold, plain).select(F.col("other").alias("a"), F.col("text").alias("b"))
    return forward.union(backward).distinct()


def full_matches(texts: DataFrame, names: DataFrame, threshold: int) -> DataFrame:
    """First of the ``names`` (text, id) that scores 100 with a different text: (text, known_id, known_text).

    Two texts score 100 only if the one lies inside the other or has all its words, and no word-set
    score in between comes first; both is found by exact joins.
    """
    numbered = cut_lineage(number_all(names, [F.col("id").asc_nulls_last(), F.asc("text")], "no"))
    few = numbered.count() <= FEW
    known = F.broadcast(numbered) if few else numbered
    ranks = known.select(F.col("text").alias("b"), "no")
    held = contained_words(texts, names.select(F.col("text").alias("phrase"))).select(
        F.col("text").alias("a"), F.col("phrase").alias("b"))
    # a text that a name holds is no longer than the longest name
    short = texts.filter(F.length("text") <= names.agg(F.coalesce(F.max(F.length("text")), F.lit(0))).scalar())
    holding = contained_words(names.select("text"), short.select(F.col("text").alias("phrase"))).select(
        F.col("phrase").alias("a"), F.col("text").alias("b"))
    pairs = held.union(holding)
    spaced = F.contains(F.col("a"), F.lit(" ")) | F.contains(F.col("b"), F.lit(" "))
    size = F.length("a") + F.length("b")
    single = pairs.filter(~spaced & (200 * F.least(F.length("a"), F.length("b")) < threshold * size))
    phrases = pairs.filter(spaced).distinct().filter(skill_score_udf(float(threshold))("a", "b") == 100.0)
    first = single.union(phrases).join(ranks, "b").groupBy("a").agg(F.min("no").alias("no"))
    return first.join(known, "no").select(F.col("a").alias("text"), F.col("id").alias("known_id"), F.col("text").alias("known_text"))


def best_known(raw: DataFrame, known: DataFrame, threshold: int = 85) -> DataFrame:
    """Best known skill per raw text: (text, known_id, known_text, score).

    Equal texts and shared synonyms score 100; other pairs are scored by words
    and windows.  Ties go to the equal text, then a synonym, then the lowest id.
    """
    # the distinct texts and what they equal feed several joins: compute each once
    texts = cut_lineage(raw.select("text").distinct().filter(F.col("text") != ""))
    names = known.groupBy("text").agg(F.min("id").alias("id")).filter(F.col("text") != "")
    keyed = names.select("text", "id", F.explode(F.array_distinct(F.array_compact(
        F.array("text", synonym(F.col("text")))
    ))).alias("key"))
    # one known skill per key is enough, whatever the number that share the synonym
    per_key = keyed.groupBy("key").agg(
        F.min_by(F.struct("id", F.col("text").alias("known_text")),
                 F.struct((F.col("key") != F.col("text")).cast("int"), "id")).alias("hit")
    )
    wanted = texts.select("text", F.explode(F.array_distinct(F.array_compact(
        F.array("text", synonym(F.col("text")))
    ))).alias("key"))
    direct = wanted.join(per_key, "key").groupBy("text").agg(F.min_by(
        "hit", F.struct((F.col("hit.known_text") != F.col("text")).cast("int"), F.col("hit.id"))
    ).alias("hit")).select("text", F.col("hit.id").alias("known_id"),
                           F.col("hit.known_text").alias("known_text"), F.lit(100.0).alias("score"))
    direct = cut_lineage(direct)
    rest = cut_lineage(texts.join(direct.select("text"), "text", "left_anti"))
    # nothing beats 100: only texts without such a name are compared letter by letter
    full = cut_lineage(full_matches(rest, names, threshold).withColumn("score", F.lit(100.0)))
    pairs = candidates(rest.join(full.select("text"), "text", "left_anti"), names.select("text"), threshold)
    scored = pairs.withColumn("score", skill_score_udf(float(threshold))("a", "b")).filter(
        F.col("score") >= threshold
    )
    fuzzy = scored.join(names.select(F.col("text").alias("b"), "id"), "b").groupBy("a").agg(
        F.max_by(F.struct("id", "b", "score"), F.struct(F.col("score"), -F.col("id"))).alias("hit")
    ).select(F.col("a").alias("text"), F.col("hit.id").alias("known_id"),
             F.col("hit.b").alias("known_text"), F.col("hit.score").alias("score"))
    return direct.union(full).union(fuzzy)


def best_vocabulary(names: DataFrame, vocabulary: DataFrame, threshold: int = 80) -> DataFrame:
    """Best vocabulary entry per name by the word-sorted ratio: (text, entry, score).

    Names without an entry at or above the threshold are absent.
    """
    def sorted_words(text: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1))
        return F.array_join(F.array_sort(words), " ")

    left = names.select(F.col("text").alias("name"), sorted_words(F.col("text")).alias("text")).distinct()
    right = vocabulary.select(F.col("text").alias("entry"), sorted_words(F.col("text")).alias("text")).distinct()
    # candidates are found on the sorted form, once per distinct form
    pairs = candidates(left, right, threshold, plain=True).withColumn("score", token_sort_udf("a", "b")).filter(
        F.col("score") >= threshold
    )
    named = (
        pairs.join(left.withColumnRenamed("text", "a"), "a")
        .join(right.withColumnRenamed("text", "b"), "b")
    )
    return named.groupBy(F.col("name").alias("text")).agg(
        F.min_by(F.struct("entry", "score"), F.struct(-F.col("score"), F.col("entry"))).alias("hit")
    ).select("text", F.col("hit.entry").alias("entry"), F.col("hit.score").alias("score"))


def evaluate_vocabulary(matches: DataFrame, names: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """True/false positives, missed entries, precision, recall and F1 in one row."""
    name_rows = names.join(matches.select("text", "entry"), "text", "left").agg(
        F.count("entry").alias("tp"), F.count_if(F.col("entry").isNull()).alias("fp")
    )
    used = matches.select(F.col("entry").alias("text")).distinct()
    missed = vocabulary.join(used, "text", "left_anti").agg(F.count(F.lit(1)).alias("fn")).scalar()
    row = name_rows.withColumn("fn", missed)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = F.lit(0.0)
    row = row.withColumn("precision", F.when(tp + fp > 0, tp / (tp + fp)).otherwise(zero)).withColumn(
        "recall", F.when(tp + fn > 0, tp / (tp + fn)).otherwise(zero)
    )
    both = F.col("precision") + F.col("recall")
    return row.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(zero))
