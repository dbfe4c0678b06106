"""Joins on 'the text contains the phrase' without comparing every pair.

Whole-word phrases are joined on the stretch of words itself.  Otherwise every phrase is
joined on one anchor that the text must contain: a piece of 1, 2, 4, 8 or 16 letters, the
longest that fits into it, for plain containment, a word for phrases with other characters
at an end.  The anchor is the one that the fewest texts have, so frequent words do not
create hot keys as long as a phrase has any rarer part.  The full condition is then tested
on the surviving pairs only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skillweft.session import cut_lineage

PIECES = (16, 8, 4, 2, 1)
FEW = 200_000  # keys of phrases that are sent to the texts, which then need no shuffle


def pieces(text: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """All distinct substrings of the given lengths, found in one pass per length."""
    found = [
        F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes
    ]
    return F.array_distinct(F.concat(*found))


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1)))


def _piece_size(text: Column) -> Column:
    """Length of the pieces that stand for a text of at least one letter."""
    return F.coalesce(*[F.when(F.length(text) >= n, F.lit(n)) for n in PIECES])


def _own_pieces(text: Column) -> Column:
    return F.coalesce(*[F.when(F.length(text) >= n, pieces(text, (n,))) for n in PIECES])


def _sizes(rows: DataFrame, sizes: Column) -> tuple[int, ...]:
    """The piece lengths that occur, five at most."""
    found = rows.select(F.explode(F.array_distinct(sizes)).alias("n")).distinct().collect()
    return tuple(sorted(r[0] for r in found)) or (1,)


def _anchored(texts: DataFrame, text_keys: Column, phrases: DataFrame, phrase_keys: Column) -> DataFrame:
    """Pairs (text, phrase) that share the phrase's rarest key.

    A few phrases go to the texts.  Of many, two hashes stand for a text while its keys are
    shuffled; keys that no phrase has go first, and the text comes back for the pairs that
    are left.
    """
    named = texts.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.reverse("text"), F.length("text"))})
    options = cut_lineage(phrases.select("phrase", F.explode(phrase_keys).alias("key")))
    few = options.count() <= FEW
    wanted = options.select("key").distinct()
    keyed_texts = named.select("t1", "t2", F.explode(text_keys).alias("key")).join(
        F.broadcast(wanted) if few else wanted, "key", "left_semi")
    counts = keyed_texts.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # an inner join: a key that no text has rules the phrase out only if it is required,
    # and every key of a phrase is required
    anchors = options.join(counts, "key", "left").groupBy("phrase").agg(
        F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key")
    )
    if few:
        return texts.select("text", F.explode(text_keys).alias("key")).join(
            F.broadcast(cut_lineage(anchors)), "key").select("text", "phrase")
    return keyed_texts.join(anchors, "key").select("t1", "t2", "phrase").join(named, ["t1", "t2"]).select(
        "text", "phrase"
    )


def contained_words(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(text, phrase): every blank-separated word of the phrase is a substring of the text."""
    texts, phrases = texts.select("text").distinct(), phrases.select("phrase").distinct()
    words = F.filter(F.split("phrase", " "), lambda w: w != "")
    keys = F.array_distinct(F.flatten(F.transform(words, _own_pieces)))
    sizes = _sizes(phrases, F.transform(words, _piece_size))
    pairs = _anchored(texts, pieces(F.col("text"), sizes), phrases, keys)
    return pairs.filter(F.forall(words, lambda w: F.contains(F.col("text"), w)))


def contained_phrases(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(text, phrase): the whole phrase is a substring of the text."""
    texts, phrases = texts.select("text").distinct(), phrases.filter(F.col("phrase") != "").select("phrase").distinct()
    sizes = _sizes(phrases, F.array(_piece_size(F.col("phrase"))))
    pairs = _anchored(texts, pieces(F.col("text"), sizes), phrases, _own_pieces(F.col("phrase")))
    return pairs.filter(F.contains(F.col("text"), F.col("phrase")))


_WORD = r"(?U)\w+"


def word_runs(text: Column, length: int) -> Column:
    """Distinct stretches of ``length`` consecutive words with what stands between them."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    if length == 1:
        return F.array_distinct(words)
    gaps = F.split(text, _WORD)

    def run(at: Column) -> Column:
        parts = [F.get(words, at)]
        for k in range(1, length):
            parts += [F.get(gaps, at + k), F.get(words, at + k)]
        return F.concat(*parts)

    starts = F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length))
    return F.array_distinct(F.transform(F.coalesce(starts, F.array().cast("array<int>")), run))


def whole_word_phrases(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(text, phrase): the phrase occurs in the text between word boundaries.

    A phrase that begins and ends with a word is a stretch of as many words of the text, so
    both meet on the stretch itself; only lengths that phrases have are cut out.  Phrases
    with other characters at an end are anchored on a word and tested.
    """
    texts, phrases = texts.select("text").distinct(), phrases.select("phrase").distinct()
    plain = F.rlike("phrase", F.lit(r"(?Us)\A\w(.*\w)?\z"))
    counted = phrases.filter(plain).withColumn("words", F.regexp_count("phrase", F.lit(_WORD)))
    lengths = sorted(r[0] for r in counted.select("words").distinct().collect())  # a handful of numbers
    found = _anchored(texts, words_of(F.col("text")), phrases.filter(~plain), words_of(F.col("phrase"))).filter(
        F.contains(F.col("text"), F.col("phrase"))
        & F.rlike(F.col("text"), F.concat(F.lit(r"(?U)\b\Q"), "phrase", F.lit(r"\E\b")))
    )
    if not lengths:
        return found
    # two hashes stand for a text while its stretches are shuffled
    named = texts.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.reverse("text"), F.length("text"))})
    runs = F.concat(*[word_runs(F.col("text"), n) for n in lengths])
    met = named.select("t1", "t2", F.explode(runs).alias("phrase")).join(counted.select("phrase"), "phrase")
    return met.join(named, ["t1", "t2"]).select("text", "phrase").union(found)


def longest_phrase(pairs: DataFrame) -> DataFrame:
    """One phrase per text: the longest, then the first by name."""
    return pairs.groupBy("text").agg(
        F.min_by("phrase", F.struct(-F.length("phrase"), F.col("phrase"))).alias("phrase")
    )
