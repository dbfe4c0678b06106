"""Similarity join of documents on the Jaccard coefficient of their word n-grams.

Rare-first prefix filtering: the n-grams of a document are ordered from rare to
frequent; two sets that reach the threshold share an n-gram among the first
``n - ceil(t n) + 1`` of each.  How frequent n-grams are is counted over all documents in a
table of ``counters`` hashed counters (a fixed size, summed in two steps, sent to the
workers as one byte per counter).  Equal counts are ordered by hash, so every document
uses one total order and the filter loses nothing, however coarse the counts are.

Steps:

1. Equal sets are collapsed into a class, represented by its smallest ``doc_id``.
2. Prefix n-grams held by several classes are joined with their *centre* only, the
   class in which the n-gram stands first.  A group of m alike texts costs m - 1
   comparisons there, not m^2.
3. Links found connect classes to components.  Pairs that share a prefix n-gram but lie
   in different components are joined as well.  Pairs inside a component cannot change
   the components; they are joined where links are counted, and left out with
   ``all_links=False``, where only components are asked for.  A block of such pairs is one
   n-gram and two of the salts that the texts holding it are dealt to, so that no task
   gets all pairs of a frequent n-gram.
4. Length, positional and suffix filters act before a pair is verified.  The suffix
   filter compares how many n-grams the two sets have in each of eight hash ranges: the
   differences add up to a lower bound of the symmetric difference.
5. Each remaining pair is verified once on its real words.
6. Every link lies inside a component.  Where links are counted, the classes of a component
   are dealt into blocks of ``_LINK_ROWS``; two blocks meet in a task, which compares them as
   matrices of n-gram hashes and gives one number per class, never a row per pair.  With
   ``all_links=False``, where only components are asked for, this step is left out.

Lengths and thresholds are whole numbers, so no pair is lost to rounding.  N-grams are
named by 64-bit hashes when candidates are searched and classes are formed (128 bits
over the whole set); links are decided on the words themselves.

Cases: null or empty texts, and texts without words, have the empty set and no links;
texts of fewer words than ``words`` have their whole sequence as one n-gram; repeated
rows are kept, each with the component of its text; rows that share a ``doc_id`` are one
document, linked as soon as one of their texts is; rows with a null ``doc_id`` get the component of an
equal set, if there is one, and are otherwise alone (null); other columns are ignored; an empty table gives
no rows.  A very long text is one array of hashes in a worker.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from skillweft.llm.components import components, stored
from skillweft.llm.worker import bound_batches, process_cache, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BLOCKS = 16  # the counters travel in so many rows
_RANGES = 8  # of the suffix filter
_CENTRE_ROWS = 200  # rows compared with one copy of a centre
_BLOCK_ROWS = 500  # rows of an n-gram in a block
_LINK_ROWS = 200  # classes of a component in a block
_LINK_TOKENS = 50_000  # n-grams of two blocks that are compared at once
_SENT_ROWS = 1_000_000  # at most so many rows of four numbers are broadcast


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text_bytes(text).lower().split()


def ngram_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    count = len(words) - size + 1
    mixed = np.full(count, size, np.uint64)
    for j in range(size):
        mixed = (mixed ^ hashes[j : j + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def ngram_set(text: str | None, size: int) -> set:
    """The n-grams themselves."""
    words = words_of(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[j:] for j in range(size))))


def _count_ngrams(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """How often n-grams fall on each counter, as eighths of a power of two."""
    block = 1 << (bits - _BLOCKS.bit_length() + 1)
    shift = np.uint64(64 - bits)
    schema = "block int, salt int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_cache("ngrams")
        counts = np.zeros(1 << bits, np.int64)
        waiting, held = [], 0

        def add():
            nonlocal held
            if waiting:
                at, n = np.unique((np.concatenate(waiting) >> shift).astype(np.int64), return_counts=True)
                counts[at] += n
                waiting.clear()
                held = 0

        for batch in batches:
            for text in batch.column(0):
                found = ngram_hashes(words_of(text.as_py()), size)
                waiting.append(found)
                held += len(found)
                if held > 500_000:
                    add()
        add()
        if counts.any():
            salt = TaskContext.get().partitionId() % 64
            yield _packed([(b, salt, counts[b * block : (b + 1) * block]) for b in range(_BLOCKS)])

    def _packed(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
            pa.array([zlib.compress(r[2].astype("<i8").tobytes(), 1) for r in rows], pa.binary()),
        ], ["block", "salt", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                found = np.frombuffer(zlib.decompress(packed), "<i8")
                sums[b] = sums[b] + found if b in sums else found
        if sums:
            yield _packed([(b, 0, s) for b, s in sums.items()])

    parts = docs.select("text").mapInArrow(count, schema)
    some = parts.repartition(F.col("block"), F.col("salt")).mapInArrow(total, schema)
    whole = some.repartition(F.col("block")).mapInArrow(total, schema)
    result = np.zeros(1 << bits, np.uint8)
    for row in whole.collect():  # one row per block of a fixed number of counters
        found = np.frombuffer(zlib.decompress(row["counts"]), "<i8")
        result[row["block"] * block : (row["block"] + 1) * block] = np.minimum(np.log2(found + 1) * 4, 255)
    return result


def _prefixes(docs: DataFrame, size: int, percent: int, frequency: np.ndarray, bits: int) -> DataFrame:
    """Per document: size of its set, digest, rarest n-grams in order, n-grams per hash range."""
    sent = docs.sparkSession.sparkContext.broadcast(frequency)
    shift = np.uint64(64 - bits)
    schema = "doc_id bigint, n bigint, digest binary, tokens array<bigint>, ranges array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        often = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, digests, tokens, ranges = [], [], [], []
            for text in batch.column(1):
                found = ngram_hashes(words_of(text.as_py()), size)
                n = len(found)
                numbers.append(n)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if n else None)
                keep = n - -(-percent * n // 100) + 1 if n else 0
                order = np.lexsort((found, often[(found >> shift).astype(np.int64)]))
                tokens.append(found[order[:keep]].view(np.int64))
                # the lowest bits are independent of the counters' bits
                ranges.append(np.bincount((found & np.uint64(_RANGES - 1)).astype(np.int64), minlength=_RANGES))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(numbers, pa.int64()), pa.array(digests, pa.binary()),
                pa.array(tokens, pa.list_(pa.int64())), pa.array(ranges, pa.list_(pa.int32())),
            ], ["doc_id", "n", "digest", "tokens", "ranges"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _overlap(na: Column, nb: Column, percent: int) -> Column:
    """Shared n-grams that the threshold asks for: ceil(percent (na + nb) / (100 + percent))."""
    return F.ceil(percent * (na + nb) / F.lit(100 + percent) - 1e-9)


def _passes(a: str, b: str, percent: int) -> Column:
    """Length and positional filter of two prefix entries."""
    na, nb, pa_, pb = F.col(f"{a}n"), F.col(f"{b}n"), F.col(f"{a}pos"), F.col(f"{b}pos")
    length = (100 * F.least(na, nb)) >= (percent * F.greatest(na, nb))
    return length & (F.least(na - pa_, nb - pb) >= _overlap(na, nb, percent))


def _suffix_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes per hash range allow the overlap asked for."""
    side = classes.select("rep", "n", "ranges")
    with_a = pairs.join(side.select(*[F.col(c).alias(f"a_{c}") for c in side.columns]), F.col("a") == F.col("a_rep"))
    with_b = with_a.join(side.select(*[F.col(c).alias(f"b_{c}") for c in side.columns]), F.col("b") == F.col("b_rep"))
    apart = sum(F.abs(F.get("a_ranges", F.lit(i)) - F.get("b_ranges", F.lit(i))) for i in range(_RANGES))
    room = F.col("a_n") + F.col("b_n") - 2 * _overlap(F.col("a_n"), F.col("b_n"), percent)
    return with_b.filter(apart <= room).select("a", "b")


def _verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their words.

    Rows are sorted so that a centre ``a`` comes before the texts compared with it; a
    worker holds one centre.  A centre with many partners is copied, so that no task
    gets more than ``_CENTRE_ROWS`` of them in a row.
    """
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(_CENTRE_ROWS)).alias("copies"))
    salted = pairs.join(copies, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("copies")))
    partners = salted.select("a", "salt", F.lit(1).alias("kind"), F.col("b").alias("id"))
    centres = copies.select(
        "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("salt"),
        F.lit(0).alias("kind"), F.col("a").alias("id"),
    )
    wanted = partners.unionByName(centres)
    if wanted.count() <= _SENT_ROWS:  # else the texts are shuffled to their rows
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    rows = texts.join(wanted, "id").select("a", "salt", "kind", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, []
        for batch in batches:
            a, salt, kind, ids = (batch.column(i).to_pylist() for i in range(4))
            left, right = [], []
            for i, text in enumerate(batch.column(4)):
                if (a[i], salt[i]) != key:
                    key, centre = (a[i], salt[i]), []
                own = ngram_set(text.as_py(), size)
                if not kind[i]:
                    centre.append(own)
                    continue
                for other in centre:
                    both = len(own & other)
                    if both and 100 * both >= percent * (len(own) + len(other) - both):
                        left.append(a[i])
                        right.append(ids[i])
                        break
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"]
            )

    sorted_rows = rows.repartition(F.col("a"), F.col("salt")).sortWithinPartitions("a", "salt", "kind")
    return sorted_rows.mapInArrow(run, "a bigint, b bigint")


def _apart_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a prefix n-gram and pass the filters.

    ``rows`` has ``token``, ``doc``, ``n``, ``pos`` and ``component``.  A token with many rows is dealt
    into blocks that meet two by two.
    """
    held = rows.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(
        "token", F.ceil(F.col("rows") / F.lit(_BLOCK_ROWS)).alias("salts")
    )
    rows = rows.join(stored(held, "ngram-held"), "token").withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("salts")))
    # a row meets every salt: as the lower one on the left, as the higher one on the right
    others = F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)
    columns = ("doc", "n", "pos", "component")
    left = rows.select(
        "token", F.col("salt").alias("low"), F.explode(F.filter(others, lambda o: o >= F.col("salt"))).alias("high"),
        *[F.col(c).alias(f"l_{c}") for c in columns],
    )
    right = rows.select(
        "token", F.explode(F.filter(others, lambda o: o <= F.col("salt"))).alias("low"), F.col("salt").alias("high"),
        *[F.col(c).alias(f"r_{c}") for c in columns],
    )
    met = left.join(right, ["token", "low", "high"])
    met = met.filter((F.col("low") < F.col("high")) | (F.col("l_doc") < F.col("r_doc"))).filter(
        (F.col("l_component") != F.col("r_component")) & _passes("l_", "r_", percent))
    return met.select(F.least("l_doc", "r_doc").alias("a"), F.greatest("l_doc", "r_doc").alias("b")).distinct()


def block_links(left: list[list[np.ndarray]], right: list[list[np.ndarray]], percent: int) -> np.ndarray:
    """Which entries link; an entry is the sorted n-gram hashes of one or more texts, any of which may link."""
    flat = [*((0, i, t) for i, own in enumerate(left) for t in own), *((1, i, t) for i, own in enumerate(right) for t in own)]
    side = np.array([f[0] for f in flat])
    owner = np.array([f[1] for f in flat])
    sizes = np.array([len(f[2]) for f in flat])
    tokens, number, often = np.unique(np.concatenate([f[2] for f in flat]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(flat)), sizes)
    shared = often[number] > 1  # the others meet nobody
    place = np.cumsum(often > 1) - 1
    row, number = row[shared], place[number[shared]]
    lefts, rights = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    both = np.zeros((len(lefts), len(rights)), np.int64)
    at = np.zeros(len(flat), np.int64)
    at[lefts], at[rights] = np.arange(len(lefts)), np.arange(len(rights))
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    end = int(number[-1]) + 1 if len(number) else 0
    for low in range(0, end, _LINK_TOKENS):
        width = min(_LINK_TOKENS, end - low)
        a, b = np.searchsorted(number, [low, low + width])
        masks = [np.zeros((n, width), np.float32) for n in (len(lefts), len(rights))]
        for which in (0, 1):
            mine = side[row[a:b]] == which
            masks[which][at[row[a:b][mine]], number[a:b][mine] - low] = 1
        both += np.rint(masks[0] @ masks[1].T).astype(np.int64)
    union = sizes[lefts][:, None] + sizes[rights][None, :] - both
    linked = np.zeros((len(left), len(right)), bool)
    i, j = np.nonzero((both > 0) & (100 * both >= percent * union))
    linked[owner[lefts][i], owner[rights][j]] = True
    return linked


def _degrees(components_of: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``rep`` and ``n_links`` of all classes in a component: (node, component)."""
    sizes = components_of.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    placed = stored(components_of.join(sizes, "component"), "ngram-members")
    two = placed.filter("members = 2").select(F.col("node").alias("rep"), F.lit(1).cast("bigint").alias("n_links"))
    many = placed.filter("members > 2").withColumn("blocks", F.ceil(F.col("members") / F.lit(_LINK_ROWS)))
    salt = F.pmod(F.xxhash64("node"), F.col("blocks"))
    wanted = many.select(
        F.col("node").alias("id"), "component", salt.alias("salt"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"),
    ).select("id", "component", "salt", F.least("salt", "other").alias("low"), F.greatest("salt", "other").alias("high"))
    if wanted.count() <= _SENT_ROWS:  # else the texts are shuffled to their rows
        wanted = F.broadcast(wanted)
    keys = ["component", "low", "high"]
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id").select(*keys, "salt", "id", "text")

    def links(key, entries) -> list[tuple[int, int]]:
        ids = sorted(entries)
        low = [i for i in ids if entries[i][0] == key[1]]
        high = [i for i in ids if entries[i][0] == key[2]]
        if not low or not high:
            return []
        linked = block_links([entries[i][1] for i in low], [entries[i][1] for i in high], percent)
        if key[1] == key[2]:
            np.fill_diagonal(linked, False)
            return list(zip(low, linked.sum(axis=1).tolist()))
        return [*zip(low, linked.sum(axis=1).tolist()), *zip(high, linked.sum(axis=0).tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entries = None, {}

        def out(found):
            found = [f for f in found if f[1]]
            columns = list(zip(*found)) if found else [[], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "n_links"])

        for batch in batches:
            component, low, high, salts, ids = (batch.column(i).to_pylist() for i in range(5))
            for i, text in enumerate(batch.column(5)):
                if (component[i], low[i], high[i]) != key:
                    if entries:
                        yield out(links(key, entries))
                    key, entries = (component[i], low[i], high[i]), {}
                found = ngram_hashes(words_of(text.as_py()), size)
                if len(found):
                    entries.setdefault(ids[i], (salts[i], []))[1].append(found)
        if entries:
            yield out(links(key, entries))

    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    counted = sorted_rows.mapInArrow(run, "rep bigint, n_links bigint").groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    return two.unionByName(counted)


def similarity_classes(
    docs: DataFrame, words: int = 5, percent: int = 80, counter_bits: int = 22, all_links: bool = True
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``class_id`` (smallest ``doc_id`` of its
    equal sets), ``n_links`` of its class (links with other classes) and ``component_id``.
    ``n_links`` is left out without ``all_links``; the rest is the same.

    Two documents link when ``100 * intersection >= percent * union``.
    """
    docs = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    bound_batches(docs.sparkSession)
    frequency = _count_ngrams(docs, words, counter_bits)
    prefixes = stored(_prefixes(docs, words, percent, frequency, counter_bits), "ngram-prefixes")
    named = prefixes.filter("doc_id is not null and n > 0")
    classes = named.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "tokens", "ranges")).alias("one"))
    classes = stored(
        classes.select("digest", F.col("one.doc_id").alias("rep"), "one.n", "one.tokens", "one.ranges"),
        "ngram-classes",
    )
    # different sets of n and n + 1 or more n-grams cannot link below this size
    able = classes.filter(F.col("n") * 100 >= (F.col("n") + 1) * percent)
    entries = able.select(F.posexplode("tokens").alias("pos", "token"), F.col("rep").alias("doc"), "n")
    centre = entries.groupBy("token").agg(
        F.min(F.struct("pos", "n", "doc")).alias("centre"), F.count(F.lit(1)).alias("held")
    ).filter("held > 1").select(
        "token", F.col("centre.pos").alias("c_pos"), F.col("centre.n").alias("c_n"),
        F.col("centre.doc").alias("c_doc"),
    )
    # stored before it is joined back: a join of two plain tables can split hot n-grams
    shared = stored(entries.join(stored(centre, "ngram-centres"), "token"), "ngram-entries")
    near = shared.withColumnsRenamed({"pos": "e_pos", "n": "e_n", "doc": "e_doc"})
    first = near.filter("e_doc <> c_doc").filter(_passes("e_", "c_", percent))
    first = first.select(F.col("c_doc").alias("a"), F.col("e_doc").alias("b"))
    first = first.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(
        F.min("a").alias("a")  # each pair once, the centre first
    ).select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))
    first = stored(_suffix_filter(first, classes, percent), "ngram-pairs")
    links = stored(_verify(first, docs, words, percent).distinct(), "ngram-links")
    joined = components(links, "ngram-components")

    # pairs that no centre has connected
    node = joined.select(F.col("node").alias("doc"), "component")
    placed = shared.join(node, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    split = placed.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low < high").select("token")
    open_rows = placed.join(split, "token", "left_semi").filter("doc <> c_doc").select(
        "token", "doc", "n", "pos", "component"
    )
    rest = _apart_pairs(stored(open_rows, "ngram-open"), percent)
    rest = rest.join(  # verified already
        first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"
    )
    rest = stored(_suffix_filter(rest, classes, percent), "ngram-pairs")
    more = stored(_verify(rest, docs, words, percent).distinct(), "ngram-links")
    if more.isEmpty():
        final = joined
    else:
        final = components(
            more.union(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))), "ngram-components"
        )
    if not all_links:
        about = classes.select("digest", "rep").join(
            final.select(F.col("node").alias("rep"), "component"), "rep", "left"
        )
        rows = prefixes.select("doc_id", F.col("n").alias("n_shingles"), "digest")
        return rows.join(about, "digest", "left").select(
            "doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"),
            F.coalesce("component", "rep", "doc_id").alias("component_id"),
        )
    degree = stored(_degrees(final.select("node", "component"), docs, words, percent), "ngram-degrees")
    about = (
        classes.select("digest", "rep")
        .join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .join(degree, "rep", "left")
    )
    rows = prefixes.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    return rows.join(about, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("component", "rep", "doc_id").alias("component_id"),
    )


def keep_one_per_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest ``doc_id``; columns as they are.

    Of rows that share a ``doc_id`` one stays.  Rows without a ``doc_id`` stay, one of
    each text, unless a document with an id has an equal set of n-grams.
    """
    found = similarity_classes(docs, words, percent, all_links=False)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    kept = docs.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    kept = kept.join(gone, kept["doc_id"] == gone["gone_id"], "left_anti")
    unnamed = docs.filter(F.col("doc_id").isNull()).dropDuplicates(["text"])
    copies = docs.filter(F.col("doc_id").isNotNull()).select(F.col("text").alias("other")).distinct()
    unnamed = unnamed.join(copies, unnamed["text"] == copies["other"], "left_anti")
    return kept.unionByName(unnamed)
