r"""Hard negatives by exact search in a GNAT-style multiway hyperplane tree.

Vectors become whole numbers, ``floor(scale * x)``, and a row's score is its inner product
with the anchor.  One more coordinate, ``sqrt(M^2 - |x|^2)`` with ``M`` the longest row,
puts all rows on a sphere; an anchor has 0 there.  Its distance to a row is then
``sqrt(|a|^2 + M^2 - 2 * score)``: scores between two bounds are an annulus around it.

Every inner node of the tree has up to ``fanout`` split points; a row belongs to the
nearest one.  Each split point stores, for itself and every sibling subtree, the least and
greatest distance to the rows there.  A subtree is left out as soon as one split point's
range does not meet the distances that the annulus allows; the rows of the leaves that
remain are all scored, so the search is exact.

The split points come from ``sample`` rows at most (least hash of the id; a parameter):
this bounds the tree, which travels with the tasks.  All rows are indexed, and the ranges
cover all rows.  The scores of the sample rows give each search its first lower bound,
which narrows its annulus.

Two searches run one after another, for the positives (a ball) and for the negatives
(an annulus per positive).  Rows and anchors meet in blocks: a leaf of many rows is dealt
into blocks of ``ROW_BLOCK`` rows, the anchors that visit it into blocks of
``ANCHOR_BLOCK``, so that no task depends on the size of a leaf, of a label or of a group
of equal vectors.  A block gives every anchor its best few rows only, and ranks are taken
over those.

Cases: rows with a null label, a null vector or a component that is null or not finite
take no part; shorter vectors count as filled with zeros; every row counts for itself, also
rows that share an id; of equal scores the smaller id comes first, a null id last; scores are exact,
and beyond a 64-bit number they stop at its ends; other columns are ignored; an empty table,
or one without anchors, gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from skillweft.llm.components import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256
ROW_BLOCK, ANCHOR_BLOCK = 4096, 1024
NO_ID = np.iinfo(np.int64).max
LEAST, GREATEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

RESULT = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
)


def whole_numbers(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``floor(SCALE * x)`` as doubles, filled with zeros up to ``dims``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype("f8"))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return values.reshape(-1, dims)
    full = np.zeros((len(sizes), dims))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    full[rows, places] = values
    return full


def inner_products(left: np.ndarray, right: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of whole numbers of at most ``largest``; doubles only where they are exact."""
    bound = left.shape[1] * largest**2
    if bound < 2**53:
        return (left @ right.T).astype(np.int64)
    if bound < 2**63:
        return left.astype(np.int64) @ right.astype(np.int64).T
    exact = np.vectorize(int, otypes=[object])
    product = exact(left).dot(exact(right).T) if left.size and right.size else np.zeros((len(left), len(right)))
    return np.clip(product, LEAST, GREATEST).astype(np.int64)


class HyperplaneTree:
    """Split points, leaves and, once all rows are indexed, distance ranges between sibling subtrees."""

    def __init__(self, rows: np.ndarray, radius2: float, total: int, fanout: int, leaf_rows: int):
        self.radius2 = radius2
        self.fanout = fanout
        #: per inner node: its split points on the sphere, and per child (is a leaf, number)
        self.points: list[np.ndarray] = []
        self.children: list[list[tuple[bool, int]]] = []
        self.leaves = 0
        #: per inner node: least and greatest distance, [split point, child]
        self.ranges: list[tuple[np.ndarray, np.ndarray]] = []
        lifted = self.lift(np.unique(rows, axis=0)) if len(rows) else rows
        share = total / max(1, len(rows))
        self.root = self._build(lifted, share, leaf_rows, np.random.default_rng(0))

    def lift(self, rows: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.radius2 - np.einsum("ij,ij->i", rows, rows)))
        return np.concatenate([rows, rest[:, None]], axis=1)

    def _build(self, rows: np.ndarray, share: float, leaf_rows: int, rng) -> tuple[bool, int]:
        if len(rows) * share <= leaf_rows or len(rows) < 2 * self.fanout:
            self.leaves += 1
            return True, self.leaves - 1
        tried = rows[rng.permutation(len(rows))[: 3 * self.fanout]]
        chosen = [0]
        gap = self.distances(tried, tried[:1])[:, 0]
        while len(chosen) < self.fanout:  # each next one as far as possible from those before
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, self.distances(tried, tried[chosen[-1:]])[:, 0])
        points = tried[chosen]
        number = len(self.points)
        self.points.append(points)
        self.children.append([])
        nearest = self.distances(rows, points).argmin(axis=1)
        self.children[number] = [
            self._build(rows[nearest == k], share, leaf_rows, rng) for k in range(len(points))
        ]
        return False, number

    @staticmethod
    def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        squares = (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None, :] - 2 * (left @ right.T)
        return np.sqrt(np.maximum(0.0, squares))

    def index(self, rows: np.ndarray, seen: dict | None = None) -> np.ndarray:
        """Leaf of every row; ``seen`` collects the ranges per (node, split point, child)."""
        lifted = self.lift(rows)
        leaf = np.zeros(len(rows), np.int64)
        stack = [(self.root, np.arange(len(rows)))]
        while stack:
            (is_leaf, number), own = stack.pop()
            if is_leaf:
                leaf[own] = number
                continue
            if not len(own):
                continue
            apart = self.distances(lifted[own], self.points[number])
            nearest = apart.argmin(axis=1)
            for k, child in enumerate(self.children[number]):
                there = nearest == k
                if there.any():
                    stack.append((child, own[there]))
                    if seen is not None:
                        least, most = apart[there].min(axis=0), apart[there].max(axis=0)
                        for i in range(len(least)):
                            low, high = seen.get((number, i, k), (np.inf, -np.inf))
                            seen[number, i, k] = (min(low, least[i]), max(high, most[i]))
        return leaf

    def set_ranges(self, found) -> None:
        """``found``: (node, split point, child, least, greatest) over all rows; children without rows meet nothing."""
        self.ranges = [
            (np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)) for p in self.points
        ]
        for node, point, child, least, most in found:
            self.ranges[node][0][point, child] = least
            self.ranges[node][1][point, child] = most

    def visits(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, places of the anchors that have to look there) for scores from ``low`` to ``high``."""
        own2 = np.einsum("ij,ij->i", anchors, anchors)
        margin = 1e-6 * np.sqrt(self.radius2) + 1e-9
        outer = np.sqrt(np.maximum(0.0, own2 + self.radius2 - 2 * low)) + margin
        inner = np.sqrt(np.maximum(0.0, own2 + self.radius2 - 2 * high)) - margin
        lifted = np.concatenate([anchors, np.zeros((len(anchors), 1))], axis=1)
        stack = [(self.root, np.flatnonzero(low <= high))]
        while stack:
            (is_leaf, number), own = stack.pop()
            if not len(own):
                continue
            if is_leaf:
                yield number, own
                continue
            apart = self.distances(lifted[own], self.points[number])[:, :, None]
            least, most = self.ranges[number]
            out, into = outer[own][:, None, None], inner[own][:, None, None]
            meets = (least <= apart + out) & (most >= np.maximum(apart - out, into - apart))
            alive = meets.all(axis=1)
            stack += [(child, own[alive[:, k]]) for k, child in enumerate(self.children[number])]


def best_rows(scores: np.ndarray, ids: np.ndarray, rids: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` rows: higher score, smaller id, smaller row number."""
    if len(scores) > 4 * count:
        bar = np.partition(scores, len(scores) - count)[len(scores) - count]
        near = np.flatnonzero(scores >= bar)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((rids[near], ids[near], ~scores[near]))][:count]


class _Search:
    """What the tasks of one search know: the tree, the sample rows and the sizes of things."""

    def __init__(self, tree, sample, labels, rids, dims, largest):
        self.tree, self.dims, self.largest = tree, dims, largest
        self.sample, self.labels, self.rids = sample, labels, rids

    def scores(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return inner_products(anchors, rows, self.largest)


def _usable(vectors: DataFrame, anchors: Column, extra: Column) -> DataFrame:
    """Rows that take part: ``id``, ``label``, ``vector`` and whether they are an anchor."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & ~bad).select(
        F.col("vec_id").cast("bigint").alias("id"), extra.cast("bigint").alias("label"),
        F.col("embedding").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
    ).filter(F.col("label").isNotNull())


def _blocks(rows: DataFrame, visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and visits with the same keys (leaf, block, turn); leaves without visits are gone."""
    sizes = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).alias("row_blocks"))
    guests = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / ANCHOR_BLOCK).alias("anchor_blocks"))
    # one row per leaf: bounded by the sample
    plan = F.broadcast(sizes.join(guests, "leaf"))
    rows = rows.join(plan, "leaf").select(
        "leaf", (F.col("rid") % F.col("row_blocks")).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("anchor_blocks") - 1)).alias("turn"),
        "rid", "id", "label", "vector",
    )
    visits = visits.join(plan, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("row_blocks") - 1)).alias("block"),
        (F.xxhash64("rid") % F.col("anchor_blocks") + F.col("anchor_blocks")).alias("turn"),
        *[c for c in visits.columns if c != "leaf"], "anchor_blocks",
    )
    return rows, visits.withColumn("turn", F.col("turn") % F.col("anchor_blocks")).drop("anchor_blocks")


def _meet(rows: DataFrame, visits: DataFrame, scan, schema: str) -> DataFrame:
    rows, visits = _blocks(rows, stored(visits, "visits"))
    keys = ["leaf", "block", "turn"]
    return visits.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(scan, schema)


def _ids(column) -> np.ndarray:
    return column.combine_chunks().fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def _id(value):
    return None if value == NO_ID else int(value)


def build_index(rows: DataFrame, sample: int, fanout: int, leaf_rows: int):
    """(stored rows with ``rid`` and ``leaf``, search); nothing for an empty table."""
    spark = rows.sparkSession
    whole = F.transform("vector", lambda x: F.floor(SCALE * x.cast("double")).cast("double"))
    total, dims, radius2, largest = rows.agg(
        F.count(F.lit(1)), F.max(F.size("vector")),
        F.max(F.aggregate(whole, F.lit(0.0), lambda a, x: a + x * x)),
        F.max(F.array_max(F.transform(whole, lambda x: F.abs(x)))),
    ).first()
    if not total:
        return None
    dims, largest = max(1, dims), largest or 0.0
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
    tree = HyperplaneTree(whole_numbers(taken["vector"], dims), radius2, total, fanout, leaf_rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            leaf = tree.index(whole_numbers(batch.column(2), dims))
            numbers = pa.array(np.arange(rid, rid + len(leaf)))
            rid += len(leaf)
            yield pa.RecordBatch.from_arrays([numbers, pa.array(leaf), *batch.columns], names=["rid", "leaf", *batch.schema.names])

    kind = rows.schema["vector"].dataType.simpleString()
    indexed = stored(
        rows.mapInArrow(place, f"rid bigint, leaf bigint, id bigint, label bigint, vector {kind}, anchor boolean"), "vectors"
    )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            tree.index(whole_numbers(batch.column(0), dims), seen)
        if seen:
            columns = list(zip(*((*key, *span) for key, span in seen.items())))
            kinds = [pa.int64()] * 3 + [pa.float64()] * 2
            names = ["node", "point", "child", "least", "most"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    ranges = (
        indexed.select("vector").mapInArrow(spread, "node bigint, point bigint, child bigint, least double, most double")
        .groupBy("node", "point", "child").agg(F.min("least"), F.max("most"))
    )
    # bounded by the tree: fanout^2 rows per inner node
    tree.set_ranges([tuple(r) for r in ranges.collect()])
    known = indexed.orderBy(F.xxhash64("id"), "id", "rid").limit(sample).select("rid", "label", "vector").toArrow()
    search = _Search(
        tree, whole_numbers(known["vector"], dims), known["label"].to_numpy(), known["rid"].to_numpy(), dims, largest
    )
    return indexed, search


def _nth(scores: np.ndarray, allowed: np.ndarray, n: int) -> np.ndarray:
    """The n-th highest allowed score of each row; the lowest number where there are fewer."""
    held = np.where(allowed, scores, LEAST)
    if held.shape[1] < n:
        return np.full(len(held), LEAST)
    return np.partition(held, held.shape[1] - n, axis=1)[:, held.shape[1] - n]


def find_positives(indexed: DataFrame, search: _Search, count: int) -> DataFrame:
    """``rid`` and ``id`` of each anchor with its ``count`` best other rows of its label: ``place``, ``positive_id``, ``score``."""
    kind = indexed.schema["vector"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                anchors = whole_numbers(part.column(3), search.dims)
                labels, rids = part.column(2).to_numpy(), part.column(0).to_numpy()
                near = search.scores(anchors, search.sample)
                same = (labels[:, None] == search.labels[None, :]) & (rids[:, None] != search.rids[None, :])
                low = _nth(near, same, count).astype("f8")
                for leaf, own in search.tree.visits(anchors, low, np.full(len(low), np.inf)):
                    chosen = part.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), leaf)), *chosen.columns], names=["leaf", *part.schema.names]
                    )

    visits = indexed.filter("anchor").select("rid", "id", "label", "vector").mapInArrow(
        route, f"leaf bigint, rid bigint, id bigint, label bigint, vector {kind}"
    )

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            anchors, rows = (whole_numbers(t["vector"], search.dims) for t in (left, right))
            scores = search.scores(anchors, rows)
            ids, rids, labels = _ids(right["id"]), right["rid"].to_numpy(), right["label"].to_numpy()
            guests = zip(left["rid"].to_pylist(), left["id"].to_pylist(), left["label"].to_pylist())
            for (rid, own, label), line in zip(guests, scores):
                there = np.flatnonzero((labels == label) & (rids != rid))
                for k in there[best_rows(line[there], ids[there], rids[there], count)]:
                    found.append((rid, own, _id(ids[k]), int(rids[k]), int(line[k])))
        columns = list(zip(*found)) if found else [[]] * 5
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("rid", "id", "positive_id", "positive_rid", "score"), columns)})

    met = _meet(indexed, visits, scan, "rid bigint, id bigint, positive_id bigint, positive_rid bigint, score bigint")
    order = Window.partitionBy("rid").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"), "positive_rid")
    return met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= count)


def mine_hard_negatives(
    vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, sample: int = 8192, fanout: int = 8, leaf_rows: int = 2048,
) -> DataFrame:
    """For each anchor and each of its positives the best rows of other labels inside the positive's window.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label`` (or the expression ``label``);
    ``anchors`` marks the rows to mine for.  A negative's score lies between ``low`` and
    ``high`` percent of the positive's.  Columns: see ``RESULT``; ``rank`` counts from 1.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, anchors, F.col("label") if label is None else label)
    built = build_index(rows, sample, fanout, leaf_rows)
    if built is None:
        return spark.createDataFrame([], RESULT)
    indexed, search = built
    kind = indexed.schema["vector"].dataType.simpleString()
    paired = stored(find_positives(indexed, search, positives), "positives")
    windows = paired.groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("windows")  # at most ``positives``
    )
    asked = indexed.filter("anchor").select("rid", "id", "label", "vector").join(windows, "rid")
    window_kind = "array<struct<place:int,positive_id:bigint,score:bigint>>"

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                anchors = whole_numbers(part.column(3), search.dims)
                other = part.column(2).to_numpy()[:, None] != search.labels[None, :]
                near = search.scores(anchors, search.sample)
                # equal bounds are searched once; a leaf is visited for all windows that need it
                asked_scores = [[w["score"] for w in x] for x in part.column(4).to_pylist()]
                visitors: dict[int, set] = {}
                for k in range(positives):
                    own = np.array([j for j, x in enumerate(asked_scores) if len(x) > k], np.int64)
                    if not len(own):
                        continue
                    score = np.array([asked_scores[j][k] for j in own], dtype=object)
                    least = np.array([-((-low * s) // 100) for s in score], dtype="f8")
                    most = np.array([(high * s) // 100 for s in score], dtype="f8")
                    allowed = other[own] & (near[own] >= least[:, None]) & (near[own] <= most[:, None])
                    bar = np.maximum(least, _nth(near[own], allowed, negatives).astype("f8"))
                    bar = np.where(least <= most, bar, np.inf)
                    for leaf, there in search.tree.visits(anchors[own], bar, most):
                        visitors.setdefault(leaf, set()).update(own[there].tolist())
                for leaf, there in sorted(visitors.items()):
                    chosen = part.take(pa.array(sorted(there)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(chosen.num_rows, leaf)), *chosen.columns], names=["leaf", *part.schema.names]
                    )

    visits = asked.mapInArrow(
        route, f"leaf bigint, rid bigint, id bigint, label bigint, vector {kind}, windows {window_kind}"
    )

    names = ["rid", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_rid", "negative_score"]

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            anchors, rows = (whole_numbers(t["vector"], search.dims) for t in (left, right))
            scores = search.scores(anchors, rows)
            ids, rids, labels = _ids(right["id"]), right["rid"].to_numpy(), right["label"].to_numpy()
            guests = zip(*(left[c].to_pylist() for c in ("rid", "id", "label", "windows")))
            for (rid, own, label, wanted), line in zip(guests, scores):
                other = labels != label
                for w in wanted:
                    least, most = -((-low * w["score"]) // 100), (high * w["score"]) // 100
                    there = np.flatnonzero(other & (line >= least) & (line <= most))
                    for k in there[best_rows(line[there], ids[there], rids[there], negatives)]:
                        found.append((rid, own, w["place"], w["positive_id"], w["score"], _id(ids[k]), int(rids[k]), int(line[k])))
        columns = list(zip(*found)) if found else [[]] * len(names)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    met = _meet(indexed, visits, scan, ", ".join(f"{n} bigint" for n in names))
    order = Window.partitionBy("rid", "place").orderBy(
        F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_rid"
    )
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
