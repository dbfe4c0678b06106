"""Connected components and stored intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skillweft.session import fresh_folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written as Parquet below the shared folder and read back.

    Lineage ends there, so a lost executor costs no recomputation of what is stored.
    """
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Smallest reachable node per node: ``node``, ``component`` for all nodes with an edge.

    ``edges`` has the columns ``a`` and ``b``; direction, repeats, loops and null ends do
    not matter (an edge with a null end is ignored).  Alternating large-star and
    small-star steps: every node hangs its larger neighbours, then itself and its
    smaller neighbours, on the smallest node it sees, until nothing changes.  The edges
    never grow in number, minima are combined before each shuffle, and the result of
    every round is stored.
    """

    def down(df: DataFrame) -> DataFrame:
        """Each edge once, from its larger end ``u`` to its smaller end ``v``."""
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = stored(down(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), label)
    before, after = None, state(now)
    while before != after:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(lowest, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            lowest.select("u", F.col("m").alias("v"))
        )
        now = stored(down(small), label)
        before, after = after, state(now)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
