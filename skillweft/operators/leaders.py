"""Ordered leader clustering over a similarity graph.

Names are taken one after another: a name joins the leader it resembles most, or becomes a
leader itself when it resembles none.  Instead of a loop over names the rounds below settle,
all at once, every name that has an earlier leader as neighbour (it follows) and every name
none of whose earlier neighbours is still open (it leads).  The first open name is always
settled, and chains settle from all their ends; names without a neighbour take no part.

Neighbours are given as scored pairs and as groups: members of a group resemble each other
fully.  Groups are never expanded into pairs, a round needs their first leader and first
open member only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skillweft.session import cut_lineage

OPEN, LEADS, FOLLOWS = 0, 1, 2


def settle(nodes: DataFrame, pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, rank, status) of all nodes; ``pairs`` are (later, earlier) and ``groups`` (node, key)."""
    crowded = groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    groups = cut_lineage(groups.join(crowded, "key", "left_semi"))
    linked = pairs.select(F.col("later").alias("node")).union(pairs.select("earlier")).union(groups.select("node")).distinct()
    now = cut_lineage(nodes.join(linked, "node", "left_semi").select("node", "rank", F.lit(OPEN).alias("status")))
    while not now.filter(F.col("status") == OPEN).isEmpty():
        by_pair = pairs.join(now.select(F.col("node").alias("earlier"), "status"), "earlier").groupBy(
            F.col("later").alias("node")
        ).agg(F.max(F.col("status") == LEADS).alias("led"), F.max(F.col("status") == OPEN).alias("waits"))
        members = groups.join(now, "node")
        firsts = members.groupBy("key").agg(
            F.min(F.when(F.col("status") == LEADS, F.col("rank"))).alias("first_leader"),
            F.min(F.when(F.col("status") == OPEN, F.col("rank"))).alias("first_open"),
        )
        by_group = members.join(firsts, "key").groupBy("node").agg(
            F.max(F.coalesce(F.col("first_leader") < F.col("rank"), F.lit(False))).alias("led"),
            F.max(F.coalesce(F.col("first_open") < F.col("rank"), F.lit(False))).alias("waits"),
        )
        seen = by_pair.unionByName(by_group).groupBy("node").agg(F.max("led").alias("led"), F.max("waits").alias("waits"))
        led, waits = (F.coalesce(c, F.lit(False)) for c in ("led", "waits"))
        status = F.when(F.col("status") != OPEN, F.col("status")).when(led, FOLLOWS).when(~waits, LEADS).otherwise(OPEN)
        now = cut_lineage(now.join(seen, "node", "left").select("node", "rank", status.alias("status")))
    return nodes.select("node", "rank").join(now.select("node", "status"), "node", "left").withColumn(
        "status", F.coalesce("status", F.lit(LEADS))
    )


def lead(nodes: DataFrame, pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, leader, score): each name with the leader it joins; leaders join themselves with 100.

    ``nodes`` are (node, rank), ranks being different; ``pairs`` (later, earlier, score), once
    per similar pair; ``groups`` (node, key).  Of equal scores the earliest leader counts.
    """
    settled = cut_lineage(settle(nodes, pairs.select("later", "earlier"), groups))
    leaders = settled.filter(F.col("status") == LEADS).select(F.col("node").alias("leader"), F.col("rank").alias("place"))
    followers = settled.filter(F.col("status") == FOLLOWS).select("node", "rank")
    by_pair = pairs.join(followers, F.col("later") == F.col("node")).join(
        leaders, F.col("earlier") == F.col("leader")).select("node", "leader", "place", "score")
    # of a group only its first leader can be joined: any later member follows it
    first = groups.join(leaders, F.col("node") == F.col("leader")).groupBy("key").agg(
        F.min(F.struct("place", "leader")).alias("f"))
    by_group = groups.join(first, "key").join(followers, "node").filter(F.col("f.place") < F.col("rank")).select(
        "node", "f.leader", "f.place", F.lit(100.0).alias("score"))
    best = F.max_by(F.struct("leader", "score"), F.struct(F.col("score"), -F.col("place"))).alias("b")
    joined = by_pair.unionByName(by_group).groupBy("node").agg(best).select("node", "b.leader", "b.score")
    return joined.unionByName(leaders.select(F.col("leader").alias("node"), "leader", F.lit(100.0).alias("score")))
