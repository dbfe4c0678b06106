"""Ranks, pages and batches with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skillweft.session import cut_lineage


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal; 0 when there is nothing to divide by."""
    share = F.round(F.lit(100.0) * part / whole, 1)
    return F.when(whole > 0, share).otherwise(F.lit(0.0))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows; planned as one top-k per partition and a merge of n rows each."""
    return df.orderBy(*order).limit(n)


def ranked_top_n(df: DataFrame, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """Top ``n`` with a 1-based rank; the window sees at most ``n`` rows."""
    number = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return top_n(df, order, n).withColumn(rank, number)


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int | None, rank: str = "rank"
) -> DataFrame:
    """Rank inside each group.

    With ``n`` every task forwards at most n rows per group.  Without a limit a
    group may be larger than a task, so positions come from one distributed sort.
    """
    if n is None:
        numbered = number_all(df, [*map(F.col, keys), *order], "_no")
        starts = numbered.groupBy(*keys).agg(F.min("_no").alias("_start"))
        return numbered.join(starts, keys).select(
            *df.columns, (F.col("_no") - F.col("_start") + 1).alias(rank)
        )
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= n).withColumn(rank, F.col(rank).cast("bigint"))


def number_all(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """1-based position of every row in a total order, without a single-task sort.

    The rows are range-partitioned and sorted, the sorted partitions are
    checkpointed so that their numbering cannot change, and the sizes of the
    earlier partitions are added to the position inside each partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # upper bits: partition number, lower 33 bits: position inside the partition
    marked = cut_lineage(ranged.withColumn("_mark", F.monotonically_increasing_id()))
    part = F.shiftright("_mark", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select(
        "_part",
        (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"),
    )
    inside = F.col("_mark") - F.shiftleft(part, 33)
    return (
        marked.withColumn("_part", part)
        .join(F.broadcast(before), "_part")  # one row per partition
        .withColumn(name, (F.col("_before") + inside + 1).cast("bigint"))
        .drop("_mark", "_part", "_before")
    )


def batches(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Consecutive fixed-size batches of an ordered table: ``batch_id`` and position in it."""
    numbered = number_all(df, order, "_no")
    return numbered.select(
        *df.columns,
        F.floor((F.col("_no") - 1) / size).alias("batch_id"),
        ((F.col("_no") - 1) % size + 1).alias("batch_pos"),
    )


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, key: str, last_seen, limit: int) -> DataFrame:
    """Next page after a key: the filter is pushed down, so deep pages cost no more than the first."""
    rows = df if last_seen is None else df.filter(F.col(key) > F.lit(last_seen))
    return rows.orderBy(key).limit(limit)


def user_order(df: DataFrame, column: str, direction: str = "asc") -> list[Column]:
    """Sort keys for a chosen column; text is compared without case."""
    key = F.col(column)
    if dict(df.dtypes)[column] == "string":
        key = F.lower(key)
    return [key.desc() if direction == "desc" else key.asc()]


def first_number(column: str, missing: int = 999999) -> Column:
    """First run of digits as a sort key."""
    digits = F.nullif(F.regexp_extract(column, r"(\d+)", 1), F.lit(""))
    return F.coalesce(digits.try_cast("bigint"), F.lit(missing).cast("bigint"))
