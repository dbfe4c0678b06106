"""CSV export and table writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def export_csv(df: DataFrame, path: str) -> None:
    """Header, UTF-8, NULL written as an empty field; one file per partition."""
    text = df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    text.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option(
        "emptyValue", ""
    ).csv(path)


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a rewritten table to a new path (never onto the files it was read from)."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def empty_like(df: DataFrame) -> DataFrame:
    """Same schema, no rows: the truncated form of a derived table."""
    return df.sparkSession.createDataFrame([], df.schema)


def reset_derived(tables: dict[str, DataFrame], keep: set[str]) -> dict[str, DataFrame]:
    """Truncate every table that is not raw input."""
    return {name: df if name in keep else empty_like(df) for name, df in tables.items()}
