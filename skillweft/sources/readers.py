"""Table, CSV and JSON sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder; columns and filters are pushed to the scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows out by a key.

    For narrow rows that costly work starts from (building or scoring texts), where files may
    have any number of rows per split.
    """
    return df.repartition(*keys)


def spread_scan(df: DataFrame, *keys: str) -> DataFrame:
    """A scan of wide rows, dealt out only if it has fewer splits than the cluster has cores.

    ``spark.sql.files.maxPartitionBytes`` sets the size of splits; a table of any size is read
    in place, and only files of one or two row groups are moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # a given number of parts: Spark would merge parts of few bytes, whatever the work on a row
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores, *keys)


def read_jdbc_table(
    spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options
) -> DataFrame:
    """Partitioned scan of a relational table: ``parts`` range queries over ``key``."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key,
        lowerBound=low, upperBound=high, numPartitions=parts, **options,
    )
    return reader.load()


def read_word_list(spark: SparkSession, path: str, column: str = "skill") -> DataFrame:
    """Headerless one-column CSV; rows with extra fields are dropped, quotes kept as text."""
    rows = (
        spark.read.schema(f"{column} STRING")
        .option("quote", "")
        .option("mode", "DROPMALFORMED")
        .csv(path)
    )
    return rows.select(F.trim(column).alias(column)).filter(F.col(column) != "")


def valid_cache_rows(
    cache: DataFrame, valid_sizes: list[str], now: Column, days: int = 30
) -> DataFrame:
    """Cache rows younger than ``days`` whose size is a known label."""
    stamp = F.try_to_timestamp(F.col("timestamp"))
    # whole elapsed days, so an entry expires exactly ``days`` * 24 hours after it was written
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(stamp)) / 86_400_000_000)
    return cache.filter((age < days) & F.col("size").isin(valid_sizes))


def read_size_cache(
    spark: SparkSession, path: str, valid_sizes: list[str], now: Column, days: int = 30
) -> DataFrame:
    """JSON-lines cache file with the validity filter applied."""
    schema = "key STRING, size STRING, company STRING, timestamp STRING"
    return valid_cache_rows(spark.read.schema(schema).json(path), valid_sizes, now, days)


def first_present(df: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """For every target column pick the first candidate that exists; missing ones become NULL."""
    lookup = {name.lower(): name for name in df.columns}
    chosen = []
    for target, names in candidates.items():
        found = next((lookup[n.lower()] for n in names if n.lower() in lookup), None)
        column = F.col(found) if found else F.lit(None).cast("string")
        chosen.append(column.alias(target))
    return df.select(*chosen)
