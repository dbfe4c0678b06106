"""Incremental ingest, work queue and running counts.

Every sink that writes a table does so per micro-batch under the batch number,
so a batch that is run again after a failure replaces its own rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from skillweft.streaming.keyed import keep_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_feed(spark: SparkSession, folder: str, name: str | None = None, schema=None,
              files_per_batch: int | None = None) -> DataFrame:
    """Stream of parquet files that appear in a folder; ``name`` is a file pattern."""
    if schema is None:
        pattern = name or "*.parquet"
        schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema)
    if name:
        reader = reader.option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(
    stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append"
) -> StreamingQuery:
    """Process everything that is available now and stop; a later call continues where this one ended."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(each).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch as its own partition ``batch=<number>``."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the folders ``<name>=<number>`` below a path, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [str(f.getPath().getName()).partition("=") for f in files.listStatus(folder)]
    return sorted(int(number) for label, _, number in found if label == name and number.isdigit())


def _unfolded(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The last folded batch and the numbers of those after it."""
    folded = max(_numbers(spark, f"{path}_folded", "upto"), default=None)
    return folded, [b for b in _numbers(spark, path, "batch") if folded is None or b > folded]


def unfolded_batches(spark: SparkSession, path: str) -> int:
    return len(_unfolded(spark, path)[1])


def current_rows(spark: SparkSession, path: str, keys: list[str], combine: str = "newest") -> DataFrame:
    """One row per key of a table written batch by batch.

    ``combine`` says what becomes of a key's values: those of the newest batch, or of
    every column the sum or the greatest.  Batches up to the last ``fold_batches`` are
    read from its result.
    """
    rows = spark.read.option("basePath", path).parquet(path)
    folded, _ = _unfolded(spark, path)
    if folded is not None:
        before = spark.read.parquet(f"{path}_folded/upto={folded}").withColumn("batch", F.lit(folded))
        rows = rows.filter(F.col("batch") > folded).unionByName(before)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    if combine == "newest":
        newest = F.max_by(F.struct(*values), "batch").alias("v")
        return rows.groupBy(*keys).agg(newest).select(*keys, "v.*")
    one = {"sum": F.sum, "greatest": F.max}[combine]
    return rows.groupBy(*keys).agg(*[one(c).alias(c) for c in values])


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest value per key of a table written batch by batch."""
    return current_rows(spark, path, keys)


def fold_batches(spark: SparkSession, path: str, keys: list[str], combine: str = "newest") -> None:
    """Write the current rows once, so that later reads need no older batches.

    To be called while no query writes the table: all its batches are then committed.
    """
    batches = _numbers(spark, path, "batch")
    if batches and batches[-1] not in _numbers(spark, f"{path}_folded", "upto"):
        current_rows(spark, path, keys, combine).write.mode("overwrite").parquet(f"{path}_folded/upto={batches[-1]}")


def first_seen(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows whose key was not seen within the watermark delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def unseen(stream: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in a static table."""
    return stream.join(known.select(key).distinct(), key, "left_anti")


def rows_of_new_keys(stream: DataFrame, key: str) -> DataFrame:
    """The rows of keys that no earlier micro-batch had; of a new key all rows of its first one."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)

    def step(_, frames, state):
        if not state.exists:
            state.update((True,))
            yield from frames

    return keep_state(stream, [key], step, kinds, "seen boolean")


def ingest_feed(stream: DataFrame, path: str, checkpoint: str, key: str, order: Column) -> StreamingQuery:
    """Append rows with a new key to a table; the first row by ``order`` of a batch wins.

    Which keys the table has is keyed state: a micro-batch looks up its own keys and
    does not read the table.
    """
    whole = F.min_by(F.struct(*stream.columns), order).alias("r")

    def each(df: DataFrame, batch: int) -> None:
        batch_writer(path)(df.groupBy(F.col(key).alias("_k")).agg(whole).select("r.*"), batch)

    return run_available(rows_of_new_keys(stream, key), checkpoint, each)


def read_before(spark: SparkSession, path: str, schema: StructType, batch: int) -> DataFrame:
    """Rows that earlier batches wrote, with their batch number; nothing when there is no table yet."""
    numbered = StructType([f for f in schema.fields if f.name != "batch"] + [StructField("batch", IntegerType())])
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], numbered)
    rows = spark.read.schema(numbered).option("basePath", path).parquet(path)
    return rows.filter(F.col("batch") < batch)


def run_counts(events: DataFrame, outcomes: dict[str, str]) -> DataFrame:
    """Running counts per run: processed events by outcome, duplicates and share."""
    counted = [F.count_if(F.col("event") == e).alias(name) for e, name in outcomes.items()]
    return events.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("events"), *counted, F.sum("duplicates").alias("duplicates")
    )


def month_counts(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """Counts per calendar month and key; rows later than the watermark are dropped."""
    return stream.withWatermark(time, delay).groupBy(
        F.date_trunc("month", time).alias("month_start"), *keys
    ).agg(F.count(F.lit(1)).alias("cnt"))


def keep_current(
    stream: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None, fold_after: int = 20
) -> StreamingQuery:
    """Write the changed rows of a running aggregate; read them with ``latest_rows``.

    With ``keys``, the batches are folded when ``fold_after`` of them have come since the last time.
    """
    spark = stream.sparkSession
    query = run_available(stream, checkpoint, batch_writer(path), mode="update")
    if keys and unfolded_batches(spark, path) >= fold_after:
        fold_batches(spark, path, keys)
    return query


def chain(steps: list[Callable[[DataFrame, int], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """Batch function that hands the result of every step to the next one."""

    def each(df: DataFrame, batch: int) -> None:
        reduce(lambda rows, step: step(rows, batch), steps, df)

    return each
