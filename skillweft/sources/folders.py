"""Tables dealt into folders by the hash of a key, for updates that rewrite little.

A change reads the folders that its keys fall into and writes those whose rows differ
afterwards; all others keep their files.  The cost of a change follows the folders it
touches, not the table.  ``folders`` is chosen with the table, so that a folder is a
comfortable size for one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skillweft.session import cut_lineage

FOLDER = "_folder"


class KeyedFolders:
    """A parquet table below ``path`` with one folder per hash of ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, folders: int):
        self.spark, self.path, self.key, self.folders = spark, path, key, folders

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, folders: int = 64) -> KeyedFolders:
        """Write ``df`` as a new table."""
        table = cls(df.sparkSession, path, key, folders)
        table._dealt(df).write.partitionBy(FOLDER).parquet(path)
        return table

    def _number(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.folders)).cast("int")

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn(FOLDER, self._number(F.col(self.key))).repartition(FOLDER)

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().drop(FOLDER)

    def change(self, incoming: DataFrame, rewrite: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Apply ``rewrite(rows, incoming)`` where the keys of ``incoming`` lie; the folders written.

        ``rewrite`` may change, add and delete rows of those keys, and has to leave other
        rows as they are.  Running it again with the same rows writes nothing.
        """
        rows = self._rows()
        kind = rows.schema[self.key].dataType
        incoming = incoming.withColumn(self.key, F.col(self.key).cast(kind))
        # at most ``folders`` numbers
        touched = [r[0] for r in incoming.select(self._number(F.col(self.key))).distinct().collect()]
        if not touched:
            return []
        before = rows.filter(F.col(FOLDER).isin(touched))
        columns = [c for c in rows.columns if c != FOLDER]
        # stored apart first: the files that are read here are the ones to be replaced
        after = cut_lineage(self._dealt(rewrite(before.drop(FOLDER), incoming).select(*columns)))
        changed = self._different(before, after, columns)
        if changed:
            after.filter(F.col(FOLDER).isin(changed)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy(FOLDER).parquet(self.path)
            filled = {r[0] for r in after.select(FOLDER).distinct().collect()}
            self._remove([f for f in changed if f not in filled])
        return sorted(changed)

    def _different(self, before: DataFrame, after: DataFrame, columns: list[str]) -> list[int]:
        """Folders whose rows are not the same, whatever their order."""

        def prints(df: DataFrame, name: str) -> DataFrame:
            whole = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
            return df.groupBy(FOLDER).agg(F.struct(F.count(F.lit(1)), whole).alias(name))

        both = prints(before, "old").join(prints(after, "new"), FOLDER, "full_outer")
        return [r[0] for r in both.filter(~F.col("old").eqNullSafe(F.col("new"))).select(FOLDER).collect()]

    def _remove(self, emptied: list[int]) -> None:
        for number in emptied:  # dynamic overwrite leaves a folder without new rows as it was
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{FOLDER}={number}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
