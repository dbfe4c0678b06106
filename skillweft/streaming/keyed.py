"""State per key, kept by Structured Streaming in its state store.

Keys lie in buckets by their hash.  A micro-batch reads and writes only the buckets of the
keys that occur in it, whatever the length of the history; RocksDB holds the rest on disk.
All keys of a bucket are stepped at once on whole columns.  A repeated batch starts from
the state before it.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The state stores of an executor share this much memory; else each of its partitions keeps blocks and buffers of its own.
SHARED = {
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}
#: Buckets of keys; a bucket is what one step holds, so the keys of one should stay below a million or so.
#: The number belongs to a checkpoint.
BUCKETS = 256


def use_rocksdb(spark: SparkSession) -> None:
    """State on RocksDB, within shared memory unless the session says otherwise."""
    spark.conf.set(STORE, ROCKSDB)
    for key, value in SHARED.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def keep_state(
    stream: DataFrame, keys: list[str], step: Callable, output: str, state: str, timeout: str = "NoTimeout"
) -> DataFrame:
    """``step(key, frames, state)`` per key and micro-batch; see ``applyInPandasWithState``.

    With ``timeout="EventTimeTimeout"`` the stream needs a watermark, and a key whose
    timer has passed is stepped without rows.
    """
    use_rocksdb(stream.sparkSession)
    return stream.groupBy(*keys).applyInPandasWithState(step, output, state, "append", timeout)


def stack(*frames):
    """Frames or columns below each other; empty ones do not change the types."""
    return pd.concat([f for f in frames if len(f)] or frames[-1:], ignore_index=True)


def keep_buckets(
    stream: DataFrame, key: str, step: Callable, output: str, state: str, timers: bool = False, buckets: int = BUCKETS
) -> DataFrame:
    """``step(rows, kept, watermark)`` per bucket of keys and micro-batch; rows and results are pandas frames.

    ``kept`` has the columns of ``state``, as the last step of the bucket returned them.  The step
    returns the rows to emit and what to keep, and with ``timers`` (the stream then needs a
    watermark) the time in ms at which the bucket is due again without rows, or None.  Null
    keys have a bucket of their own, so the key's column is either null or never.  Spark sends what is kept
    again with every Arrow batch of a bucket's rows, so both should stay small: it is compressed, and
    ``buckets`` should be so many that a bucket's rows of a micro-batch are few batches.
    """
    use_rocksdb(stream.sparkSession)
    columns = stream.columns
    kinds = to_arrow_schema(StructType.fromDDL(state))
    stored = pa.schema(
        [f.with_type(pa.dictionary(pa.int32(), f.type)) if pa.types.is_string(f.type) else f for f in kinds],
        {b"buckets": str(buckets).encode()})
    none = to_arrow_schema(stream.schema).empty_table().to_pandas()
    number = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")

    def stepped(_, frames, held):
        rows = stack(*(f[columns] for f in frames), none)
        old = held.get[0] if held.exists else None
        table = stored.empty_table() if old is None else pa.ipc.open_stream(old).read_all()
        if (was := int((table.schema.metadata or {}).get(b"buckets", BUCKETS))) != buckets:
            raise ValueError(f"this checkpoint has its keys in {was} buckets, not {buckets}")
        kept = table.cast(kinds).to_pandas()
        emitted, kept, *due = step(rows, kept, held.getCurrentWatermarkMs() if timers else None)
        if len(kept):
            sink = pa.BufferOutputStream()
            table = pa.Table.from_pandas(kept, schema=stored, preserve_index=False)
            with pa.ipc.new_stream(sink, stored, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            held.update((sink.getvalue().to_pybytes(),))
            if due and due[0] is not None:
                held.setTimeoutTimestamp(int(due[0]))
        elif held.exists:
            held.remove()
        if len(emitted):
            yield emitted

    return stream.withColumn("_bucket", number).groupBy("_bucket").applyInPandasWithState(
        stepped, output, "rows binary", "append", "EventTimeTimeout" if timers else "NoTimeout")


def set_timer(state, at_ms: int) -> bool:
    """Whether a timer could be set: one that the watermark has passed already could not."""
    if at_ms <= state.getCurrentWatermarkMs():
        return False
    state.setTimeoutTimestamp(int(at_ms))
    return True
