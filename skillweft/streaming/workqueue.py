"""Work queue with retries and leases.

Jobs are handed out with an attempt number.  Results come back as a feed of their own,
which the queue reads beside the jobs: a failed job is handed out again with the next
number, a claim without a result returns when its lease is over, and a result of any
attempt that went well ends the job.  What is known of a job is keyed state, so a
micro-batch touches the buckets of jobs that arrive, answer or time out in it and no others.

``path/taken`` lists what was handed out and ``path/done`` the results, each under its
batch number; a repeated batch replaces its own rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from skillweft.streaming.feeds import batch_writer, current_rows, fold_batches, run_available, unfolded_batches
from skillweft.streaming.keyed import keep_buckets, stack

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def hand_out(events: DataFrame, payload: list[str], lease_ms: int) -> DataFrame:
    """Stream of jobs to work on: ``id``, the payload and ``attempt``.

    ``events`` has ``id``, the payload (of jobs), ``attempt`` and ``ok`` (of results) and
    the watermarked time ``at``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    columns = ["id", *payload]

    def step(rows, kept, watermark):
        def due(now):
            return np.maximum(now + lease_ms, watermark + 1)

        n = len(kept)
        # one number per key; those that are kept come first
        codes, _ = pd.factorize(stack(kept["id"], rows["id"]), use_na_sentinel=False)
        size = codes.max() + 1 if len(codes) else 0
        number = codes[n:]
        attempt, done = np.zeros(size, "int64"), np.zeros(size, bool)
        attempt[:n], done[:n] = kept["attempt"], kept["done"]
        seen, hand = np.zeros(size, bool), np.zeros(size, bool)
        seen[number] = True
        now = np.where(seen, 0, watermark)
        if len(rows):
            np.maximum.at(now, number, rows["at"].astype("datetime64[ms]").astype("int64").to_numpy())
        asked = rows["ok"].isna().to_numpy()
        good = ~asked & (rows["ok"] == True).to_numpy()  # noqa: E712
        done[number[good]] = True
        bad = ~asked & ~good
        bad[bad] = rows["attempt"].to_numpy()[bad].astype("int64") == attempt[number[bad]]
        hand[number[bad]] = True
        first = rows[asked].assign(_n=number[asked]).drop_duplicates("_n")
        first = first[first["_n"] >= n]
        hand[first["_n"]] = True
        timers = np.zeros(size, "int64")
        timers[:n] = kept["due"]
        hand[:n] |= ~seen[:n] & (timers[:n] < watermark)  # leases that are over
        hand &= ~done
        timers = np.where(seen | hand, due(now), timers)
        # a good result may come without its job: only that it went well is kept
        early = rows[good].assign(_n=number[good]).drop_duplicates("_n")
        early = early[(early["_n"] >= n) & ~early["_n"].isin(first["_n"])].drop(columns=payload)
        jobs = stack(*(f.reindex(columns=["_n", *columns]) for f in (kept.assign(_n=np.arange(n)), first, early)))
        at = jobs.pop("_n").to_numpy().astype("int64")
        attempt = attempt + hand
        jobs = jobs.assign(attempt=attempt[at], done=done[at], due=timers[at])
        handed = jobs.loc[hand[at], [*columns, "attempt"]]
        # what is kept of a finished job is that it is finished
        jobs[payload] = jobs[payload].astype(object).where(~jobs["done"], None)
        open_ones = timers[at][~done[at]]
        return handed, jobs, open_ones.min() if len(open_ones) else None

    shape = "".join(f"{c} {kinds[c]}, " for c in payload)
    return keep_buckets(
        events, "id", step, f"id {kinds['id']}, {shape}attempt int",
        f"id {kinds['id']}, {shape}attempt int, done boolean, due bigint", timers=True,
    )


def run_queue(
    jobs: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
    lease_seconds: float = 3600, clock: Column | None = None, fold_after: int = 20,
) -> StreamingQuery:
    """Hand out what is waiting, work on it and record the results; one round, a later call is the next one.

    ``jobs`` is a stream with an ``id``; ``work`` maps handed-out jobs (with ``attempt``) to
    (id, ok), and leaves out those it has no result for.  ``clock`` is the time of a
    micro-batch.
    """
    spark = jobs.sparkSession
    payload = [c for c in jobs.columns if c != "id"]
    kind = jobs.schema["id"].dataType.simpleString()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    results = spark.readStream.schema(f"id {kind}, attempt int, ok boolean").option(
        "recursiveFileLookup", "true").parquet(f"{path}/done")
    asked = jobs.withColumns({"attempt": F.lit(None).cast("int"), "ok": F.lit(None).cast("boolean")})
    events = asked.unionByName(results, allowMissingColumns=True).withColumn(
        "at", F.current_timestamp() if clock is None else clock
    ).withWatermark("at", "0 seconds")

    def each(df: DataFrame, batch: int) -> None:
        batch_writer(f"{path}/taken")(df, batch)
        handed = spark.read.schema(df.schema).parquet(f"{path}/taken/batch={batch}")
        result = handed.select("id", "attempt").join(work(handed).select("id", "ok"), "id")
        batch_writer(f"{path}/done")(result, batch)

    query = run_available(hand_out(events, payload, int(lease_seconds * 1000)), checkpoint, each)
    for table in ("taken", "done"):
        if unfolded_batches(spark, f"{path}/{table}") >= fold_after:
            fold_batches(spark, f"{path}/{table}", ["id"], "greatest")
    return query


def queue_state(spark: SparkSession, jobs: DataFrame, path: str) -> DataFrame:
    """(id, status, attempts) of every job: completed, in progress while a claim is open, else pending."""
    taken = current_rows(spark, f"{path}/taken", ["id"], "greatest").select("id", F.col("attempt").alias("attempts"))
    done = current_rows(spark, f"{path}/done", ["id"], "greatest").select("id", F.col("attempt").alias("answered"), "ok")
    status = F.when(F.col("ok"), "completed").when(
        F.col("attempts") > F.coalesce("answered", F.lit(0)), "in_progress").otherwise("pending")
    return jobs.select("id").join(taken, "id", "left").join(done, "id", "left").select(
        "id", status.alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts")
    )
