"""Skills per month, kept current while jobs and links come, change and go.

A job's month and links meet in keyed state, in whatever order they arrive.  Every change
gives signed differences per month and skill type, which are summed; the totals equal a
count over the tables as they are now.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from skillweft.streaming.feeds import batch_writer, current_rows, fold_batches, run_available, unfolded_batches
from skillweft.streaming.keyed import keep_buckets, stack

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ["month_start", "skill_type"]
#: Buckets of jobs.  A step holds the jobs and links of one, some 70,000 rows for 50 million jobs with 200 million links.
BUCKETS = 4096
CHANGES = ["job", "link", "unlink", "clear", "delete"]
JOB, LINK, UNLINK, CLEAR, DELETE = range(1, 6)
#: The month of a job that has no date, or that is not known.
NO_DAY = -(2 ** 62)


def differences(changes: DataFrame) -> DataFrame:
    """Stream of (month_start, skill_type, cnt) differences for a stream of changes.

    ``changes`` has (job_id, version, change, posted_date, skill_id, skill_type); ``change``
    is ``job`` (a new or moved posting), ``link``, ``unlink``, ``clear`` (all links go, before
    a job is analysed again) or ``delete``.  Changes of a job count in the order of their
    version, over micro-batches in the order of arrival.  A link counts once however often it comes; jobs without a
    date and links without a job count nowhere.  After a delete the job is unknown again.
    """
    linked = F.col("change").isin("link", "unlink")
    skill = F.coalesce(F.col("skill_id").cast("bigint"), F.when(
        linked, F.raise_error(F.lit("a link needs a skill_id")).cast("bigint")).otherwise(0))
    day = F.coalesce(F.unix_date(F.trunc("posted_date", "month")).cast("bigint"), F.lit(NO_DAY))
    # a number for the change and one for what it brings: a month or a skill
    rows = changes.filter(F.col("job_id").isNotNull() & F.col("change").isin(CHANGES)).select(
        "job_id", F.coalesce(F.col("version").cast("bigint"), F.lit(2 ** 63 - 1)).alias("version"),
        F.array_position(F.array(*map(F.lit, CHANGES)), F.col("change")).cast("int").alias("change"),
        F.when(F.col("change") == "job", day).otherwise(skill).alias("value"), "skill_type",
    )

    def step(rows, kept, _):
        # what is kept stands before the rows; of several assignments to one place the last one holds
        n, order = len(kept), np.argsort(rows["version"].to_numpy(), kind="stable")
        rows = rows.take(order)
        number, jobs = pd.factorize(stack(kept["job_id"], rows["job_id"]), sort=True, use_na_sentinel=False)
        kind, kinds = pd.factorize(stack(kept["skill_type"], rows["skill_type"]), use_na_sentinel=False)
        value = np.concatenate([kept["value"], rows["value"]]).astype("int64")
        held, change, at = kept["link"].to_numpy(bool), rows["change"].to_numpy(), np.arange(len(rows))
        old, new = number[:n], number[n:]

        before, wiped = np.full(len(jobs), NO_DAY), np.full(len(jobs), -1)
        before[old[~held]] = value[:n][~held]
        after, moved, gone = before.copy(), np.isin(change, (JOB, DELETE)), np.isin(change, (CLEAR, DELETE))
        after[new[moved]] = np.where(change[moved] == JOB, value[n:][moved], NO_DAY)
        wiped[new[gone]] = at[gone]

        was = np.flatnonzero(held)
        live = np.concatenate([held & (wiped[old] < 0), np.isin(change, (LINK, UNLINK)) & (at > wiped[new])])
        links = np.flatnonzero(live)
        skill, skills = pd.factorize(value[links])
        links = links[~pd.Index(number[links] * len(skills) + skill).duplicated(keep="last")]
        links = links[np.concatenate([np.full(n, True), change == LINK])[links]]

        # by month and skill type: the links of now less those of before
        every = np.concatenate([links, was])
        month, months = pd.factorize(np.concatenate([after[number[links]], before[number[was]]]))
        cell, cells = pd.factorize(month * len(kinds) + kind[every])
        count = np.bincount(cell[:len(links)], minlength=len(cells)) - np.bincount(cell[len(links):], minlength=len(cells))
        count[months[cells // max(len(kinds), 1)] == NO_DAY] = 0
        changed = np.flatnonzero(count)
        jobs, kinds, cells = np.asarray(jobs), np.asarray(kinds, object), cells[changed]
        emitted = pd.DataFrame({
            "day": months[cells // max(len(kinds), 1)], "skill_type": kinds[cells % max(len(kinds), 1)], "cnt": count[changed]})
        # kept by job, which takes half the bytes
        dated, links = np.flatnonzero(after != NO_DAY), links[np.argsort(number[links], kind="stable")]
        return emitted, pd.DataFrame({
            "job_id": jobs[np.concatenate([dated, number[links]])],
            "link": np.arange(len(dated) + len(links)) >= len(dated),
            "value": np.concatenate([after[dated], value[links]]),
            "skill_type": np.concatenate([np.full(len(dated), None), kinds[kind[links]]]),
        })

    kind = changes.schema["job_id"].dataType.simpleString()
    signed = keep_buckets(
        rows, "job_id", step, "day bigint, skill_type string, cnt bigint",
        f"job_id {kind}, link boolean, value bigint, skill_type string", buckets=BUCKETS,
    )
    return signed.select(F.date_from_unix_date(F.col("day").cast("int")).alias("month_start"), "skill_type", "cnt")


def run_skill_counts(changes: DataFrame, path: str, checkpoint: str, fold_after: int = 20) -> StreamingQuery:
    """Apply all available changes; read the totals with :func:`skill_totals`."""
    spark = changes.sparkSession

    def each(df: DataFrame, batch: int) -> None:
        batch_writer(path)(df.groupBy(*KEYS).agg(F.sum("cnt").alias("cnt")), batch)

    query = run_available(differences(changes), checkpoint, each)
    if unfolded_batches(spark, path) >= fold_after:
        fold_batches(spark, path, KEYS, "sum")
    return query


def skill_totals(spark: SparkSession, path: str) -> DataFrame:
    """(month_start, skill_type, cnt) as of the last run."""
    return current_rows(spark, path, KEYS, "sum").filter(F.col("cnt") != 0)
