"""Per-key cache with a time to live.

A request is a hit while the key's last useful fetch is younger than the limit; else it is
a fetch itself.  Only valid values are kept, so a key whose fetch gave nothing useful is
asked again at its next request.

The cache is keyed state with a timer per entry: a micro-batch touches the entries of its
own keys only, is one job whatever the number of lives in it, and an entry goes when the
watermark has passed its life.
"""

from __future__ import annotations

import sys
from collections.abc import Collection

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from skillweft.streaming.feeds import batch_writer, run_available
from skillweft.streaming.keyed import keep_state, set_timer

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY = 86_400_000_000  # microseconds


def answer_in_order(
    at: np.ndarray, sizes: np.ndarray, useful: np.ndarray, entry: tuple | None, life: int
) -> tuple[np.ndarray, np.ndarray, tuple | None]:
    """(sizes, hits, entry afterwards) of one key's requests in time order.

    ``entry`` is (time of the fetch, size).  The steps are fetches, not requests.
    """
    sizes, hits = sizes.copy(), np.zeros(len(at), bool)
    fetches = np.flatnonzero(useful)
    place = 0
    while place < len(at):
        if entry is not None and at[place] < entry[0] + life:
            end = int(np.searchsorted(at, entry[0] + life))
            sizes[place:end], hits[place:end] = entry[1], True
            place = end
            continue
        k = int(np.searchsorted(fetches, place))
        if k == len(fetches):
            break  # nothing useful any more: all misses
        place = int(fetches[k])
        entry = (int(at[place]), sizes[place])
        place += 1
    return sizes, hits, entry


def answer_requests(requests: DataFrame, days: int, valid: Collection[str], lateness: str) -> DataFrame:
    """Stream of (key, id, ts, size, hit) for a stream of (key, id, ts, size).

    ``size`` of a request is what a fetch would give now.  Requests of a key are taken by
    (ts, id) within a micro-batch; one that lies before the stored fetch is a hit.
    Requests without a time, or later than ``lateness``, are not answered.
    """
    life, valid = days * DAY, frozenset(valid)
    kind = requests.schema["ts"].dataType.simpleString()
    rows = requests.filter(F.col("ts").isNotNull()).select(
        "key", F.col("id").cast("bigint").alias("id"), F.col("ts").cast("timestamp").alias("seen"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "size",
    ).withWatermark("seen", lateness)

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        asked = pd.concat(list(frames)).sort_values(["at", "id"], kind="stable")  # of one key and micro-batch
        at = asked["at"].to_numpy()
        sizes, hits, entry = answer_in_order(
            at, asked["size"].to_numpy(object), asked["size"].isin(valid).to_numpy(),
            tuple(state.get) if state.exists else None, life,
        )
        if entry is not None:
            if set_timer(state, (entry[0] + life) // 1000 + 1):
                state.update(entry)
            elif state.exists:
                state.remove()
        yield pd.DataFrame({"key": key[0], "id": asked["id"].to_numpy(), "at": at, "size": sizes, "hit": hits})

    answered = keep_state(
        rows, ["key"], step, "key string, id bigint, at bigint, size string, hit boolean",
        "fetched bigint, size string", "EventTimeTimeout",
    )
    return answered.select("key", "id", F.timestamp_micros("at").cast(kind).alias("ts"), "size", "hit")


def run_cache(
    requests: DataFrame, path: str, checkpoint: str, valid: Collection[str], days: int = 30, lateness: str = "1 day"
) -> StreamingQuery:
    """Answer a stream of (key, id, ts, size) requests into the table ``path/answers``."""
    answers = answer_requests(requests, days, valid, lateness)
    return run_available(answers, checkpoint, batch_writer(f"{path}/answers"))
