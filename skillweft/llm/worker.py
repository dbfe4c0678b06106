"""Helpers for code that runs inside Python workers.

Words are runs of bytes other than space, tab, newline, vertical tab, form feed and
carriage return, which is what ``bytes.split()`` splits at.
"""

from __future__ import annotations

import sys
import types

from pyspark import cloudpickle
from pyspark.sql import SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__])



def process_cache(owner: str) -> dict:
    """The dictionary of one operator in this worker process; those of the others are dropped.

    The code of this package is shipped by value, so its own module globals do not
    outlive a task; tokenizers and automata are worth keeping for the next one, but not
    through the tasks of another operator.
    """
    holder = sys.modules.setdefault("_skillweft_worker_cache", types.ModuleType("_skillweft_worker_cache"))
    caches = holder.__dict__.setdefault("caches", {})
    for other in [name for name in caches if name != owner]:
        del caches[other]
    return caches.setdefault(owner, {})


def bound_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Send at most ``rows`` rows at once to Python: rows here are whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty and unpaired surrogates are kept apart."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
