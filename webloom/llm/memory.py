"""What workers hold: batches of bounded size, and nothing when a task ends, as they live on for other operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a batch that goes to a worker: whole texts, of some kilobytes each. Spark's own default is ten times
#: that, and it holds a batch twice, in its own buffers and in the worker's.
BATCH_ROWS = 1000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over a task's batches; Arrow's unused memory goes back to the system behind the last one."""

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return tidied


def in_small_batches(texts: DataFrame) -> DataFrame:
    """`texts`, whose session hands rows to workers by BATCH_ROWS at most from now on."""
    conf = texts.sparkSession.conf
    if not 0 < int(conf.get(_SETTING)) <= BATCH_ROWS:
        conf.set(_SETTING, str(BATCH_ROWS))
    return texts
