"""The merge operators as sinks of a stream: each micro-batch rewrites the partitions that it has keys of.

An addition: nothing that the tables come from is a stream today.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from webloom.operators import merge
from webloom.sources.tables import Step, Store


def once(store: Store, table: str, step: Step, stream: str) -> Callable[[DataFrame, int], None]:
    """A function of a batch and its number that merges it into `table` by step(old, batch). A batch that a
    restarted stream gives again is told by its number, which the store keeps, and left out."""

    def apply(batch: DataFrame, epoch: int) -> None:
        store.commit({table: (step, batch)}, mark=(stream, epoch))

    return apply


def merging(store: Store, table: str, step: Step, checkpoint: str):
    """A foreachBatch writer that applies step(old, batch) to `table`, once a batch."""
    return lambda stream: stream.writeStream.foreachBatch(once(store, table, step, checkpoint)).option("checkpointLocation", checkpoint)


def edge_counter(store: Store, checkpoint: str):
    return merging(store, "graph_edges", lambda old, new: merge.add_counts(old, new), checkpoint)


def first_addresses(store: Store, checkpoint: str):
    return merging(store, "crypto_addresses", lambda old, new: merge.keep_first(old, new, "address"), checkpoint)
