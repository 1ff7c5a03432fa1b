"""Granule listings as a stream that feeds the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cellgrid.sources.index_log import IndexLog


def index_listing(
    listing: DataFrame, log: IndexLog, checkpoint: str, writer: str = "listing", build: Callable[[DataFrame], None] | None = None
) -> StreamingQuery:
    """Start a stream of ``listing (url)`` that builds and commits each granule the index lacks.

    Spark keeps which files of the listing were taken; each micro-batch is one commit that
    carries its number.  A batch that is run again after a failure finds its number in the log
    if it had got that far and then does nothing; otherwise the index knows nothing of it and
    it is built as a whole.  ``writer`` names the checkpoint: two streams need two names.
    """
    def step(batch: DataFrame, number: int) -> None:
        log.build(batch, build, writer, number)

    return (
        listing.select("url").writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
