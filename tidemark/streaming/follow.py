"""Following the feed: Structured Streaming into the mirror, exactly once."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.mirror import BASE_MIN_ROWS, BASE_SHARE, Mirror


def _stream_id(mirror: Mirror, checkpoint: str) -> Callable[[], str]:
    """The id Spark gave this checkpoint, read once it is there; a new checkpoint is a new stream."""
    return lru_cache(lambda: json.loads(mirror.spark.read.text(f"{checkpoint}/metadata").first()[0])["id"])


def follow(
    mirror: Mirror,
    feed: DataFrame,
    checkpoint: str,
    missing_post_image: str = "fail",
    once: bool = True,
    every: str = "10 seconds",
    base_share: float | None = BASE_SHARE,
    base_min_rows: int = BASE_MIN_ROWS,
) -> StreamingQuery:
    """Starts applying a streaming feed to the mirror, one commit per micro-batch.

    The checkpoint holds the position, the commit marker the proof that a batch
    was applied: a batch replayed after a crash finds its marker and is skipped,
    or finds none and overwrites what its first try left.  A base is written whenever
    the rows since the last one exceed ``base_share`` of it, so that rewriting stays
    a constant factor of what changes.  ``once`` drains what is there and stops.
    """

    stream_id = _stream_id(mirror, checkpoint)

    def commit(batch: DataFrame, batch_id: int) -> None:
        number = mirror.apply(
            batch,
            stream_id=stream_id(),
            batch_id=batch_id,
            missing_post_image=missing_post_image,
        )
        if number and base_share is not None and mirror.base_due(base_share, base_min_rows):
            mirror.write_base()

    writer = feed.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()
