"""Streaming ingest (an addition): every micro-batch supersedes the sources that it brings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.segments import segment
from ..operators.store import latest, write_superseding


def segments_of_batch(batch: DataFrame) -> DataFrame:
    """The segments of the last version of each source of a batch(workspace, source, kind, chapter, ordinal, version, text)."""
    return segment(latest(batch, ["workspace", "source"], [F.col("version")]).drop("version"))


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the segment table at path up to date with a stream of sources; a batch that runs again writes the same."""

    def upsert(batch: DataFrame, _: int) -> None:
        write_superseding(segments_of_batch(batch), path)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
