"""Archive runs driven by a stream: every micro-batch is a run of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from marginalia.plans.archive import archive_run
from marginalia.rules import JobConfig


def archive_stream(
    sources: DataFrame, config: JobConfig, name: str, checkpoint: str, snapshot_path: str | None = None
) -> StreamingQuery:
    """Archive what arrives on a streaming ``sources`` (path, text), then stop.

    A batch that is repeated after a failure has the same run name and replaces its own output.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        archive_run(batch.sparkSession, batch, config, f"{name}-{batch_id:06d}", snapshot_path)

    return (
        sources.select("path", "text")
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
