"""Scoring new rows as they arrive with a detector fitted before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tideline.operators.detector import DetectorModel
from tideline.plans import scratch_path, scratch_scope

# The column of the folders that micro-batches write.
BATCH = "tideline_batch"


def start_scoring(stream: DataFrame, model: DetectorModel, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the scored rows of every micro-batch below ``path``.

    A batch goes to a folder of its own that a repeated batch overwrites, so each row is written
    once even if a batch has to run again. The model is fixed, so rows need no state.
    """
    if not model.keeps_rows:
        raise ValueError("windows reach across batches; score them over the stored rows")

    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            model.transform(batch).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()


def score_stream(stream: DataFrame, model: DetectorModel) -> DataFrame:
    """Score all that is available now and return the scored rows."""
    folder = scratch_path(stream.sparkSession, "stream")
    start_scoring(stream, model, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/rows").drop(BATCH)
