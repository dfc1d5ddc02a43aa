"""Incremental use: appended documents and keyed changes as streams, idempotent on replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import vector_rows
from ..sources.state import latest


def stream_to_keyed(source: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], keys: list[str], order: list[str], trigger_once: bool = True) -> StreamingQuery:
    """Run each micro-batch through ``prepare`` and write it to its own folder of ``path``; a replayed batch overwrites itself.

    :func:`read_keyed` gives the latest row of each key over all batches, so late and repeated rows settle by ``order``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latest(prepare(batch), keys, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_once else writer).start()


def read_keyed(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """Latest state of what :func:`stream_to_keyed` wrote."""
    return latest(spark.read.option("basePath", path).parquet(path), keys, [*order, "batch"]).drop("batch")


def stream_index(source: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append new chunks (id, ord, text, ...) to a vector index."""
    return stream_to_keyed(source, path, checkpoint, vector_rows, ["id"], ["ord"])


def stream_upsert(changes: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Keep the latest state of keyed changes."""
    return stream_to_keyed(changes, path, checkpoint, lambda batch: batch, keys, order)
