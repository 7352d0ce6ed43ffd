"""The graph kept up to date from a stream of evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators.graph import upsert_edges

#: Parts the evidence table is kept in, by the hash of the source.
PARTS = 64


def append_evidence(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer: each micro-batch replaces its own partition of the evidence table, so one that is run again after a
    failure is not counted twice."""
    def write(batch: DataFrame, number: int) -> None:
        part = F.pmod(F.xxhash64("src"), F.lit(PARTS)).cast("int")
        rows = batch.select("src", "rel", "dst", "utt_id").distinct().withColumn("batch", F.lit(number)).withColumn("part", part)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(path)

    return write


def stream_evidence(evidence: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream of ``(src, rel, dst, utt_id)`` to the evidence table at ``path``."""
    query = evidence.writeStream.foreachBatch(append_evidence(path)).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()


def current_edges(evidence: DataFrame) -> DataFrame:
    """The edges of all evidence so far, utterances delivered in more than one batch counted once."""
    return upsert_edges(evidence)


def windowed_counts(evidence: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Edges' evidence per time window of a stream; rows later than ``late`` are left out of closed windows."""
    return evidence.withWatermark(time, late).groupBy(F.window(time, window), "src", "rel", "dst").agg(F.count("*").alias("n"))
