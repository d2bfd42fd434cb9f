"""Documents that keep arriving: the same ingest, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bookwright.engine import DEFAULT, Engine
from bookwright.functions.text import content_hash, estimate_tokens

ITEMS = "source_path string, source_name string, text string, arrived_at timestamp"


def ingest_stream(engine: Engine, items: DataFrame, checkpoint: str, collection: str = DEFAULT, once: bool = False) -> StreamingQuery:
    """Ingests a stream of ``source_path``, ``source_name``, ``text``, ``arrived_at``.

    Of rows with one path in a batch the last to arrive counts. A batch that is
    repeated after a failure changes nothing: its documents are unchanged.
    """

    def put(batch: DataFrame, _: int) -> None:
        last = batch.where("source_path is not null").groupBy("source_path").agg(F.max_by(F.struct("source_name", "text"), F.struct("arrived_at", "text")).alias("d"))
        engine.ingest_texts(last.select("source_path", "d.source_name", "d.text"), collection)

    writer = items.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrivals(items: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Documents and tokens by window of arrival, each content once; rows later than ``late`` are dropped."""
    fresh = items.withWatermark("arrived_at", late).withColumn("hash", content_hash(F.col("text"))).dropDuplicatesWithinWatermark(["source_path", "hash"])
    return fresh.groupBy(F.window("arrived_at", window)).agg(F.count("*").alias("documents"), F.sum(estimate_tokens(F.col("text"))).alias("tokens"))
