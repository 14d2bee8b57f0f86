"""Forwarding of newly appended result rows to another folder."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from alertloom import constants as K


def start_forward(spark: SparkSession, source: str, target: str, checkpoint: str,
                  once: bool = False) -> StreamingQuery:
    """Copy result lines once each, file by file as they are committed."""
    writer = (
        spark.readStream.text(source).writeStream.format("text").option("path", target)
        .option("checkpointLocation", checkpoint).outputMode("append")
    )
    trigger = {"availableNow": True} if once else {"processingTime": f"{K.POLL_SECONDS} seconds"}
    return writer.trigger(**trigger).start()
