"""Streaming ingestion: new alerts once each, into the log of their local day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from alertloom import constants as K
from alertloom.operators.ingest import deduplicate, not_in_log
from alertloom.schemas import ALERT_JSON
from alertloom.session import stage
from alertloom.sources.alerts import alert_hash, flatten_alerts
from alertloom.sources.logs import CORRUPT, parsed_lines, quarantine
from alertloom.sources.sinks import local_day

#: A day, whose log an alert is looked up in, and the time that alerts may be behind.
REMEMBERED_SECONDS = 86_400 + K.INGEST_DELAY_SECONDS + K.LOOKBACK_SECONDS


def alert_lines(spark: SparkSession, path: str, start_after: str | None = None,
                max_files: int = 1000) -> DataFrame:
    """Lines of JSON files as they appear; older files may be left out."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files)
    if start_after:
        reader = reader.option("modifiedAfter", start_after)
    return reader.text(path)


def alert_stream(spark: SparkSession, path: str, start_after: str | None = None,
                 max_files: int = 1000) -> DataFrame:
    """Flat alerts of JSON-lines files as they appear, without malformed lines."""
    read = parsed_lines(alert_lines(spark, path, start_after, max_files), ALERT_JSON)
    return flatten_alerts(read.where(F.col(CORRUPT).isNull()).drop(CORRUPT))


def intake_batch(lines: DataFrame, batch_id: int, alerts_path: str, quarantine_path: str) -> None:
    """One batch of lines: flat alerts to one folder, malformed lines to another.

    The parsed batch is written once and read by both. Each batch has folders of its own, which a
    rerun overwrites, so a line is in exactly one of them, once.
    """
    read = stage(parsed_lines(lines, ALERT_JSON), "intake")
    good = read.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    flatten_alerts(good).write.mode("overwrite").parquet(f"{alerts_path}/batch={batch_id}")
    quarantine(read).write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")


def start_intake(lines: DataFrame, alerts_path: str, quarantine_path: str, checkpoint: str,
                 once: bool = False) -> StreamingQuery:
    """Split a stream of lines into alerts and a quarantine; blank lines are in neither."""
    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, i: intake_batch(batch, i, alerts_path, quarantine_path)
    )
    return writer.trigger(**_trigger(once)).start()


def bounded_dedup(alerts: DataFrame, delay_seconds: int = K.INGEST_DELAY_SECONDS
                  + K.LOOKBACK_SECONDS) -> DataFrame:
    """De-duplication with state for the look-back only; later copies are not recognised."""
    return (
        alerts.withColumn("event_time", F.try_to_timestamp("timestamp"))
        .withWatermark("event_time", f"{delay_seconds} seconds")
        .withColumn("alert_hash", alert_hash())
        .dropDuplicatesWithinWatermark(["alert_hash"])
        .drop("event_time")
    )


def remembered_dedup(alerts: DataFrame, keep_seconds: int = REMEMBERED_SECONDS) -> DataFrame:
    """The first copy of each alert to arrive; its hash is remembered for `keep_seconds` after.

    State is kept by hash and expires by arrival, so no log is read again, and neither late
    alerts nor ones with an unreadable time are lost or let through twice.
    """
    return (
        alerts.withColumn("alert_hash", alert_hash())
        .withColumn("arrived_at", F.current_timestamp())
        .withWatermark("arrived_at", f"{keep_seconds} seconds")
        .dropDuplicatesWithinWatermark(["alert_hash"])
    )


def start_dedup(alerts: DataFrame, log_path: str, checkpoint: str, once: bool = False,
                zone: str = K.LOCAL_TIME_ZONE) -> StreamingQuery:
    """Append the new alerts of a stream to the day log, by state alone.

    The file sink writes a batch once also when it is run again; unreadable times have a null day.
    """
    fresh = remembered_dedup(alerts).withColumn("local_day", local_day(F.col("timestamp"), zone))
    writer = (
        fresh.writeStream.format("parquet").option("path", log_path).partitionBy("local_day")
        .option("checkpointLocation", checkpoint).outputMode("append")
    )
    return writer.trigger(**_trigger(once)).start()


def append_new(batch: DataFrame, log_path: str, zone: str = K.LOCAL_TIME_ZONE) -> None:
    """One cycle: drop copies within the batch and rows already in the days it touches.

    Only the day folders of the batch are read; alerts with an unreadable time have the null day. A
    batch that is run again after a failure finds its rows in the log and adds none twice.
    """
    fresh = stage(
        deduplicate(batch).withColumn("local_day", local_day(F.col("timestamp"), zone)), "fresh")
    days = [r["local_day"] for r in fresh.select("local_day").distinct().collect()]
    log = batch.sparkSession.read.schema(fresh.schema).parquet(log_path)
    touched = F.col("local_day").isin([d for d in days if d is not None])
    if None in days:
        touched = F.col("local_day").isNull() | touched
    not_in_log(fresh, log.where(touched)).write.mode("append").partitionBy("local_day").parquet(log_path)


def start_ingest(alerts: DataFrame, log_path: str, checkpoint: str, once: bool = False,
                 zone: str = K.LOCAL_TIME_ZONE) -> StreamingQuery:
    """Append the new alerts of a stream to the day log."""
    none = alerts.sparkSession.createDataFrame([], "alert_hash string, local_day date")
    none.write.mode("append").partitionBy("local_day").parquet(log_path)  # found empty by the first batch
    writer = alerts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _: append_new(batch, log_path, zone)
    )
    return writer.trigger(**_trigger(once)).start()


def _trigger(once: bool) -> dict:
    return {"availableNow": True} if once else {"processingTime": f"{K.POLL_SECONDS} seconds"}
