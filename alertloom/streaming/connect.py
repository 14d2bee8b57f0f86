"""Alerts and connections matched as two streams, with state for the reach of a band only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from alertloom import constants as K
from alertloom.operators.band import band_best, near_rows
from alertloom.operators.match import HALF_US
from alertloom.session import stage

MICROS = 1_000_000
LATE_SECONDS = K.INGEST_DELAY_SECONDS + K.LOOKBACK_SECONDS
BEGUN = "batch long"
MARKS = "asked_us long, seen_us long, watermark_us long"


def arrivals(alerts: DataFrame, conn: DataFrame) -> DataFrame:
    """Both streams as one: alerts and connections with a community id, told apart by `is_alert`."""
    asked = alerts.where((F.col("community_id") != "") & F.col("event_us").isNotNull()).select(
        F.lit(True).alias("is_alert"), F.col("community_id").alias("key"),
        F.col("event_us").alias("t"), "alert_id")
    seen = conn.where((F.col("community_id") != "") & F.col("ts_us").isNotNull()).select(
        F.lit(False).alias("is_alert"), F.col("community_id").alias("key"),
        F.col("ts_us").alias("t"), "uid", "row_id", "duration")
    return asked.unionByName(seen, allowMissingColumns=True)


def connected(asked: DataFrame, seen: DataFrame, half_us: int = HALF_US) -> DataFrame:
    """alert_id, uid, conn_row of alerts (alert_id, key, at_us) with a connection of their key in the band.

    The longest connection answers, first seen where equal, and by its uid's last row. Both are
    maxima over a band, so no pairs are formed. Alerts of one id and time are one alert, with
    all of their keys.
    """
    asked = stage(asked.distinct(), "asked")
    instants = asked.select("key", "at_us").distinct()
    near = stage(near_rows(instants, seen, ["key"], half_us), "near")
    length = F.coalesce(F.nullif(F.col("duration"), F.lit(0.0)), F.lit(-1.0))
    rank = F.struct(length.alias("length"), (-F.col("ts_us")).alias("early"),
                    (-F.col("row_id")).alias("tie"), "uid")
    best = band_best(instants, near.select("key", "ts_us", rank.alias("cand")), ["key"], half_us)
    each = Window.partitionBy("alert_id", "at_us")
    wanted = stage(
        asked.join(best, ["key", "at_us"])
        .withColumn("uid", F.max("best").over(each)["uid"]).drop("best")
        .where(F.col("uid").isNotNull()),
        "wanted")
    last = near.where(F.col("uid").isNotNull()).select(
        "key", "uid", "ts_us", F.struct("ts_us", "row_id").alias("cand"))
    ends = wanted.select("key", "uid", "at_us").distinct()
    described = band_best(ends, last.join(ends.select("key", "uid").distinct(), ["key", "uid"], "left_semi"),
                          ["key", "uid"], half_us)
    return wanted.join(described, ["key", "uid", "at_us"]).groupBy("alert_id", "at_us").agg(
        F.max(F.struct("best", "uid")).alias("best")
    ).select("alert_id", F.col("best.uid").alias("uid"), F.col("best.best.row_id").alias("conn_row"))


class Kept(NamedTuple):
    """What one batch leaves to the next, in one of two folders that take turns."""

    root: str
    batch_id: int

    def path(self, name: str) -> str:
        return f"{self.root}/{self.batch_id % 2}/{name}"


def connect_batch(batch: DataFrame, batch_id: int, out_path: str, state: str,
                  half_us: int = HALF_US, late_seconds: int = LATE_SECONDS) -> None:
    """Take in the arrivals of a batch and answer the alerts that no row can reach any more.

    A row at or before the watermark of earlier batches is late and dropped, as in a stateful
    join. Alerts wait until the watermark is a band past them, connections are kept for two bands
    before it. A batch reads what the one before it kept and overwrites what the one before that
    did, so it can be run again; its matches are then compared with those written.
    """
    spark = batch.sparkSession
    rows = stage(batch, "arrived")
    old, new = Kept(state, batch_id - 1), Kept(state, batch_id)
    marks = (None, None, 0)
    if batch_id:
        marks = spark.read.schema(MARKS).parquet(old.path("marks")).first()
    newest = rows.agg(F.max(F.when(F.col("is_alert"), F.col("t"))).alias("asked_us"),
                      F.max(F.when(~F.col("is_alert"), F.col("t"))).alias("seen_us")).first()
    asked_us, seen_us = (max((t for t in pair if t is not None), default=None)
                         for pair in zip(marks[:2], newest, strict=True))
    watermark = marks[2]
    if asked_us is not None and seen_us is not None:
        watermark = max(watermark, min(asked_us, seen_us) // 1000 * 1000 - late_seconds * MICROS)

    timely = rows.where(F.col("t") > marks[2])
    asked = timely.where("is_alert").select("alert_id", "key", F.col("t").alias("at_us"))
    seen = timely.where(~F.col("is_alert")).select("key", F.col("t").alias("ts_us"), "uid", "row_id", "duration")
    if batch_id:
        asked = asked.unionByName(spark.read.schema(asked.schema).parquet(old.path("alerts")))
        seen = seen.unionByName(spark.read.schema(seen.schema).parquet(old.path("conn")))

    ripe = F.col("at_us") + half_us <= watermark
    found = connected(asked.where(ripe), seen, half_us)
    begun = spark.read.schema(BEGUN).parquet(f"{state}/begun").agg(F.max("batch")).first()[0]
    if begun is None or begun >= batch_id:  # perhaps run before: what is written stays
        found = stage(found, "found")
        there = spark.read.schema(found.schema).parquet(out_path).select(
            *[F.col(c).alias(f"_{c}") for c in found.columns])
        same = F.lit(True)
        for c in found.columns:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        found = found.join(there, same, "left_anti")
    spark.createDataFrame([(batch_id,)], BEGUN).write.mode("overwrite").parquet(f"{state}/begun")
    found.write.mode("append").parquet(out_path)

    asked.where(~ripe).write.mode("overwrite").parquet(new.path("alerts"))
    seen.where(F.col("ts_us") > watermark - 2 * half_us).write.mode("overwrite").parquet(new.path("conn"))
    spark.createDataFrame([(asked_us, seen_us, watermark)], MARKS).write.mode("overwrite").parquet(new.path("marks"))


def start_connect(alerts: DataFrame, conn: DataFrame, out_path: str, checkpoint: str,
                  once: bool = False) -> StreamingQuery:
    """Append the matches of two streams to a folder, each alert once."""
    spark, state = alerts.sparkSession, f"{checkpoint.rstrip('/')}-rows"
    kind = alerts.schema["alert_id"].dataType.simpleString()
    for path, schema in ((out_path, f"alert_id {kind}, uid string, conn_row long"), (f"{state}/begun", BEGUN)):
        spark.createDataFrame([], schema).write.mode("append").parquet(path)  # found empty by the first batch
    writer = arrivals(alerts, conn).writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, i: connect_batch(batch, i, out_path, state))
    trigger = {"availableNow": True} if once else {"processingTime": f"{K.POLL_SECONDS} seconds"}
    return writer.trigger(**trigger).start()
