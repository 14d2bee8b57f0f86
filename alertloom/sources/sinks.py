"""Sinks: documents, analyses, day logs, CSV and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from alertloom import constants as K


def write_documents(documents: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON document per line, one folder per alert day; rows need `timestamp`, `document`.

    Lines are gzipped, which readers undo by the file's name: documents of one session are much alike.
    """
    day = F.coalesce(F.to_date(F.try_to_timestamp("timestamp")).cast("string"), F.lit("unknown"))
    (
        documents.select(day.alias("dt"), F.col("document").alias("value"))
        .write.mode(mode).partitionBy("dt").option("compression", "gzip").text(path)
    )


def write_run(rows: DataFrame, path: str, run: str) -> None:
    """JSON lines of one run, in a folder of its own: a rerun replaces them, so they count once."""
    rows.write.mode("overwrite").json(f"{path}/run={run}")


def write_analyses(analyses: DataFrame, path: str, run: str) -> None:
    """The analysis records of one run beside those of others."""
    write_run(analyses, path, run)


def local_day(timestamp, zone: str = K.LOCAL_TIME_ZONE):
    return F.to_date(F.from_utc_timestamp(F.try_to_timestamp(timestamp), zone))


def write_day_log(alerts: DataFrame, path: str, zone: str = K.LOCAL_TIME_ZONE) -> None:
    """Append flat alerts to the log of their local day."""
    (
        alerts.withColumn("local_day", local_day(F.col("timestamp"), zone))
        .write.mode("append").partitionBy("local_day").parquet(path)
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
