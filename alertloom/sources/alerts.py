"""Alert sources: raw nested alerts, the day log, analyses, enriched documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertloom.functions.text import content_hash, event_micros, non_empty, normal_port
from alertloom.schemas import ALERT_JSON, ALERT_LOG_JSON, ANALYSIS_JSON
from alertloom.sources.logs import CORRUPT, json_lines

HASH_COLUMNS = ["timestamp", "source_ip", "source_port", "dest_ip", "dest_port", "rule_name"]


def read_alerts_json(spark: SparkSession, *paths: str, array_file: bool = False) -> DataFrame:
    """Nested alerts from JSON lines, or from files holding one JSON array each."""
    if array_file:
        return spark.read.schema(ALERT_JSON).option("multiLine", "true").json(list(paths))
    return _good(json_lines(spark, ALERT_JSON, *paths))


def read_alert_log(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of the day log, back in the shape of nested alerts."""
    return _good(json_lines(spark, ALERT_LOG_JSON, *paths)).select("original_alert.*")


def _good(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def flatten_alerts(nested: DataFrame) -> DataFrame:
    """Top-level alert columns, the original beside them, and the content hash as the id."""
    flat = nested.select(
        F.col("`@timestamp`").alias("timestamp"),
        event_micros(F.col("message")).alias("event_us"),
        F.col("source.ip").alias("source_ip"),
        normal_port(F.col("source.port")).alias("source_port"),
        F.col("destination.ip").alias("dest_ip"),
        normal_port(F.col("destination.port")).alias("dest_port"),
        transport(F.col("network.transport"), F.col("message")).alias("transport"),
        F.col("network.community_id").alias("community_id"),
        F.col("rule.name").alias("rule_name"),
        F.col("rule.category").alias("rule_category"),
        F.col("rule.severity").alias("rule_severity"),
        F.col("event.module").alias("event_module"),
        F.col("event.severity").alias("event_severity"),
        F.struct("*").alias("original_alert"),
    )
    return flat.withColumn("alert_id", alert_hash())


def path_value(df: DataFrame, path: str, default: str = "N/A") -> Column:
    """Text of a dotted path: a flat column of that name first, then the nested field."""
    found = [F.col(f"`{path}`")] if path in df.columns else []
    kind = df.schema
    for step in path.split("."):
        kind = kind[step].dataType if step in getattr(kind, "names", []) else None
    if kind is not None and "." in path:
        found.append(F.col(path))
    return F.coalesce(*[c.cast("string") for c in found], F.lit(default))


def transport(named: Column, message: Column) -> Column:
    """Lower-case transport protocol, from the alert or else from its message."""
    return F.coalesce(
        non_empty(F.lower(named)), F.lower(F.get_json_object(message, "$.proto"))
    )


def alert_hash() -> Column:
    """The identity of a flat alert: SHA-256 of its six key columns."""
    return content_hash(
        *[normal_port(F.col(c)) if c.endswith("_port") else F.col(c) for c in HASH_COLUMNS]
    )


def read_analyses(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(ANALYSIS_JSON).json(list(paths))


def read_document_files(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per document file: its index from the file name, and the parsed document."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return (
        spark.read.text(list(paths), wholetext=True)
        .select(
            F.regexp_extract(name, r"(\d+)\.jsonl?$", 1).try_cast("long").alias("alert_index"),
            F.try_parse_json("value").alias("document"),
        )
    )


def document_at(documents: DataFrame, alert_index: int) -> DataFrame:
    return documents.where(F.col("alert_index") == alert_index)


def alerts_of_day(alerts: DataFrame, day: str, zone: str) -> DataFrame:
    """Alerts of one calendar day in a time zone, for a backfill."""
    local = F.from_utc_timestamp(F.try_to_timestamp("timestamp"), zone)
    return alerts.where(F.to_date(local) == F.lit(day).cast("date"))
