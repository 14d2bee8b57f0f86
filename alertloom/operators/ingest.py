"""Alert selection and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from alertloom import constants as K
from alertloom.sources.alerts import alert_hash


def select_alerts(
    alerts: DataFrame, module: str = K.IDS_MODULE,
    severities: Sequence[str] = K.ALERT_SEVERITIES,
    start: Column | None = None, end: Column | None = None,
) -> DataFrame:
    """Flat alerts of one module with a listed severity on either field, in a closed time span."""
    severe = F.coalesce(F.col("rule_severity").isin(*severities), F.lit(False)) | F.coalesce(
        F.col("event_severity").isin(*severities), F.lit(False)
    )
    out = alerts.where((F.col("event_module") == module) & severe)
    stamp = F.try_to_timestamp("timestamp")
    if start is not None:
        out = out.where(stamp >= start)
    if end is not None:
        out = out.where(stamp <= end)
    return out


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in an order; copies are reduced before the shuffle."""
    return _one_of_each(df, keys, order, F.min_by)


def last_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _one_of_each(df, keys, order, F.max_by)


def _one_of_each(df, keys, order, pick) -> DataFrame:
    row = pick(F.struct(*df.columns), F.struct(*order)).alias("row")
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(row).select(
        "row.*"
    )


def deduplicate(alerts: DataFrame, order: Sequence[str] = ("timestamp", "alert_id")) -> DataFrame:
    """First alert of each content hash, which becomes `alert_hash`."""
    return first_of_each(alerts.withColumn("alert_hash", alert_hash()), ["alert_hash"], order)


def not_in_log(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Alerts whose hash the log does not hold; both sides have `alert_hash`."""
    return alerts.join(log.select("alert_hash"), "alert_hash", "left_anti")


def new_alerts(main: DataFrame, look_back: DataFrame, log: DataFrame,
               order: Sequence[str] = ("timestamp", "alert_id")) -> DataFrame:
    """One ingestion cycle: both windows together, de-duplicated, minus the log, by time."""
    both = main.unionByName(look_back)
    return not_in_log(deduplicate(both, order), log).orderBy("timestamp", "alert_hash")
