"""Alert to connection: community id first, 5-tuple as fallback, longest connection wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertloom import constants as K
from alertloom.functions.text import normal_port
from alertloom.operators.band import band_best, near_rows
from alertloom.operators.skew import salted_semi
from alertloom.session import stage

HALF_US = K.MATCH_WINDOW_SECONDS * 1_000_000
HOUR_US = 3_600_000_000
NO_HOUR = -(2**63)  # stands for the hour of a row without a time
CONN_FIELDS = [
    "orig_h", "orig_p", "resp_h", "resp_p", "proto", "service", "conn_state", "duration",
    "orig_bytes", "resp_bytes",
]


def community_key(community_id: str) -> Column:
    """Match key of a community id; null without one."""
    c = F.col(community_id)
    return F.when(c != "", F.concat(F.lit("c|"), c))


def tuple_key(*parts: Column) -> Column:
    """Match key of a 5-tuple (addresses, ports, protocol); null unless complete."""
    texts = [p.cast("string") for p in parts]
    pieces = [F.lit("t")]
    for t in texts:
        pieces += [F.lit("|"), t]
    return F.concat(*pieces)


def alert_tuple_key() -> Column:
    return tuple_key(
        F.col("source_ip"), normal_port(F.col("source_port")), F.col("dest_ip"),
        normal_port(F.col("dest_port")), F.lower("transport"),
    )


def conn_tuple_key() -> Column:
    return tuple_key(*[F.col(c) for c in ("orig_h", "orig_p", "resp_h", "resp_p", "proto")])


def keyed(conn: DataFrame, *keys: Column) -> DataFrame:
    """A connection row once per match key it has."""
    return conn.withColumn("key", F.explode(F.array_compact(F.array(*keys))))


def band_hours(at_us: Column, half_us: int = HALF_US) -> Column:
    """Numbers of the UTC hours that the band of an alert touches."""
    hour = lambda t: F.floor(t / HOUR_US)
    return F.sequence(hour(at_us - half_us + 1), hour(at_us + half_us - 1))


def hour_folders(hours: Column) -> Column:
    """Day and hour folder (dt, hour) of each hour number."""
    stamp = lambda h: F.timestamp_seconds(h * 3600)
    return F.transform(hours, lambda h: F.struct(
        F.to_date(stamp(h)).alias("dt"), F.hour(stamp(h)).alias("hour")))


def with_row_key(alerts: DataFrame) -> DataFrame:
    """Alerts, written, with `alert_row`: a number of each row, also where alerts are equal."""
    return stage(alerts.withColumn("alert_row", F.monotonically_increasing_id()), "alerts")


def probes(alerts: DataFrame, key: Column, id_col: str = "alert_id") -> DataFrame:
    """id, key, at_us of the alerts that have a key and an event time."""
    return alerts.select(id_col, key.alias("key"), F.col("event_us").alias("at_us")).dropna()


def best_connection(
    points: DataFrame, conn: DataFrame, half_us: int = HALF_US
) -> DataFrame:
    """Probes with uid and conn: the longest connection of each, by the uid's last row.

    Duration null or zero ranks as -1, ties go to the connection seen first; if the longest has
    no uid, the probe has no connection. The last row of the chosen uid within the band describes
    the connection. The log is scanned once, for the rows near a probe; both passes work on those.
    """
    points = stage(points, "points")
    instants = points.select("key", "at_us").distinct()
    near = stage(near_rows(instants, conn, ["key"], half_us), "near")
    length = F.coalesce(F.nullif(F.col("duration"), F.lit(0.0)), F.lit(-1.0))
    longest = near.select(
        "key", "ts_us",
        F.struct(length.alias("length"), (-F.col("ts_us")).alias("early"),
                 (-F.col("row_id")).alias("tie"), "uid").alias("cand"),
    )
    winners = stage(
        band_best(instants, longest, ["key"], half_us).select(
            "key", "at_us", F.col("best.uid").alias("uid")
        ).where(F.col("uid").isNotNull()),
        "winners",
    )
    latest = salted_semi(near, winners, ["key", "uid"])
    row = F.struct("ts_us", "row_id", *CONN_FIELDS)
    described = band_best(
        winners, latest.select("key", "uid", "ts_us", row.alias("cand")), ["key", "uid"], half_us
    )
    return points.join(described, ["key", "at_us"]).withColumnRenamed("best", "conn").drop("at_us")


def match_by_community(
    alerts: DataFrame, conn: DataFrame, half_us: int = HALF_US, id_col: str = "alert_id"
) -> DataFrame:
    """id, uid, conn for alerts with a connection of their community id in the band."""
    key = community_key("community_id")
    return best_connection(probes(alerts, key, id_col), keyed(conn, key), half_us).drop("key")


def with_community_hit(alerts: DataFrame, conn: DataFrame, half_us: int = HALF_US) -> DataFrame:
    """Adds `has_rows`: whether an hour that the alert's band touches has a row of its community id.

    Only those hours count, whatever other alerts are asked about in the same run. Alerts and rows
    meet as distinct (community id, hour), so copies collapse before they are shuffled.
    """
    hour = F.floor(F.col("ts_us") / HOUR_US)
    known = conn.where(F.col("community_id") != "").select(
        F.col("community_id").alias("_id"), hour.alias("_hour")).distinct()
    asked = alerts.where((F.col("community_id") != "") & F.col("event_us").isNotNull()).select(
        F.col("community_id").alias("_id"), F.col("event_us").alias("_at")).distinct()
    each = asked.withColumn("_hour", F.explode(band_hours(F.col("_at"), half_us)))
    hits = each.join(known, ["_id", "_hour"], "left_semi").select("_id", "_at").distinct()
    # Null keys do not meet: an outer join leaves their rows where they are.
    usable = F.when(F.col("community_id") != "", F.col("community_id"))
    return (
        alerts.withColumn("_id", usable).withColumn("_at", F.col("event_us"))
        .join(hits.withColumn("_hit", F.lit(True)), ["_id", "_at"], "left")
        .withColumn("has_rows", F.col("_hit").isNotNull())
        .drop("_id", "_at", "_hit")
    )


def match_by_tuple(
    alerts: DataFrame, conn: DataFrame, half_us: int = HALF_US, id_col: str = "alert_id"
) -> DataFrame:
    """id, uid, conn by 5-tuple, for alerts without any row of their community id.

    One row outside the band, in an hour that the band touches, already blocks the fallback.
    """
    rest = with_community_hit(alerts, conn, half_us).where(~F.col("has_rows"))
    return best_connection(
        probes(rest, alert_tuple_key(), id_col), keyed(conn, conn_tuple_key()), half_us
    ).drop("key")


def match_alerts(
    alerts: DataFrame, conn: DataFrame, half_us: int = HALF_US, id_col: str = "alert_id"
) -> DataFrame:
    """id, uid, conn, matched_by for every alert with a connection.

    Each alert asks with one key, by community id or by 5-tuple, so one pass serves both.
    `id_col` must differ between rows: `with_row_key` gives such a column to repeated alerts.
    """
    routed = with_community_hit(alerts, conn, half_us)
    key = F.when(F.col("has_rows"), community_key("community_id")).otherwise(alert_tuple_key())
    rows = keyed(conn, community_key("community_id"), conn_tuple_key())
    by = F.when(F.col("key").startswith("c|"), "community").otherwise("tuple")
    return best_connection(probes(routed, key, id_col), rows, half_us).select(
        id_col, "uid", "conn", by.alias("matched_by")
    )


def session_rows(log: DataFrame, uids: DataFrame) -> DataFrame:
    """The rows of a log that belong to matched connections."""
    return salted_semi(log, uids, ["uid"])


def session_scopes(alerts: DataFrame, matched: DataFrame, half_us: int = HALF_US,
                   id_col: str = "alert_id") -> DataFrame:
    """id, uid, hours, scope: each matched alert's part of a session, by the hours its band touches.

    Alerts of one connection with the same hours share a scope, and so its evidence.
    """
    hours = band_hours(F.col("event_us"), half_us)
    scope = F.concat_ws("@", "uid", F.array_join(F.col("hours").cast("array<string>"), "-"))
    return (
        alerts.select(id_col, hours.alias("hours")).join(matched.select(id_col, "uid"), id_col)
        .withColumn("scope", scope)
    )


def scoped_rows(log: DataFrame, scopes: DataFrame, untimed: bool = False) -> DataFrame:
    """The rows of a log in each scope; `uid` becomes the scope.

    A row is in one scope for each set of hours it belongs to, three at most. With `untimed`, a
    row without a time may be of any hour and is in all scopes of its connection. The result is
    meant to be staged as it is, so that adaptive execution may split the join on a hot session.
    """
    hours, hour = F.col("hours"), F.floor(F.col("ts_us") / HOUR_US)
    if untimed:
        hours, hour = F.array_append(hours, F.lit(NO_HOUR)), F.coalesce(hour, F.lit(NO_HOUR))
    wanted = scopes.select("uid", "scope", F.explode(hours).alias("_hour")).distinct()
    rows = log.withColumn("_hour", hour)
    joined = rows.join(wanted, ["uid", "_hour"])
    return joined.withColumn("uid", F.col("scope")).drop("scope", "_hour")
