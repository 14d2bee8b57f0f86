"""The whole triage: alerts and logs in, documents out."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from alertloom import constants as K
from alertloom.operators.collectors.base import Collector
from alertloom.operators.documents import (
    PART_LIMIT, default_collectors, documents, session_summaries, sessions,
)
from alertloom.operators.match import (
    HALF_US, band_hours, hour_folders, match_alerts, scoped_rows, session_scopes, with_row_key,
)
from alertloom.session import stage, stage_all
from alertloom.sources.logs import in_folders, prune_to


def pruned_conn(alerts: DataFrame, conn: DataFrame, half_us: int = HALF_US) -> DataFrame:
    """Connections in reach of any alert; partitioned tables read only the folders involved."""
    span = alerts.agg(F.min("event_us").alias("a"), F.max("event_us").alias("b")).first()
    if span["a"] is None:
        return conn.where(F.lit(False))
    return prune_to(conn, span["a"] - half_us, span["b"] + half_us)


def scoped_logs(alerts: DataFrame, matched: DataFrame, logs: dict[str, DataFrame],
                half_us: int = HALF_US, id_col: str = "alert_id", untimed: bool = False,
                ) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The scopes of matched alerts (id, uid, hours, scope), and the rows of each log in them.

    Partitioned logs are read in the folders of these hours alone, with `untimed` also in the
    folder of rows without a time, which are then in all scopes of their connection.
    """
    scopes = stage(session_scopes(alerts, matched, half_us, id_col), "scopes")
    folders = scopes.select(F.explode(hour_folders(F.col("hours"))).alias("f")).select("f.*")
    return scopes, {
        name: scoped_rows(in_folders(rows, folders, untimed), scopes, untimed)
        for name, rows in logs.items()}


def band_folders(alerts: DataFrame, half_us: int = HALF_US) -> DataFrame:
    """dt, hour of the folders that the bands of alerts touch."""
    hours = band_hours(F.col("event_us"), half_us)
    timed = alerts.where(F.col("event_us").isNotNull())
    return timed.select(F.explode(hour_folders(hours)).alias("f")).select("f.*")


class Seen(NamedTuple):
    """Alerts with their matches (id, uid, conn, matched_by, scope) and the staged rows of each scope."""

    alerts: DataFrame
    id_col: str
    matched: DataFrame
    scopes: DataFrame
    logs: dict[str, DataFrame]


def look_up(alerts: DataFrame, conn: DataFrame, logs: dict[str, DataFrame],
            collectors: Sequence[Collector], half_us: int = HALF_US, id_col: str | None = None,
            untimed: bool = False) -> Seen:
    """Match alerts, and read from each log what concerns them, once."""
    if id_col is None:
        alerts, id_col = with_row_key(alerts), "alert_row"
    near = in_folders(conn, band_folders(alerts, half_us))
    matched = stage(match_alerts(alerts, near, half_us, id_col), "matched")
    scopes, rows = scoped_logs(alerts, matched, {c.name: logs[c.name] for c in collectors},
                               half_us, id_col, untimed)
    own = stage_all({c.name: c.prepare(rows[c.name]) for c in collectors})
    told = matched.join(scopes.select(id_col, "scope"), id_col)
    return Seen(alerts, id_col, told, scopes.select(F.col("scope").alias("uid")), own)


def alert_levels(
    alerts: DataFrame, conn: DataFrame, logs: dict[str, DataFrame],
    collectors: Sequence[Collector] | None = None, rules=K.SEVERITY_RULES,
    half_us: int = HALF_US, id_col: str | None = None,
) -> DataFrame:
    """The facts of each alert's document without the document: what it has, and its levels.

    Levels come from the summaries of sessions, so no evidence table is built.
    """
    collectors = list(collectors or default_collectors())
    seen = look_up(alerts, conn, logs, collectors, half_us, id_col)
    totals = stage_all({c.name: c.totals(seen.logs[c.name]) for c in collectors})
    summary = session_summaries(seen.scopes, totals, collectors, rules)
    levels = summary.select(
        F.col("uid").alias("scope"), *[F.col(c.name)["level"].alias(f"{c.name}_level") for c in collectors])
    known = seen.alerts.join(seen.matched.select(seen.id_col, "uid", "scope"), seen.id_col, "left")
    return known.join(stage(levels, "levels"), "scope", "left").select(
        *dict.fromkeys([seen.id_col, "alert_id"]), "rule_name",
        F.col("uid").isNotNull().alias("has_connection"),
        F.coalesce(*[F.col(f"{c.name}_level") for c in collectors]).isNotNull().alias("has_evidence"),
        *[f"{c.name}_level" for c in collectors])


def enrich(
    alerts: DataFrame, conn: DataFrame, logs: dict[str, DataFrame],
    collectors: Sequence[Collector] | None = None, rules=K.SEVERITY_RULES,
    half_us: int = HALF_US, limit: int = PART_LIMIT, id_col: str | None = None,
    untimed: bool = False,
) -> DataFrame:
    """Documents of all alerts, one for each row, also where alerts are repeated.

    The evidence of an alert is what the logs hold on its connection in the hours that its band
    touches, so it does not depend on other alerts of the run, and partitioned logs are read in
    the folders of those hours alone. Matches and the log rows of matched sessions are staged:
    each log is read once, and every aggregate after that works on the few rows that concern
    an alert. `id_col` names a column that tells the rows apart; without it they are numbered.
    With `untimed`, log rows without a time are evidence of every alert of their connection.
    """
    collectors = list(collectors or default_collectors())
    seen = look_up(alerts, conn, logs, collectors, half_us, id_col, untimed)
    session = sessions(seen.scopes, seen.logs, collectors, rules, limit)
    return documents(seen.alerts, seen.matched, session, [c.name for c in collectors], seen.id_col)
