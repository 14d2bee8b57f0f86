"""The connection block of a document, from the connection row chosen for the alert."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from alertloom.functions import network
from alertloom.functions.text import non_empty


def conn_identity(c: Column) -> Column:
    """Identity fields; empty texts and zero ports count as absent."""
    return F.struct(
        non_empty(c["orig_h"]).alias("source_ip"),
        F.nullif(c["orig_p"], F.lit(0)).alias("source_port"),
        non_empty(c["resp_h"]).alias("destination_ip"),
        F.nullif(c["resp_p"], F.lit(0)).alias("destination_port"),
        network.traffic_direction(c["orig_h"], c["resp_h"]).alias("traffic_direction"),
        non_empty(c["service"]).alias("service"),
        non_empty(c["proto"]).alias("transport_protocol"),
    )


def conn_statistics(c: Column) -> Column:
    return F.struct(
        F.round(F.coalesce(c["duration"], F.lit(0.0)), 4).alias("duration_seconds")
    )


def conn_analysis(c: Column) -> Column:
    return F.struct(
        network.conn_assessment(c["conn_state"]).alias("overall_assessment"),
        network.conn_state_text(c["conn_state"]).alias("connection_state_desc"),
        F.struct(
            F.coalesce(c["orig_bytes"], F.lit(0)).alias("upload_bytes"),
            F.coalesce(c["resp_bytes"], F.lit(0)).alias("download_bytes"),
            network.flow_ratio(c["orig_bytes"], c["resp_bytes"]).alias("ratio"),
        ).alias("flow_ratio"),
    )


def connection_block(c: Column) -> Column:
    """identity, statistics and analysis of a connection; null without one."""
    block = F.struct(
        conn_identity(c).alias("identity"),
        conn_statistics(c).alias("statistics"),
        conn_analysis(c).alias("analysis"),
    )
    return F.when(c.isNotNull(), block)
