"""Labelled flow CSVs and the CSV hand-overs of the ground-truth steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FLOW_COLUMNS = {
    "Source IP": "source_ip",
    "Source Port": "source_port",
    "Destination IP": "dest_ip",
    "Destination Port": "dest_port",
    "Protocol": "protocol",
    "Label": "original_label",
}


def read_flows(spark: SparkSession, *paths: str) -> DataFrame:
    """The six needed columns of flow CSVs, whatever blanks stand around their headers.

    Files may list their columns in different orders, so each folder, glob or file given is
    read with its own header and the results are united by name.
    """
    parts = []
    for path in paths:
        raw = (
            spark.read.option("header", "true").option("encoding", "ISO-8859-1")
            .option("enforceSchema", "false").csv(path)
        )
        wanted = {c: FLOW_COLUMNS[c.strip()] for c in raw.columns if c.strip() in FLOW_COLUMNS}
        parts.append(raw.select([F.col(f"`{c}`").alias(a) for c, a in wanted.items()]))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return typed_flows(rows)


def typed_flows(rows: DataFrame) -> DataFrame:
    """Integer ports and protocol; rows without a full 5-tuple dropped."""
    def whole(name: str):
        return F.col(name).try_cast("double").try_cast("int").alias(name)

    return rows.select(
        "source_ip", whole("source_port"), "dest_ip", whole("dest_port"), whole("protocol"),
        "original_label",
    ).dropna(subset=["source_ip", "source_port", "dest_ip", "dest_port", "protocol"])


MAPPED_CSV = """
    timestamp STRING, alert_name STRING, category STRING, severity STRING, source_ip STRING,
    source_port INT, destination_ip STRING, destination_port INT, transport STRING,
    original_label STRING
"""


def read_mapped(spark: SparkSession, *paths: str, labelled: bool = False) -> DataFrame:
    schema = MAPPED_CSV + (", classification_label STRING" if labelled else "")
    return spark.read.schema(schema).option("header", "true").csv(list(paths))
