"""Archive files by time of day: which file covers an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def covering_file(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Each point with the first file whose half-open span holds it.

    points: day, second (of the day), keys. spans: day, start_s, end_s, path. Spans are cut
    into hours, so day and hour are equality keys and a point meets the few files of its hour.
    """
    hours = spans.where(F.col("end_s") > F.col("start_s")).withColumn(
        "hour",
        F.explode(F.sequence(F.floor(F.col("start_s") / 3600),
                             F.floor((F.col("end_s") - 1) / 3600))),
    )
    met = points.withColumn("hour", F.floor(F.col("second") / 3600)).join(hours, ["day", "hour"])
    held = met.where(
        (F.col("second") >= F.col("start_s")) & (F.col("second") < F.col("end_s"))
    )
    return held.groupBy(*keys).agg(F.min("path").alias("path"))
