"""Global row numbers without one task holding all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from alertloom.session import stage


def number_rows(df: DataFrame, order: list[Column], start: int = 0, name: str = "row_number",
                ) -> DataFrame:
    """Dense numbers from `start` in the given order, which should be total.

    Rows are range-partitioned and staged with their range number. Each range is numbered by
    its own task, and shifted by the number of rows in the ranges before it; only one count per
    range is ever brought together.
    """
    ranges = stage(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    up_to = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("n"))
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("_before")
    )
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    # One row per range: bounded by the partition count, not by the data.
    return (
        ranges.withColumn("_own", own)
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_before") + F.col("_own") - 1 + start).cast("long"))
        .drop("_range", "_own", "_before")
    )


def continue_numbers(df: DataFrame, existing: DataFrame, order: list[Column]) -> DataFrame:
    """`alert_index` for new rows, going on after the highest index already given."""
    last = existing.agg(F.coalesce(F.max("alert_index"), F.lit(0)).alias("m")).first()["m"]
    return number_rows(df, order, start=last + 1, name="alert_index")
