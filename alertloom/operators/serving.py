"""Alerts with their verdicts: search, order, pages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertloom import constants as K
from alertloom.operators.ingest import last_of_each
from alertloom.operators.numbering import number_rows
from alertloom.session import new_table_dir

#: Places that a folder of a stored result holds.
BLOCK_ROWS = 100_000


def or_na(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("N/A"))


def triage_view(alerts: DataFrame, analyses: DataFrame,
                order: tuple[str, ...] = ("processed_at",)) -> DataFrame:
    """Alerts (with a zero-based `alert_index`) and the latest analysis of each.

    An analysis of index n belongs to the alert at position n - 1.
    """
    last = last_of_each(analyses, ["alert_index"], list(order)).select(
        (F.col("alert_index") - 1).alias("alert_index"),
        F.col("llm_analysis.result").alias("_result"),
    )
    conclusion = F.col("_result.conclusion")
    pending = F.to_json(F.struct(F.lit("Pending Analysis").alias("status")))
    return alerts.join(last, "alert_index", "left").select(
        F.concat_ws("-", or_na("timestamp"), F.col("alert_index").cast("string"))
        .alias("unique_id"),
        "alert_index",
        or_na("timestamp").alias("timestamp"),
        or_na("rule_name").alias("alert_name"),
        or_na("source_ip").alias("source_ip"),
        or_na("source_port").alias("source_port"),
        or_na("dest_ip").alias("dest_ip"),
        or_na("dest_port").alias("dest_port"),
        F.coalesce(conclusion["classification"], F.lit(K.PENDING_VERDICT)).alias("llm_verdict"),
        F.coalesce(conclusion["reasoning_summary"], F.lit(K.PENDING_SUMMARY))
        .alias("reasoning_summary"),
        F.coalesce(F.to_json("_result"), pending).alias("llm_result_json"),
    )


def search(view: DataFrame, text: str = "", verdict: str = "All") -> DataFrame:
    """Rows with a text in their name or addresses, and with a verdict."""
    out = view
    if text:
        low = text.lower()
        out = out.where(
            F.lower("alert_name").contains(low) | F.col("source_ip").contains(low)
            | F.col("dest_ip").contains(low)
        )
    if verdict != "All":
        out = out.where(F.col("llm_verdict") == verdict)
    return out


def view_order(ground_truth: bool = False) -> list[Column]:
    index = F.col("alert_index")
    return [index.asc() if ground_truth else index.desc()]


def result_size(view: DataFrame, per_page: int = K.PAGE_SIZE) -> DataFrame:
    """n_total and n_pages of a result; an empty result has one page."""
    n = F.count("*")
    return view.agg(
        n.alias("n_total"),
        F.greatest(F.ceil(n / per_page), F.lit(1)).cast("long").alias("n_pages"),
    )


def store_result(view: DataFrame, path: str, ground_truth: bool = False) -> None:
    """Write a result in its order, each row with its place `_n`, in folders of `BLOCK_ROWS` places.

    The number of rows is kept beside it, so no page counts them again.
    """
    rows = number_rows(view, view_order(ground_truth), name="_n")
    rows = rows.withColumn("block", (F.col("_n") / BLOCK_ROWS).cast("long"))
    rows.hint("rebalance", "block").write.mode("overwrite").partitionBy("block").parquet(f"{path}/rows")
    rows.where(F.lit(False)).write.mode("overwrite").parquet(f"{path}/columns")
    stored = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    stored.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/size")


def stored_page(spark: SparkSession, path: str, number: int, per_page: int = K.PAGE_SIZE) -> DataFrame:
    """One page of a stored result; numbers past the end give the last page.

    Early and deep pages are read alike, from the folders that hold their places.
    """
    total = spark.read.parquet(f"{path}/size").first()["n"]
    pages = max(1, math.ceil(total / per_page))
    first = (max(1, min(number, pages)) - 1) * per_page
    last = first + per_page - 1
    inside = F.col("block").between(first // BLOCK_ROWS, last // BLOCK_ROWS)
    stored = spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")
    rows = stored.where(inside & F.col("_n").between(first, last))
    return rows.orderBy("_n").drop("_n", "block")


def page(view: DataFrame, number: int, ground_truth: bool = False,
         per_page: int = K.PAGE_SIZE) -> DataFrame:
    """One page of a result, which is stored first; store it once to read several pages."""
    path = new_table_dir(view.sparkSession, "result")
    store_result(view, path, ground_truth)
    return stored_page(view.sparkSession, path, number, per_page)


def display_time(timestamp: Column) -> Column:
    return F.date_format(F.try_to_timestamp(timestamp), "yyyy-MM-dd HH:mm:ss")
