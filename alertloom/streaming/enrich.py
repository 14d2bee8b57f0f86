"""Streaming enrichment: every micro-batch of alerts runs through the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from alertloom import constants as K
from alertloom.operators.numbering import continue_numbers
from alertloom.plans.enrich import enrich
from alertloom.session import stage

COUNTS = "alert_index bigint, batch bigint"


def enrich_batch(batch: DataFrame, batch_id: int, conn: DataFrame, logs: dict[str, DataFrame],
                 out_path: str, counts_path: str) -> None:
    """Number the alerts of a batch after those of earlier ones, enrich and write them.

    Output goes to a folder per batch that a rerun overwrites, so a batch counts once. The last
    number of each batch is kept beside it, one row a batch, so that no output is read again.
    Log rows are evidence by their connection and hour; no row is left out for want of a time.
    """
    spark = batch.sparkSession
    done = spark.read.schema(COUNTS).parquet(counts_path).where(F.col("batch") < batch_id)
    order = [F.col("timestamp"), F.col("alert_id")]
    alerts = stage(continue_numbers(batch, done, order), "numbered")
    docs = enrich(alerts, conn, logs, id_col="alert_index", untimed=True)
    docs.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
    last = alerts.select(F.col("alert_index")).unionByName(done.select("alert_index")).agg(
        F.max("alert_index").alias("alert_index"))
    last.write.mode("overwrite").parquet(f"{counts_path}/batch={batch_id}")


def start_enrich(alerts: DataFrame, logs: Callable[[], tuple[DataFrame, dict[str, DataFrame]]],
                 out_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Enrich a stream of flat alerts; `logs` returns conn and the protocol logs of the moment."""
    counts_path = f"{checkpoint.rstrip('/')}-numbers"
    none = alerts.sparkSession.createDataFrame([], "alert_index bigint")
    none.write.mode("overwrite").parquet(f"{counts_path}/batch=-1")

    def run(batch: DataFrame, batch_id: int) -> None:
        conn, protocol_logs = logs()
        enrich_batch(batch, batch_id, conn, protocol_logs, out_path, counts_path)

    writer = alerts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    trigger = {"availableNow": True} if once else {"processingTime": f"{K.POLL_SECONDS} seconds"}
    return writer.trigger(**trigger).start()
