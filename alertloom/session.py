"""Session defaults and staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "alertloom", cores: int | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter owns these settings."""
    n = cores or 8
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        # Call sites of column operations are costly to record.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session may fall back to a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        fallback = tempfile.mkdtemp(prefix="alertloom-")
        spark.conf.set("spark.checkpoint.dir", fallback)
        return fallback
    raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")


def new_table_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/alertloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where several branches consume one costly or order-sensitive input: the branches then
    agree on its rows, a lost executor costs a re-read instead of a re-run, and plans stay short.
    """
    spark = df.sparkSession
    path = new_table_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Stage independent tables at once, so that their jobs share the cluster."""
    with ThreadPoolExecutor(len(tables)) as pool:
        running = {name: pool.submit(stage, df, name) for name, df in tables.items()}
        return {name: f.result() for name, f in running.items()}
