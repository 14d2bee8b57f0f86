"""New lines of growing log files: a manifest of what has been read, committed after the lines."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from alertloom.session import stage

MANIFEST = "path string, length long, offset long, run long"


def listed_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, length of the files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").load(root)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"))
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of each file; the first call makes an empty manifest."""
    spark.createDataFrame([], "path string, length long, offset long").write.mode("ignore").parquet(f"{path}/run=-1")
    rows = spark.read.schema(MANIFEST).parquet(path)
    last = F.max_by(F.struct("length", "offset", "run"), "run").alias("last")
    return rows.groupBy("path").agg(last).select("path", "last.*")


def files_to_read(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, length, start: files that are new or of another length, and where to read on.

    A file that grew is read on behind its last whole line; a new one, or one that became
    shorter and so is another file by now, from its start. Packed files cannot be read on.
    """
    known = manifest.select("path", F.col("length").alias("_length"), "offset")
    grown = (F.col("length") > F.col("_length")) & ~F.col("path").endswith(".gz")
    return (
        found.join(known, "path", "left")
        .where(F.col("_length").isNull() | (F.col("length") != F.col("_length")))
        .select("path", "length", F.when(grown, F.col("offset")).otherwise(0).cast("long").alias("start"))
    )


def placed_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, value, begin, end: the lines of files with their place in bytes.

    A line belongs to the split it begins in, so the splits before it add up to where a split's
    first line begins. A window holds the lines of one split, however long the file is.
    """
    lines = stage(
        spark.read.option("lineSep", "\n").text(paths).select(
            "value", F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")),
        "lines")
    size = F.octet_length("value") + 1
    splits = lines.groupBy("path", "split").agg(F.sum(size).alias("bytes"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("bytes").over(earlier), F.lit(0))).drop("bytes")
    up_to = Window.partitionBy("path", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ended = lines.withColumn("end", F.sum(size).over(up_to)).join(splits, ["path", "split"])
    end: Column = F.col("end") + F.col("before")
    return ended.select("path", "value", (end - size).alias("begin"), end.alias("end"))


def sync_lines(spark: SparkSession, root: str, glob: str, manifest_path: str, out_path: str) -> int:
    """Read what is new below `root` into the folder of the next run, then commit it; the run's number.

    Lines (path, value) of a run are written before its manifest. A run that was cut off is
    done again under its number and replaces what it wrote, so each line is taken once. A line without its end
    is left for a later run. The names of changed files go through the driver, as in any listing.
    """
    manifest = read_manifest(spark, manifest_path)
    run = spark.read.schema(MANIFEST).parquet(manifest_path).agg(F.coalesce(F.max("run"), F.lit(-1))).first()[0] + 1
    wanted = stage(files_to_read(listed_files(spark, root, glob), manifest), "changed-files")
    paths = [unquote(r["path"]) for r in wanted.select("path").collect()]
    if not paths:
        return run - 1
    whole = (F.col("end") <= F.col("length")) | F.col("path").endswith(".gz")
    read = stage(placed_lines(spark, paths).join(wanted, "path").where((F.col("begin") >= F.col("start")) & whole),
                 "new-lines")
    read.select("path", "value").write.mode("overwrite").parquet(f"{out_path}/run={run}")
    ends = read.groupBy("path").agg(F.max("end").alias("_end"))
    wanted.join(ends, "path", "left").select("path", "length", F.coalesce("_end", "start").alias("offset")).write.mode(
        "overwrite").parquet(f"{manifest_path}/run={run}")
    return run
