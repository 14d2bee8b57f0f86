"""Network log sources: JSON lines (plain or gzip), hot and archive, and a pruned table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertloom.schemas import LOG_JSON

CORRUPT = "_corrupt_record"


def row_id(df: DataFrame) -> Column:
    """A content key of a row: equal for copies of one row, and the tie-break of its order."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])


def json_lines(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """Parsed JSON lines of files; those ending in .gz are unpacked on the way."""
    return parsed_lines(spark.read.text(list(paths)), schema)


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Parsed JSON lines (column `value`); a malformed line keeps only its text, in `_corrupt_record`."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json("value", f"{schema}, {CORRUPT} STRING", options)
    return lines.where(F.trim("value") != "").select(parsed.alias("j")).select("j.*")


def read_log_json(spark: SparkSession, log_type: str, *paths: str) -> DataFrame:
    """Rows of a log together with its malformed lines."""
    return json_lines(spark, LOG_JSON[log_type], *paths)


def quarantine(df: DataFrame) -> DataFrame:
    """The malformed lines of a log, for inspection."""
    return df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def log_rows(raw: DataFrame, log_type: str) -> DataFrame:
    """The flat table of a log: malformed rows dropped, time in microseconds, dots renamed."""
    good = raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT) if CORRUPT in raw.columns else raw
    with_id = good.withColumn("row_id", row_id(good))
    flat = with_id.withColumnsRenamed(
        {"id.orig_h": "orig_h", "id.orig_p": "orig_p", "id.resp_h": "resp_h",
         "id.resp_p": "resp_p", "TTLs": "ttls"}
    )
    flat = flat.withColumn("ts_us", F.round(F.col("ts") * 1_000_000).cast("long")).drop("ts")
    if log_type == "files":
        # A file belongs to every connection that carried it.
        uids = F.array_distinct(
            F.array_compact(F.concat(F.array("uid"),
                                     F.coalesce("conn_uids", F.array().cast("array<string>"))))
        )
        flat = flat.withColumn("uid", F.explode(uids)).drop("conn_uids")
    return flat


def read_log(spark: SparkSession, log_type: str, *paths: str) -> DataFrame:
    return log_rows(read_log_json(spark, log_type, *paths), log_type)


def with_hot(archive: DataFrame, hot: DataFrame) -> DataFrame:
    """Archive and current rows together, a row present in both taken once."""
    keys = [c for c in ("uid", "ts_us", "row_id") if c in archive.columns]
    return archive.unionByName(hot, allowMissingColumns=True).dropDuplicates(keys)


def write_log_table(rows: DataFrame, path: str, mode: str = "append",
                    by: tuple[str, ...] = ("dt", "hour")) -> None:
    """The columnar table of a log, one folder per UTC day and hour (or day, for small logs).

    The rebalance keeps a folder in few files, and splits folders too large for one task.
    """
    stamp = F.timestamp_micros("ts_us")
    folders = {"dt": F.to_date(stamp), "hour": F.hour(stamp)}
    (
        rows.withColumns({name: folders[name] for name in by})
        .hint("rebalance", *by)
        .write.mode(mode).partitionBy(*by).parquet(path)
    )


def read_log_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def prune_to(rows: DataFrame, first_us: int, last_us: int) -> DataFrame:
    """Only the day and hour folders that touch a time span, then only the span itself.

    The span covers every hour a match band reaches, also across midnight. Tables without
    folders are cut by their `ts_us`, which reaches the scan as a pushed filter.
    """
    inside = rows.where(F.col("ts_us").between(first_us, last_us))
    if "dt" not in rows.columns:
        return inside
    first, last = F.timestamp_micros(F.lit(first_us)), F.timestamp_micros(F.lit(last_us))
    dt, hour = F.col("dt"), F.col("hour")
    inside = inside.where(dt.between(F.to_date(first), F.to_date(last)))
    if "hour" not in rows.columns:
        return inside
    return inside.where(
        ((dt > F.to_date(first)) | (hour >= F.hour(first)))
        & ((dt < F.to_date(last)) | (hour <= F.hour(last)))
    )


def in_folders(rows: DataFrame, folders: DataFrame, untimed: bool = False) -> DataFrame:
    """Only the given day and hour folders (dt, hour) of a log table; other tables as they are.

    The folders prune the scan while the query runs. There are 24 of them a day at most, so their
    broadcast is bounded by the time that the log covers. With `untimed`, the folder of rows
    without a time is read too.
    """
    keys = [c for c in ("dt", "hour") if c in rows.columns]
    if not keys:
        return rows
    counted = folders.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 0)
    inside = rows.join(F.broadcast(counted.drop("n")), keys, "left_semi")
    return inside.unionByName(rows.where(F.col(keys[0]).isNull())) if untimed else inside


def list_log_files(spark: SparkSession, root: str, suffix: str = ".log.gz") -> DataFrame:
    """Path and size of log files in date-named folders; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length")
        .where(F.col("path").rlike(r"/\d{4}-\d{2}-\d{2}[^/]*/[^/]+$"))
    )


def changed_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new, or whose size differs from the one in the manifest."""
    return found.join(manifest.select("path", "length"), ["path", "length"], "left_anti")


def file_spans(files: DataFrame) -> DataFrame:
    """Log type, day and half-open time-of-day span of archive files, read off their names.

    An end of 00:00:00 means the end of the day.
    """
    name = F.element_at(F.split("path", "/"), -1)
    day = F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})[^/]*/[^/]+$", 1)
    span = r"\.(\d{2}:\d{2}:\d{2})-(\d{2}:\d{2}:\d{2})\.log"

    def seconds(group: int) -> Column:
        text = F.regexp_extract(name, span, group)
        part = [F.split_part(text, F.lit(":"), F.lit(i)).cast("int") for i in (1, 2, 3)]
        return part[0] * 3600 + part[1] * 60 + part[2]

    return (
        files.where(name.rlike(span))
        .withColumn("log_type", F.split_part(name, F.lit("."), F.lit(1)))
        .withColumn("day", F.to_date(day))
        .withColumn("start_s", seconds(1))
        .withColumn("end_s", F.when(seconds(2) == 0, 86400).otherwise(seconds(2)))
    )
