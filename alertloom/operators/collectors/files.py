"""File sessions: risk of transferred files, grouped by reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertloom import constants as K
from alertloom.functions.text import either, labels
from alertloom.operators.collectors.base import evidence_rows, first_n, item, position

# One bit per reason, in alphabetical order.
FILE_REASONS = sorted(K.FILE_REASON_SCORES)
UPLOAD, DOWNLOAD = 1, 2


def file_mask() -> Column:
    """Reasons to suspect a file, from its name, type and entropy."""
    name, mime, real = F.lower("filename"), F.col("mime_type"), F.col("analysis_mime_type")
    hits = {
        "SUSPICIOUS_EXTENSION": either(name.endswith(e) for e in K.FILE_RISKY_EXTENSIONS),
        "SUSPICIOUS_MIME": mime.isin(K.RISKY_MIME_TYPES),
        "HIGH_ENTROPY": F.col("entropy") > K.FILE_HIGH_ENTROPY,
        "MIME_MISMATCH": (mime != "") & (real != "") & (mime != real),
    }
    mask = F.lit(0)
    for bit, reason in enumerate(FILE_REASONS):
        mask = mask + F.when(hits[reason], 1 << bit).otherwise(0)
    return mask


def has_bit(mask: Column, reason: str) -> Column:
    return mask.bitwiseAND(1 << FILE_REASONS.index(reason)) != 0


def file_reasons(mask: Column) -> Column:
    return labels(*[(has_bit(mask, r), r) for r in FILE_REASONS])


def risk_score(mask: Column) -> Column:
    score = F.lit(K.FILE_BASE_SCORE)
    for reason, points in K.FILE_REASON_SCORES.items():
        score = score + F.when(has_bit(mask, reason), points).otherwise(0)
    return score


def severity(score: Column) -> Column:
    (floor, name), *rest = K.FILE_SEVERITY_FLOORS
    out = F.when(score >= floor, name)
    for floor, name in rest:
        out = out.when(score >= floor, name)
    return out.otherwise("Informational")


def severity_name(rank: Column) -> Column:
    ranks = K.FILE_SEVERITY_RANKS
    return F.element_at(F.array(*[F.lit(n) for n in ranks]), rank + 1)


def severity_rank(name: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in K.FILE_SEVERITY_RANKS.items() for x in kv])
    return ranks[name]


def file_findings(rows: DataFrame) -> DataFrame:
    """One row per file with its risk, direction, hashes and transfer notes."""
    mask = F.col("mask")
    notes = labels((F.col("timedout"), "Timed Out"), (F.col("missing_bytes") > 0, "Missing Bytes"))
    return rows.withColumn("mask", file_mask()).select(
        "uid", F.lit("FileAnalysisFinding").alias("type"), "fuid", "filename",
        F.when(F.col("is_orig"), "Upload").otherwise("Download").alias("direction"),
        severity(risk_score(mask)).alias("severity"),
        risk_score(mask).alias("risk_score"),
        F.coalesce("seen_bytes", F.lit(0)).alias("size_bytes"),
        file_reasons(mask).alias("reasons"),
        F.expr("nullif(mime_type, '')").alias("file_type_reported"),
        F.expr("nullif(analysis_mime_type, '')").alias("file_type_actual"),
        F.round("entropy", 2).alias("entropy"),
        F.struct(F.expr("nullif(md5, '')").alias("md5"), F.expr("nullif(sha1, '')").alias("sha1"))
        .alias("hashes"),
        F.when(F.size(notes) > 0,
               F.concat(F.lit("Incomplete ("), F.array_join(notes, ", "), F.lit(")")))
        .alias("transfer_status"),
    )


class FilesCollector:
    name = "files"

    def prepare(self, rows: DataFrame) -> DataFrame:
        return rows

    def groups(self, rows: DataFrame) -> DataFrame:
        """Files of a session with equal reasons; at most one group per reason set."""
        direction = F.when(F.col("is_orig"), UPLOAD).otherwise(DOWNLOAD)
        grouped = rows.withColumn("mask", file_mask()).groupBy("uid", "mask").agg(
            F.count("*").alias("count"),
            F.sum(F.coalesce("seen_bytes", F.lit(0))).alias("total_size_bytes"),
            F.bit_or(direction).alias("ways"),
            F.min("ts_us").alias("first_seen"),
        )
        score = risk_score(F.col("mask"))
        return grouped.withColumn("score", score).withColumn("severity", severity(score))

    def example_names(self, rows: DataFrame) -> DataFrame:
        """The first five distinct names of each suspicious group, by arrival, then sorted."""
        names = (
            rows.withColumn("mask", file_mask())
            .where((F.col("mask") != 0) & (F.col("filename") != ""))
            .groupBy("uid", "mask", "filename").agg(F.min("ts_us").alias("first_seen"))
        )
        return (
            first_n(names, ["uid", "mask"], ["first_seen", "filename"], K.FILE_EXAMPLE_LIMIT)
            .groupBy("uid", "mask")
            .agg(F.array_sort(F.collect_list("filename")).alias("example_filenames"))
        )

    def totals(self, rows: DataFrame) -> DataFrame:
        suspicious = F.col("mask") != 0
        rank = severity_rank(F.col("severity"))
        evasive = has_bit(F.col("mask"), "MIME_MISMATCH") | has_bit(F.col("mask"), "HIGH_ENTROPY")
        return self.groups(rows).groupBy("uid").agg(
            F.sum("count").alias("total_files_analyzed"),
            F.sum(F.when(suspicious, F.col("count")).otherwise(0)).alias("suspicious_files_count"),
            F.count_if(suspicious).alias("suspicious_groups_count"),
            F.sum("total_size_bytes").alias("total_bytes"),
            severity_name(F.max(F.when(suspicious, rank).otherwise(0)))
            .alias("highest_threat_level"),
            F.bool_or(evasive).alias("evasion_techniques_detected"),
        )

    def summary(self, totals: DataFrame) -> DataFrame:
        n = F.col("suspicious_files_count")
        text = F.when(
            n > 0, F.format_string("Suspicious file activity detected (%d files)", n)
        ).otherwise("No suspicious file activity detected")
        return totals.select(
            "uid",
            F.struct(text.alias("session_risk_summary"), "highest_threat_level",
                     "evasion_techniques_detected").alias("analysis"),
            F.struct("total_files_analyzed", "suspicious_files_count", "suspicious_groups_count",
                     F.round(F.col("total_bytes") / 1024, 2).alias("total_bytes_transferred_kb"))
            .alias("statistics"),
            F.struct(F.lit(None).cast("string").alias("none")).alias("context"),
        )

    def evidence(self, rows: DataFrame, totals: DataFrame) -> DataFrame:
        groups = self.groups(rows).where(F.col("mask") != 0)
        found = groups.join(self.example_names(rows), ["uid", "mask"], "left")
        ways = F.col("ways")
        return evidence_rows(
            found, "files", "findings", position(F.col("first_seen"), F.col("mask")),
            item(
                type=F.lit("AggregatedFileFinding"), count=F.col("count"),
                reasons=file_reasons(F.col("mask")), severity=F.col("severity"),
                avg_risk_score=F.col("score"),
                directions=labels((ways.bitwiseAND(DOWNLOAD) != 0, "Download"),
                                  (ways.bitwiseAND(UPLOAD) != 0, "Upload")),
                total_size_bytes=F.col("total_size_bytes"),
                example_filenames=F.coalesce("example_filenames",
                                             F.array(F.lit(K.NO_FILENAMES))),
            ),
        )
