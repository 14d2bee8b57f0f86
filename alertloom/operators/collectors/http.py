"""HTTP sessions: request totals, suspicious content, file transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertloom import constants as K
from alertloom.functions.network import is_direct_ip_host
from alertloom.functions.text import (
    agent_properties, content_mask, file_extension, folded, has_reason, labels, mask_reasons,
    sentence, url_decoded,
)
from alertloom.operators.collectors.base import (
    LAST, evidence_rows, first_n, first_value, item, position,
)

URI, BODY = 1, 2
DIRECTIONS = {"upload": "orig", "download": "resp"}


def tag_content(rows: DataFrame) -> DataFrame:
    """Adds `uri_mask` and `body_mask`: the reasons found in the decoded URI and body.

    Whole texts are searched; after that only the beginning is kept, for the examples.
    """
    decoded = rows.withColumns({
        "_uri": folded(url_decoded(F.col("uri"))),
        "_body": folded(url_decoded(F.col("request_body"))),
    })
    return decoded.withColumns({
        "uri_mask": F.coalesce(content_mask("_uri", True), F.lit(0)),
        "body_mask": F.coalesce(content_mask("_body", False), F.lit(0)),
        "uri": F.substring("uri", 1, K.CONTENT_EXAMPLE_CHARS),
        "request_body": F.substring("request_body", 1, K.CONTENT_EXAMPLE_CHARS),
    }).drop("_uri", "_body")


def content_hits(tagged: DataFrame) -> DataFrame:
    """One row per URI or body with reasons: uid, mask, source bit, arrival, example text."""
    def part(mask: str, source: int, text: str) -> Column:
        return F.struct(
            F.col(mask).alias("mask"), F.lit(source).alias("source"),
            F.col(text).alias("content"),
        )

    parts = F.array(part("uri_mask", URI, "uri"), part("body_mask", BODY, "request_body"))
    hits = tagged.select(
        "uid", "ts_us", "row_id",
        F.explode(F.filter(parts, lambda p: p["mask"] != 0)).alias("hit"),
    )
    # The URI of a row comes before its body.
    seen = F.col("ts_us") * 2 + F.col("hit.source") - 1
    return hits.select("uid", "row_id", seen.alias("seen"), "hit.*")


def content_groups(hits: DataFrame) -> DataFrame:
    """Hits of a session with equal reasons: their number, sources and first examples."""
    groups = hits.groupBy("uid", "mask").agg(
        F.count("*").alias("count"),
        F.bit_or("source").alias("sources"),
        F.min("seen").alias("first_seen"),
    )
    examples = (
        first_n(hits, ["uid", "mask"], ["seen", "row_id"], K.CONTENT_GROUP_LIMIT)
        .groupBy("uid", "mask")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "content"))).alias("ex"))
        .select("uid", "mask", F.col("ex.content").alias("examples"))
    )
    return groups.join(examples, ["uid", "mask"]).withColumn(
        "source",
        F.array_join(labels((F.col("sources").bitwiseAND(BODY) != 0, "BODY"),
                            (F.col("sources").bitwiseAND(URI) != 0, "URI")), "/"),
    )


def content_findings(groups: DataFrame) -> DataFrame:
    """Up to three findings of a group stand alone; more become one aggregated finding."""
    common = {"source": F.col("source"), "reasons": mask_reasons(F.col("mask"))}
    merged = item(type=F.lit("AggregatedContentFinding"), count=F.col("count"),
                  examples=F.col("examples"), **common)
    single = F.transform(
        "examples", lambda e: item(type=F.lit("ContentFinding"), content=e, **common)
    )
    found = groups.select(
        "uid", "mask", "first_seen",
        F.posexplode(
            F.when(F.col("count") > K.CONTENT_GROUP_LIMIT, F.array(merged)).otherwise(single)
        ).alias("n", "item"),
    )
    return evidence_rows(found, "http", "findings",
                         position(F.col("first_seen"), F.col("mask"), F.col("n")), F.col("item"))


def transferred(rows: DataFrame) -> DataFrame:
    """Distinct ids, names and types of transferred files: uid, direction, what, value.

    Names and types are paired with file ids by position; those beyond the ids are ignored.
    """
    def per_direction(direction: str, prefix: str) -> Column:
        ids = F.col(f"{prefix}_fuids")

        def values(what: str, array: Column) -> Column:
            return F.transform(
                F.slice(array, F.lit(1), F.greatest(F.size(ids), F.lit(0))),
                lambda v: F.struct(F.lit(direction).alias("direction"),
                                   F.lit(what).alias("what"), v.alias("value")),
            )

        found = [values("fuid", ids), values("name", F.col(f"{prefix}_filenames")),
                 values("mime", F.col(f"{prefix}_mime_types"))]
        return F.flatten(F.array_compact(F.array(*found)))

    entries = F.concat(*[per_direction(d, p) for d, p in DIRECTIONS.items()])
    return (
        rows.select("uid", F.explode(entries).alias("e")).select("uid", "e.*")
        .where((F.col("value") != "") | (F.col("what") == "fuid"))
        .distinct()
    )


def transfers(rows: DataFrame) -> DataFrame:
    """One row per session and direction: number of files, first names, all types.

    The type list is bounded by the sensor's list of known types.
    """
    found = transferred(rows)
    totals = found.where(F.col("what") != "name").groupBy("uid", "direction").agg(
        F.count_if(F.col("what") == "fuid").alias("count"),
        F.array_sort(F.collect_set(F.when(F.col("what") == "mime", F.col("value"))))
        .alias("mime_types"),
    )
    names = (
        first_n(found.where(F.col("what") == "name"), ["uid", "direction"], ["value"],
                K.CONTENT_GROUP_LIMIT)
        .groupBy("uid", "direction")
        .agg(F.array_sort(F.collect_list("value")).alias("filenames"))
    )
    return totals.join(names, ["uid", "direction"], "left").withColumn(
        "filenames", F.coalesce("filenames", F.array(F.lit(K.NO_FILENAMES)))
    )


def risky_files(prefix: str) -> Column:
    """Whether a row transfers a file with a risky extension or type in one direction."""
    ids = F.col(f"{prefix}_fuids")

    def paired(name: str) -> Column:
        return F.slice(F.col(f"{prefix}_{name}"), F.lit(1), F.greatest(F.size(ids), F.lit(0)))

    by_name = F.exists(
        paired("filenames"),
        lambda n: F.coalesce(file_extension(n).isin(K.HTTP_RISKY_EXTENSIONS), F.lit(False)),
    )
    by_type = F.exists(
        paired("mime_types"),
        lambda m: F.coalesce(m.isin(K.RISKY_MIME_TYPES), F.lit(False)),
    )
    return F.coalesce(by_name, F.lit(False)) | F.coalesce(by_type, F.lit(False))


class HttpCollector:
    name = "http"

    def prepare(self, rows: DataFrame) -> DataFrame:
        return tag_content(rows)

    def totals(self, rows: DataFrame) -> DataFrame:
        """Counts and byte sums, first agent, first direct-IP host, all reasons of a session."""
        moved = transfers(rows).groupBy("uid").agg(
            *[F.max(F.when(F.col("direction") == d, F.col("count"))).alias(f"n_{d}")
              for d in DIRECTIONS]
        )
        host = F.when(is_direct_ip_host(F.col("host")), F.col("host"))
        counted = rows.groupBy("uid").agg(
            F.count("*").alias("total_requests"),
            F.sum(F.coalesce("request_body_len", F.lit(0))).alias("request_bytes"),
            F.sum(F.coalesce("response_body_len", F.lit(0))).alias("response_bytes"),
            F.count_if(F.col("status_code").between(400, 499)).alias("client_errors"),
            first_value(F.col("user_agent")).alias("user_agent"),
            first_value(host).alias("direct_host"),
            F.bit_or(F.col("uri_mask").bitwiseOR(F.col("body_mask"))).alias("mask"),
            F.bool_or(risky_files("orig")).alias("risky_upload"),
            F.bool_or(risky_files("resp")).alias("risky_download"),
        )

        return counted.join(moved, "uid", "left")

    def summary(self, totals: DataFrame) -> DataFrame:
        agents = agent_properties(F.coalesce("user_agent", F.lit("")))
        s = totals.withColumn("agents", agents)
        mask = F.col("mask")
        threats = labels(
            (F.array_contains("agents", "Anomalous Pattern"), "an anomalous user agent"),
            (F.col("risky_upload"), "suspicious file uploads"),
            (has_reason(mask, "Classic SQLi", "Time-based Blind"), "SQL Injection patterns"),
            (has_reason(mask, "Script Tag", "HTML Event Handler"),
             "Cross-Site Scripting (XSS) patterns"),
        )
        anomalies = labels(
            (F.col("risky_download"), "suspicious file downloads"),
            (F.col("direct_host").isNotNull(), "a direct-to-IP connection"),
            (F.array_contains("agents", "Scripting/Tool Signature"), "a scripting tool user agent"),
            (has_reason(mask, K.TRAVERSAL_REASON), "directory traversal attempts"),
        )
        assessment = (
            F.when(F.size(threats) > 0,
                   sentence("High Confidence Threat: Session contains indicators of ", threats))
            .when(F.size(anomalies) > 0,
                  sentence("Suspicious Anomaly: Session involves ", anomalies))
            .otherwise("Benign: No significant threat indicators found.")
        )
        patterns = mask_reasons(mask)

        def moved_text(direction: str) -> Column:
            n = F.col(f"n_{direction}")
            risk = F.when(F.col(f"risky_{direction}"), "Suspicious").otherwise("Benign")
            return F.when(n > 0, F.format_string("%d files (%s)", n, risk)).otherwise("None")

        return s.select(
            "uid",
            F.struct(
                assessment.alias("overall_assessment"),
                F.col("agents").alias("observed_user_agent_properties"),
                F.when(F.col("direct_host").isNotNull(),
                       F.format_string("Direct-to-IP (%s)", "direct_host"))
                .otherwise("Domain Name").alias("observed_destination"),
                F.when(F.size(patterns) > 0, patterns).otherwise(F.array(F.lit("None")))
                .alias("observed_content_patterns"),
                F.struct(moved_text("upload").alias("uploads"),
                         moved_text("download").alias("downloads"))
                .alias("observed_file_transfers"),
            ).alias("analysis"),
            F.struct(
                "total_requests", "request_bytes", "response_bytes",
                F.round(F.col("client_errors") / F.col("total_requests"), 2)
                .alias("client_error_ratio"),
            ).alias("statistics"),
            F.struct(F.col("user_agent").alias("user_agent_string")).alias("context"),
        )

    def evidence(self, rows: DataFrame, totals: DataFrame) -> DataFrame:
        found = content_findings(content_groups(content_hits(rows)))
        files = evidence_rows(
            transfers(rows), "http", "findings",
            position(LAST, F.when(F.col("direction") == "upload", 0).otherwise(1)),
            item(type=F.lit("AggregatedFileTransfer"), direction=F.col("direction"),
                 count=F.col("count"), filenames=F.col("filenames"),
                 mime_types=F.col("mime_types")),
        )
        methods = evidence_rows(
            rows.where(F.col("method").isNotNull()).select("uid", "method").distinct(),
            "http", "methods_used", position(), item(value=F.col("method")),
        )
        return found.unionByName(files).unionByName(methods)
