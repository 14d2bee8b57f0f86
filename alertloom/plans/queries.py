"""The registered queries: every operator on whole given tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertloom import constants as K
from alertloom.functions import network, text
from alertloom.operators import (
    documents as D, groundtruth as G, ingest as I, match as M, serving as S, verdicts as V,
)
from alertloom.operators.collectors import conn as conn_c, dns, files, http, ssl
from alertloom.operators.numbering import number_rows
from alertloom.operators.readback import document_levels, evidence_rows
from alertloom.operators.suffixes import with_domain_parts
from alertloom.operators.timefiles import covering_file
from alertloom.plans.answers import answer_alerts
from alertloom.plans.enrich import (
    alert_levels, band_folders, enrich, pruned_conn, scoped_logs,
)
from alertloom.plans.views import SUFFIX_HOSTS, SUFFIX_RULES, table, timed_view, view
from alertloom.session import new_table_dir, stage
from alertloom.sources import flows as flow_source, logs as log_source
from alertloom.sources.alerts import (
    alert_hash, alerts_of_day, flatten_alerts, path_value, read_alerts_json, read_analyses,
)
from alertloom.sources.discovery import sync_lines
from alertloom.sources.logs import write_log_table
from alertloom.sources.refdata import read_rules, reputation_table, suffix_rules, weak_settings
from alertloom.sources.sinks import local_day, write_csv, write_documents, write_json
from alertloom.streaming.connect import start_connect
from alertloom.streaming.enrich import start_enrich
from alertloom.streaming.forward import start_forward
from alertloom.streaming.ingest import alert_lines, start_dedup, start_ingest, start_intake

FILE_RULES = {
    "HIGH": [{"collector": "ssl", "path": "analysis.handshake_status", "check": "equals", "value": "Failed"},
             {"collector": "files", "path": "statistics.suspicious_files_count", "check": "gte", "value": 1}],
    "LOW": [{"collector": "files", "path": "statistics.suspicious_files_count", "check": "gte", "value": 1},
            {"collector": "dns", "path": "analysis.observed_ttl_behavior", "check": "startswith", "value": "Low"}],
}
TEMPLATE = "Judge this alert:\n{{ENRICHED_PROMPT}}\n"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(array: str | Column, sep: str = ",") -> Column:
    return F.array_join(array, sep)


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return table(spark, sf_dir, "pages").select(host.alias("host")).distinct()


def protocol_logs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: view(spark, sf_dir, f"v_{n}") for n in ("http", "dns", "ssl", "files")}


def timed_logs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: timed_view(spark, sf_dir, f"v_{n}") for n in ("http", "dns", "ssl", "files")}


# --- ingestion --------------------------------------------------------------------------------

@query
def alert_filter(spark, sf_dir):
    return I.select_alerts(
        view(spark, sf_dir, "v_alerts"),
        start=F.lit("2024-01-05").cast("timestamp"), end=F.lit("2024-01-20").cast("timestamp"),
    ).select("alert_id", "timestamp", "rule_name", "rule_severity", "event_severity").orderBy(
        "timestamp", "alert_id"
    )


@query
def alert_dedup_hash(spark, sf_dir):
    alerts = view(spark, sf_dir, "v_alerts")
    look_back = alerts.withColumn("source_port", F.concat("source_port", F.lit(".0")))
    return I.deduplicate(alerts.unionByName(look_back)).select(
        "alert_hash", "alert_id", "timestamp"
    )


@query
def alert_anti_log(spark, sf_dir):
    alerts = view(spark, sf_dir, "v_alerts")
    log = alerts.where(F.col("event_module") == "other").withColumn("alert_hash", alert_hash())
    return I.new_alerts(alerts, alerts, log).select("alert_hash", "alert_id")


@query
def alert_day_counts(spark, sf_dir):
    return view(spark, sf_dir, "v_alerts").groupBy(
        local_day(F.col("timestamp")).cast("string").alias("local_day")
    ).agg(F.count("*").alias("n"))


@query
def alert_index(spark, sf_dir):
    return number_rows(
        view(spark, sf_dir, "v_alerts").select("alert_id", "timestamp"),
        [F.col("timestamp"), F.col("alert_id")], start=1, name="alert_index",
    )


@query
def alert_array_backfill(spark, sf_dir):
    """One day's alerts, read from files that hold an array of nested alerts each."""
    path = new_table_dir(spark, "arrays")
    side = lambda end: F.struct(F.col(f"{end}_ip").alias("ip"), F.col(f"{end}_port").alias("port"))
    nested = F.struct(F.col("timestamp").alias("@timestamp"), side("source").alias("source"),
                      side("dest").alias("destination"), F.struct(F.col("rule_name").alias("name")).alias("rule"))
    # Arrays of some hundred neighbouring alerts, a file each.
    arrays = view(spark, sf_dir, "v_alerts").groupBy(F.floor(F.col("alert_id") / 2000)).agg(
        F.to_json(F.collect_list(nested)).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    flat = flatten_alerts(read_alerts_json(spark, path, array_file=True))
    return alerts_of_day(flat, "2024-01-10", K.LOCAL_TIME_ZONE).select("alert_id", "timestamp", "source_port")


@query
def alert_path_values(spark, sf_dir):
    """Values of dotted paths: a flat column first, then the nested field, then the default."""
    alerts = view(spark, sf_dir, "v_alerts")
    nested = alerts.select(
        "alert_id", F.struct(F.col("rule_name").alias("name"), F.col("rule_category").alias("category")).alias("rule"),
        F.when(F.col("alert_id") % 3 == 0, "flat").alias("rule.name"))
    return nested.select("alert_id", *[path_value(nested, path).alias(path.replace(".", "_")) for path in (
        "rule.name", "rule.category", "rule.severity")])


# --- matching ---------------------------------------------------------------------------------

@query
def alert_conn_match(spark, sf_dir):
    return M.match_by_community(
        view(spark, sf_dir, "v_alerts"), view(spark, sf_dir, "v_conn")
    ).select("alert_id", "uid", F.col("conn.row_id").alias("conn_row"))


@query
def alert_conn_fallback(spark, sf_dir):
    alerts, conn = view(spark, sf_dir, "v_alerts"), view(spark, sf_dir, "v_conn")
    return M.match_by_tuple(alerts, conn).select(
        "alert_id", "uid", F.col("conn.row_id").alias("conn_row")
    )


@query
def alert_match_all(spark, sf_dir):
    alerts = view(spark, sf_dir, "v_alerts")
    matched = M.match_alerts(alerts, view(spark, sf_dir, "v_conn"))
    return alerts.select("alert_id").join(matched, "alert_id", "left").select(
        "alert_id", "uid", "matched_by", F.col("conn.row_id").alias("conn_row")
    )


@query
def session_fan_out(spark, sf_dir):
    """Rows per log of the sessions that some alert belongs to."""
    matched = M.match_alerts(view(spark, sf_dir, "v_alerts"), view(spark, sf_dir, "v_conn"))
    uids = stage(matched.select("uid").distinct(), "uids")
    parts = [
        M.session_rows(rows, uids).select("uid", F.lit(name).alias("log"))
        for name, rows in protocol_logs(spark, sf_dir).items()
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("uid", "log").agg(F.count("*").alias("n"))


@query
def alert_repeat_match(spark, sf_dir):
    """Alerts of which some come three times: each copy has its one connection."""
    alerts = view(spark, sf_dir, "v_alerts")
    copies = alerts.where(F.col("alert_id") % 3 == 0)
    rows = M.with_row_key(alerts.unionByName(copies).unionByName(copies))
    matched = M.match_alerts(rows, view(spark, sf_dir, "v_conn"), id_col="alert_row")
    return rows.select("alert_row", "alert_id").join(matched, "alert_row", "left").select(
        "alert_id", "uid", "matched_by", F.col("conn.row_id").alias("conn_row")
    )


@query
def session_scan_pruned(spark, sf_dir):
    """Rows of each log within the hours of its alerts, from tables with day folders."""
    alerts = stage(view(spark, sf_dir, "v_alerts"), "alerts")
    rows = {"conn": view(spark, sf_dir, "v_conn"), **timed_logs(spark, sf_dir)}
    logs = {}
    for name, log in rows.items():
        path = new_table_dir(spark, f"{name}_log")
        write_log_table(log, path, by=("dt",))
        logs[name] = log_source.read_log_table(spark, path)
    conn = log_source.in_folders(logs["conn"], band_folders(alerts))
    matched = stage(M.match_alerts(alerts, conn), "matched")
    _, scoped = scoped_logs(alerts, matched, logs)
    parts = [log.select("uid", F.lit(name).alias("log")) for name, log in scoped.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("uid", "log").agg(F.count("*").alias("n"))


@query
def time_bucket_scan(spark, sf_dir):
    """The archive file, of six hours each, that covers every alert."""
    ts = F.col("ts").cast("timestamp")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", ts.alias("ts"))
    day = F.to_date("ts").cast("string")
    quarter = F.floor(F.hour("ts") / 6).cast("int")
    spans = events.select(day.alias("day"), quarter.alias("q")).distinct().select(
        "day", (F.col("q") * 21600).alias("start_s"), ((F.col("q") + 1) * 21600).alias("end_s"),
        F.concat_ws("/", "day", F.concat(F.lit("conn."), F.col("q").cast("string"))).alias("path"),
    )
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    points = events.where(F.col("event_type") == "error").select(
        F.col("event_id").alias("alert_id"), day.alias("day"), second.alias("second")
    )
    return covering_file(points, spans, ["alert_id"])


@query
def log_table_scan(spark, sf_dir):
    """Connections around the alerts, read back from a table with day folders."""
    path = new_table_dir(spark, "conn_log")
    write_log_table(view(spark, sf_dir, "v_conn"), path, by=("dt",))
    alerts = view(spark, sf_dir, "v_alerts").where(
        F.col("timestamp").between("2024-01-10 00:00:00", "2024-01-12 23:59:59")
    )
    rows = pruned_conn(alerts, log_source.read_log_table(spark, path))
    return rows.select("row_id", "uid", "ts_us")


@query
def log_json_scan(spark, sf_dir):
    """Connections written as gzip JSON lines and read with the log schema."""
    path = new_table_dir(spark, "conn_json")
    raw = view(spark, sf_dir, "v_conn").withColumn("ts", F.col("ts_us") / 1_000_000)
    raw.withColumnsRenamed(
        {"orig_h": "id.orig_h", "orig_p": "id.orig_p", "resp_h": "id.resp_h",
         "resp_p": "id.resp_p"}
    ).drop("row_id", "ts_us").write.option("compression", "gzip").json(path)
    archive = log_source.read_log(spark, "conn", path)
    # The current log repeats rows of the archive.
    hot = archive.where(F.col("service") == "http")
    return log_source.with_hot(archive, hot).groupBy("uid", "orig_h", "conn_state").agg(
        F.count("*").alias("n"), F.sum("orig_bytes").alias("orig_bytes")
    )


@query
def flow_csv_scan(spark, sf_dir):
    """Flows written and read back as CSV with padded headers."""
    path = new_table_dir(spark, "flows_csv")
    flows = view(spark, sf_dir, "v_flows")
    write_csv(flows.select(*[
        F.col(c).alias(f" {name}") for name, c in flow_source.FLOW_COLUMNS.items()
    ]), path)
    return flow_source.read_flows(spark, path).groupBy("original_label", "protocol").agg(
        F.count("*").alias("n"), F.sum("source_port").alias("ports")
    )


@query
def log_discovery(spark, sf_dir):
    """Lines taken from day files that appear, grow, and in part are replaced by shorter ones."""
    root = new_table_dir(spark, "discovery")
    lines = view(spark, sf_dir, "v_conn").select(
        F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd").alias("day"),
        F.hour(F.timestamp_micros("ts_us")).alias("hour"), "ts_us", "row_id",
        F.to_json(F.struct("row_id", "uid", "orig_h")).alias("value"))
    replaced = F.col("day").substr(10, 1) == "7"
    states = (F.col("hour") < 12, F.lit(True), ~replaced | (F.col("hour") >= 18))
    for i, held in enumerate(states):
        # One file a day, under one name, as a log that is still written has it.
        lines.where(held).repartition("day").sortWithinPartitions("day", "ts_us", "row_id").select(
            "day", "value").write.partitionBy("day").text(f"{root}/state{i}")
        place_files(spark, f"{root}/state{i}", f"{root}/logs", "conn.log")
        sync_lines(spark, f"{root}/logs", "*.log", f"{root}/manifest", f"{root}/lines")
    taken = spark.read.parquet(f"{root}/lines")
    return taken.groupBy("run", F.regexp_extract("path", r"day=([0-9-]+)/", 1).alias("day")).agg(
        F.count("*").alias("n"), F.sum(F.get_json_object("value", "$.row_id").cast("long")).alias("row_ids"))


def place_files(spark: SparkSession, source: str, target: str, name: str) -> None:
    """Move the one file of each folder below `source` to the same folder of `target`, under one name."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(path(source)):
        if folder.isDirectory():
            written = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            there = path(f"{target}/{folder.getPath().getName()}", name)
            fs.mkdirs(there.getParent())
            fs.delete(there, False)
            fs.rename(written[0], there)


# --- connections --------------------------------------------------------------------------------

@query
def conn_summary(spark, sf_dir):
    rows = view(spark, sf_dir, "v_conn")
    c = F.struct(*rows.columns)
    return rows.select("row_id", conn_c.connection_block(c).alias("b")).select(
        "row_id", "b.identity.source_ip", "b.identity.source_port", "b.identity.traffic_direction",
        "b.identity.service", "b.statistics.duration_seconds", "b.analysis.overall_assessment",
        "b.analysis.connection_state_desc", "b.analysis.flow_ratio.upload_bytes",
        "b.analysis.flow_ratio.download_bytes", "b.analysis.flow_ratio.ratio",
    )


@query
def ip_privacy(spark, sf_dir):
    rows = view(spark, sf_dir, "v_conn")
    both = rows.select(F.col("orig_h").alias("ip")).unionByName(
        rows.select(F.col("resp_h").alias("ip"))
    )
    return both.groupBy("ip").agg(F.count("*").alias("n")).select(
        "ip", "n", network.is_private_ip(F.col("ip")).alias("is_private")
    )


# --- http ---------------------------------------------------------------------------------------

@query
def http_session_stats(spark, sf_dir):
    collector = http.HttpCollector()
    rows = collector.prepare(view(spark, sf_dir, "v_http"))
    totals = collector.totals(rows)
    methods = collector.evidence(rows, totals).where(F.col("kind") == "methods_used")
    # Few distinct methods exist, so their list per session stays short.
    named = methods.groupBy("uid").agg(
        joined(F.array_sort(F.collect_list("item.value"))).alias("methods")
    )
    return totals.join(named, "uid", "left").select(
        "uid", "total_requests", "request_bytes", "response_bytes", "client_errors",
        "user_agent", "direct_host", "methods",
    )


@query
def http_content_reasons(spark, sf_dir):
    tagged = http.tag_content(view(spark, sf_dir, "v_http"))
    return tagged.select(
        "row_id", joined(text.mask_reasons(F.col("uri_mask"))).alias("uri_reasons"),
        joined(text.mask_reasons(F.col("body_mask"))).alias("body_reasons"),
    )


@query
def document_content_reasons(spark, sf_dir):
    body = table(spark, sf_dir, "documents").withColumn(
        "_low", F.lower("text")
    ).withColumn("_body", text.folded(F.col("_low")))
    mask = text.content_mask("_body", False)
    return body.withColumn("mask", mask).select(
        "doc_id", joined(text.mask_reasons(F.col("mask"))).alias("reasons")
    )


@query
def http_findings_grouped(spark, sf_dir):
    tagged = stage(http.tag_content(view(spark, sf_dir, "v_http")), "tagged")
    hits = http.content_hits(tagged)
    return http.content_groups(hits).select(
        "uid", joined(text.mask_reasons(F.col("mask"))).alias("reasons"), "count", "source",
        joined("examples", " | ").alias("examples"),
    )


@query
def http_file_transfers(spark, sf_dir):
    return http.transfers(view(spark, sf_dir, "v_http")).select(
        "uid", "direction", "count", joined("filenames").alias("filenames"),
        joined("mime_types").alias("mime_types"),
    )


@query
def http_assessment(spark, sf_dir):
    collector = http.HttpCollector()
    rows = collector.prepare(view(spark, sf_dir, "v_http"))
    s = D.classified(collector, collector.totals(rows))
    a = F.col("analysis")
    return s.select(
        "uid", a["overall_assessment"].alias("overall_assessment"),
        joined(a["observed_user_agent_properties"]).alias("agents"),
        a["observed_destination"].alias("destination"),
        joined(a["observed_content_patterns"]).alias("patterns"),
        a["observed_file_transfers"]["uploads"].alias("uploads"),
        a["observed_file_transfers"]["downloads"].alias("downloads"),
        "level",
    )


@query
def user_agent_classes(spark, sf_dir):
    return view(spark, sf_dir, "v_http").groupBy("user_agent").agg(
        F.count("*").alias("n")
    ).select(
        "user_agent", "n",
        joined(text.agent_properties(F.coalesce("user_agent", F.lit("")))).alias("properties"),
    )


# --- dns ----------------------------------------------------------------------------------------

@query
def dns_session_stats(spark, sf_dir):
    return dns.DnsCollector().totals(view(spark, sf_dir, "v_dns")).select(
        "uid", "total_queries", "distinct_queries", "distinct_answers", "failed_queries",
        "last_failure", "source_ip", "dns_server", F.col("low_ttl._low").alias("low_ttl"),
        "suspicious_tld", "dga", "repetitive", "high_failure", "is_reported",
    )


@query
def dns_findings(spark, sf_dir):
    rows, collector = view(spark, sf_dir, "v_dns"), dns.DnsCollector()
    found = collector.evidence(rows, stage(collector.totals(rows), "dns"))
    return found.groupBy(
        "uid", "item.type", "item.source", "item.content",
        F.element_at("item.reasons", 1).alias("reason"),
    ).agg(F.count("*").alias("n"))


@query
def dns_assessment(spark, sf_dir):
    collector = dns.DnsCollector()
    s = D.classified(collector, collector.totals(view(spark, sf_dir, "v_dns")))
    return s.select("uid", "analysis.*", "level")


@query
def dns_entropy(spark, sf_dir):
    parts = network.domain_parts(F.col("host"))
    return page_hosts(spark, sf_dir).select(
        "host", F.round(text.shannon_entropy(F.col("host")), 6).alias("entropy"),
        F.round(text.shannon_entropy(parts["subdomain"]), 6).alias("subdomain_entropy"),
    )


@query
def domain_split(spark, sf_dir):
    hosts = page_hosts(spark, sf_dir).unionByName(
        view(spark, sf_dir, "v_dns").select(F.col("query").alias("host")).where("host <> ''")
    ).distinct()
    return hosts.select("host", network.domain_parts(F.col("host")).alias("p")).select(
        "host", "p.subdomain", "p.domain", "p.suffix"
    )


@query
def domain_suffix_split(spark, sf_dir):
    """Host names of customers, split by a table of rules with wildcards and exceptions."""
    rules = spark.sql(SUFFIX_RULES, nation=table(spark, sf_dir, "nation"))
    hosts = spark.sql(SUFFIX_HOSTS, nation=table(spark, sf_dir, "nation"),
                      customer=table(spark, sf_dir, "customer"))
    return with_domain_parts(hosts, "host", rules).select(
        "host", "parts.subdomain", "parts.domain", "parts.suffix")


# --- tls ----------------------------------------------------------------------------------------

@query
def ssl_session(spark, sf_dir):
    return ssl.SslCollector().totals(view(spark, sf_dir, "v_ssl")).select(
        "uid", "established", F.round("duration", 2).alias("duration"),
        F.col("Self-Signed Certificate").alias("self_signed"),
        F.col("Untrusted Chain").alias("untrusted"), F.col("Expired Certificate").alias("expired"),
        joined("weak_protocols").alias("weak_protocols"),
        joined("weak_ciphers").alias("weak_ciphers"),
        F.col("ja3_details_threat").alias("ja3_threat"),
        F.col("ja3s_details_threat").alias("ja3s_threat"),
    )


@query
def ssl_values(spark, sf_dir):
    return ssl.SslCollector().values(view(spark, sf_dir, "v_ssl"))


@query
def ssl_intel_join(spark, sf_dir):
    """Fingerprints looked up in intelligence tables instead of the built-in maps."""
    from alertloom.sources.refdata import ja3_intel, ja3s_intel

    intel = {"ja3_details": ja3_intel(spark), "ja3s_details": ja3s_intel(spark)}
    seen = ssl.SslCollector(intel).values(view(spark, sf_dir, "v_ssl"))
    return seen.where(F.col("threat_name").isNotNull()).select("uid", "kind", "value",
                                                               "threat_name")


@query
def ssl_assessment(spark, sf_dir):
    collector = ssl.SslCollector()
    s = D.classified(collector, collector.totals(view(spark, sf_dir, "v_ssl")))
    a = F.col("analysis")
    return s.select(
        "uid", a["overall_assessment"].alias("overall_assessment"),
        joined(a["observed_certificate_issues"]).alias("issues"),
        a["handshake_status"].alias("handshake_status"), "level",
    )


@query
def sni_reputation(spark, sf_dir):
    names = view(spark, sf_dir, "v_ssl").select(F.col("server_name").alias("host"))
    return names.unionByName(page_hosts(spark, sf_dir)).groupBy("host").agg(
        F.count("*").alias("n")
    ).select("host", "n", network.sni_reputation(F.col("host")).alias("reputation"))


@query
def ssl_weak_join(spark, sf_dir):
    """Weak protocols and ciphers of each session, by a table."""
    return ssl.weak_by_table(view(spark, sf_dir, "v_ssl"), weak_settings(spark))


@query
def sni_reputation_join(spark, sf_dir):
    """The reputation of server names by tables of domains, keywords and suffix rules."""
    names = view(spark, sf_dir, "v_ssl").select(F.col("server_name").alias("host"))
    seen = names.unionByName(page_hosts(spark, sf_dir)).groupBy("host").agg(F.count("*").alias("n"))
    told = ssl.reputation_by_table(seen.select("host"), reputation_table(spark), suffix_rules(spark))
    return seen.withColumnRenamed("host", "_host").join(told, F.col("_host").eqNullSafe(F.col("host"))).select(
        "host", "n", "reputation")


# --- files --------------------------------------------------------------------------------------

@query
def files_risk(spark, sf_dir):
    return files.file_findings(view(spark, sf_dir, "v_files")).select(
        "uid", "fuid", "direction", "severity", "risk_score", "size_bytes",
        joined("reasons").alias("reasons"), "file_type_reported", "entropy",
        F.col("hashes.md5").alias("md5"), "transfer_status",
    )


@query
def files_groups(spark, sf_dir):
    rows, collector = view(spark, sf_dir, "v_files"), files.FilesCollector()
    found = collector.evidence(rows, collector.totals(rows))
    return found.select(
        "uid", F.col("item.count").alias("count"), joined("item.reasons").alias("reasons"),
        "item.severity", "item.avg_risk_score", joined("item.directions").alias("directions"),
        "item.total_size_bytes", joined("item.example_filenames").alias("examples"),
    )


@query
def files_rollup(spark, sf_dir):
    collector = files.FilesCollector()
    s = D.classified(collector, collector.totals(view(spark, sf_dir, "v_files")))
    return s.select("uid", "analysis.*", "statistics.total_files_analyzed",
                    "statistics.suspicious_files_count", "statistics.suspicious_groups_count",
                    "statistics.total_bytes_transferred_kb", "level")


# --- documents and verdicts -----------------------------------------------------------------------

def all_documents(spark, sf_dir):
    return enrich(
        view(spark, sf_dir, "v_alerts"), view(spark, sf_dir, "v_conn"),
        timed_logs(spark, sf_dir), id_col="alert_id",
    )


@query
def triage_documents(spark, sf_dir):
    return all_documents(spark, sf_dir)


@query
def document_facts(spark, sf_dir):
    """Values read back out of the JSON documents."""
    doc = F.col("parsed")

    def at(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(doc, f"$.{path}", kind)

    def levels(collector: str) -> Column:
        return F.concat_ws(",", *[
            F.when(at(f"evidence.{lv}.{collector}", "variant").isNotNull(), lv) for lv in D.LEVELS
        ])

    def anywhere(path: str) -> Column:
        return F.coalesce(*[at(f"evidence.{lv}.{path}", "long") for lv in D.LEVELS])

    # A document is parsed once for all paths.
    docs = all_documents(spark, sf_dir).select("alert_id", F.try_parse_json("document").alias("parsed"))
    return docs.select(
        "alert_id", at("alert.signature").alias("signature"),
        at("alert.category").alias("category"),
        at("connection.identity.traffic_direction").alias("direction"),
        *[levels(c).alias(f"{c}_levels") for c in ("http", "dns", "ssl", "files")],
        anywhere("http.statistics.total_requests").alias("http_requests"),
        anywhere("dns.statistics.total_queries").alias("dns_queries"),
        anywhere("files.statistics.total_files_analyzed").alias("n_files"),
    )


def all_levels(spark, sf_dir, rules=K.SEVERITY_RULES):
    return alert_levels(
        view(spark, sf_dir, "v_alerts"), view(spark, sf_dir, "v_conn"),
        timed_logs(spark, sf_dir), rules=rules, id_col="alert_id",
    )


@query
def evidence_levels(spark, sf_dir):
    return all_levels(spark, sf_dir).select(
        "alert_id", "has_connection", "has_evidence", "http_level", "dns_level", "ssl_level",
        "files_level",
    )


@query
def evidence_levels_by_file(spark, sf_dir):
    """Levels by rules that come from a JSON file."""
    path = new_table_dir(spark, "rules")
    spark.createDataFrame([(json.dumps(FILE_RULES),)], "value string").write.text(path)
    return all_levels(spark, sf_dir, read_rules(spark, path)).select("alert_id", "http_level", "dns_level", "ssl_level", "files_level")


@query
def auto_fp_routing(spark, sf_dir):
    docs = all_levels(spark, sf_dir)
    verdict = V.default_verdict(F.col("rule_name"))
    return docs.select(
        "alert_id",
        F.when(V.lacks_evidence(), verdict["result"]["conclusion"]["classification"])
        .alias("classification"),
        F.when(V.lacks_evidence(), verdict["result"]["reasoning"]["analyze_alert"])
        .alias("analyze_alert"),
        (~V.lacks_evidence()).alias("needs_inference"),
    )


@query
def inference_requests(spark, sf_dir):
    requests = V.request_rows(all_documents(spark, sf_dir), "default", "You are an analyst.",
                              TEMPLATE)
    parsed = requests.select("alert_id", F.try_parse_json("request").alias("body"))

    def at(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("body", f"$.{path}", kind)

    return parsed.select(
        "alert_id", at("model").alias("model"), at("max_tokens", "int").alias("max_tokens"),
        at("messages[1].role").alias("role"),
        at("messages[1].content").contains('"signature"').alias("has_document"),
    )


def rule_of_thumb(batches):
    """A classifier without a model: by the number in the request's document, and silent for some."""
    for batch in batches:
        number = batch["request"].str.extract(r"RULE (\d)")[0].astype(int)
        verdict = number.map(lambda n: "True Positive" if n % 2 else "False Positive")
        answer = '```json\n{"result": {"conclusion": {"classification": "' + verdict + '"}}}\n```'
        yield batch.drop(columns="request").assign(
            response=answer.mask(number == 3, "I cannot say.").mask(number == 5, '{"result": {}}'))


@query
def analysis_chain(spark, sf_dir):
    """Numbered alerts to documents, answers and records, written in two runs of one name."""
    root = new_table_dir(spark, "answers")
    alerts = stage(number_rows(view(spark, sf_dir, "v_alerts"), [F.col("timestamp"), F.col("alert_id")],
                               start=1, name="alert_index"), "numbered")
    docs = stage(enrich(alerts, view(spark, sf_dir, "v_conn"), timed_logs(spark, sf_dir),
                        id_col="alert_index"), "documents")
    for _ in range(2):  # the rerun replaces the records of the first
        answer_alerts(docs, rule_of_thumb, "You are an analyst.", TEMPLATE, f"{root}/analyses",
                      f"{root}/quarantine", run="1")
    conclusion = F.col("llm_analysis.result.conclusion")
    records = read_analyses(spark, f"{root}/analyses").select(
        "alert_index", F.lit("record").alias("kind"), conclusion["classification"].alias("content"),
        conclusion["confidence_score"].alias("confidence"),
        F.col("original_alert_signature").alias("signature"), F.col("enriched_prompt_file").alias("file"))
    refused = spark.read.schema("alert_index long, response string").json(f"{root}/quarantine").select(
        "alert_index", F.lit("refused").alias("kind"), F.col("response").alias("content"))
    return records.unionByName(refused, allowMissingColumns=True)


@query
def document_evidence(spark, sf_dir):
    """The entries of all evidence lists, read back from documents written as files."""
    path = new_table_dir(spark, "documents")
    write_documents(all_documents(spark, sf_dir).select(
        "timestamp", F.to_json(F.struct("alert_id", "document")).alias("document")), path)
    lines = spark.read.text(path).select(F.from_json("value", "alert_id long, document string").alias("d")).select("d.*")
    return evidence_rows(lines).groupBy("alert_id", "collector", "kind", "value").agg(F.count("*").alias("n"))


@query
def document_levels_read(spark, sf_dir):
    """Severity levels decided anew from the documents, as published."""
    return document_levels(all_documents(spark, sf_dir))


@query
def response_parse(spark, sf_dir):
    from alertloom.functions.jsontext import response_object

    found = F.to_json(response_object(F.col("response")))
    return view(spark, sf_dir, "v_responses").select(
        "alert_id", F.get_json_object(found, "$.n").cast("int").alias("n"),
        F.get_json_object(found, "$.role").alias("role"), found.isNotNull().alias("is_readable"),
    )


# --- ground truth ---------------------------------------------------------------------------------

@query
def flow_labels(spark, sf_dir):
    return G.flow_labels(view(spark, sf_dir, "v_flows").dropna(subset=["dest_ip"]))


@query
def map_alert_labels(spark, sf_dir):
    flows = view(spark, sf_dir, "v_flows").dropna(subset=["dest_ip"])
    alerts = view(spark, sf_dir, "v_flow_alerts")
    return G.map_alerts(alerts, flows)


@query
def mapped_csv_scan(spark, sf_dir):
    """Mapped alerts handed on as CSV, read back, and handed on as JSON lines."""
    root = new_table_dir(spark, "mapped")
    write_csv(map_alert_labels(spark, sf_dir), f"{root}/csv")
    mapped = flow_source.read_mapped(spark, f"{root}/csv")
    write_json(mapped, f"{root}/json")
    return spark.read.schema(mapped.schema).json(f"{root}/json").groupBy("original_label", "transport").agg(
        F.count("*").alias("n"), F.sum("destination_port").alias("ports"))


@query
def quota_sample(spark, sf_dir):
    return G.with_class(G.quota_sample(view(spark, sf_dir, "v_mapped"), "row_key"))


@query
def label_counts(spark, sf_dir):
    return G.label_counts(view(spark, sf_dir, "v_mapped").withColumn(
        "original_label", F.trim("original_label")))


@query
def label_tp_fp(spark, sf_dir):
    labelled = G.with_class(view(spark, sf_dir, "v_mapped").withColumn(
        "original_label", F.trim("original_label")))
    return labelled.groupBy("classification_label").agg(F.count("*").alias("n"))


@query
def raw_alert_lookup(spark, sf_dir):
    alerts = view(spark, sf_dir, "v_flow_alerts")
    sample = alerts.where(F.col("source_ip") != "").select(
        F.when(F.col("alert_id") % 10 == 1, "1999-01-01").otherwise(F.col("timestamp"))
        .alias("timestamp"),
        F.col("rule_name").alias("alert_name"), "source_ip", F.col("alert_id").alias("row_key"),
    )
    found = G.raw_alert_lookup(sample, alerts, ["alert_id"])
    return found.select("row_key", F.col("raw_alert.alert_id").alias("raw_alert_id"))


@query
def raw_alert_counts(spark, sf_dir):
    alerts = view(spark, sf_dir, "v_flow_alerts")
    sample = alerts.select(
        F.when(F.col("alert_id") % 10 == 1, "1999-01-01").otherwise(F.col("timestamp"))
        .alias("timestamp"), F.col("rule_name").alias("alert_name"), "source_ip",
    )
    return G.lookup_counts(G.raw_alert_lookup(sample, alerts, ["alert_id"]))


# --- serving --------------------------------------------------------------------------------------

def served(spark, sf_dir) -> DataFrame:
    alerts = number_rows(view(spark, sf_dir, "v_alerts"),
                         [F.col("timestamp"), F.col("alert_id")], name="alert_index")
    analyses = view(spark, sf_dir, "v_analyses").select(
        "alert_index", F.col("processed").alias("processed_at"),
        F.struct(F.struct(F.struct(
            "classification", F.col("summary").alias("reasoning_summary")
        ).alias("conclusion")).alias("result")).alias("llm_analysis"),
    )
    return S.triage_view(alerts, analyses)


@query
def triage_view(spark, sf_dir):
    return served(spark, sf_dir).drop("llm_result_json")


@query
def triage_search(spark, sf_dir):
    return S.search(served(spark, sf_dir), "10.0.0.1", "True Positive").select(
        "unique_id", "source_ip", "dest_ip", "llm_verdict"
    )


@query
def triage_page(spark, sf_dir):
    found = S.search(served(spark, sf_dir), "rule 3")
    return S.page(found, 2).select("alert_index", "alert_name", "llm_verdict")


@query
def triage_deep_page(spark, sf_dir):
    """Two pages of one stored result, the first and one far behind it."""
    path = new_table_dir(spark, "result")
    S.store_result(served(spark, sf_dir), path)
    pages = [S.stored_page(spark, path, n).select(F.lit(n).alias("page"), "alert_index", "unique_id") for n in (1, 90)]
    return pages[0].unionByName(pages[1])


@query
def triage_details(spark, sf_dir):
    """The time as it is shown and the whole result, or that there is none yet."""
    return served(spark, sf_dir).select(
        "unique_id", S.display_time(F.col("timestamp")).alias("shown"), "llm_result_json")


@query
def triage_page_size(spark, sf_dir):
    return S.result_size(S.search(served(spark, sf_dir), "rule 3"))


# --- streams --------------------------------------------------------------------------------------

def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, in the shape of the alert view."""
    from alertloom.plans.views import SPARK, VIEWS

    _, where, columns = VIEWS["v_alerts"]
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(
        sf_dir
    )
    return rows.where(where).selectExpr(*[f"{e.format(**SPARK)} as `{a}`"
                                          for a, e in columns.items()])


def finish(running) -> None:
    running.awaitTermination()
    if running.exception():
        raise running.exception()


@query
def alert_ingest_stream(spark, sf_dir):
    """Alerts and look-back copies streamed into the day log, once each."""
    root = new_table_dir(spark, "ingest")
    alerts = I.select_alerts(event_stream(spark, sf_dir))
    look_back = alerts.withColumn("source_port", F.concat("source_port", F.lit(".0")))
    finish(start_ingest(alerts.unionByName(look_back), f"{root}/log", f"{root}/state", once=True))
    return spark.read.parquet(f"{root}/log").select(
        "alert_hash", "alert_id", F.col("local_day").cast("string").alias("local_day")
    )


@query
def alert_dedup_stream(spark, sf_dir):
    """Three runs of a stream that remembers: the second and third bring earlier alerts again."""
    root = new_table_dir(spark, "dedup")
    alerts = view(spark, sf_dir, "v_alerts").withColumn(
        "timestamp", F.when(F.col("alert_id") % 10 == 0, "unknown").otherwise(F.col("timestamp")))
    look_back = alerts.withColumn("source_port", F.concat("source_port", F.lit(".0")))
    for part in (alerts.where(F.col("alert_id") % 3 != 1), alerts, look_back):
        part.write.mode("append").parquet(f"{root}/in")
        arriving = spark.readStream.schema(alerts.schema).parquet(f"{root}/in")
        finish(start_dedup(arriving, f"{root}/log", f"{root}/state", once=True))
    return spark.read.parquet(f"{root}/log").select(
        "alert_hash", F.col("local_day").cast("string").alias("local_day"))


@query
def intake_quarantine_stream(spark, sf_dir):
    """Nested alerts as JSON lines in two runs, with times of several zones and cut lines."""
    root = new_table_dir(spark, "intake")
    alerts, number = view(spark, sf_dir, "v_alerts"), F.col("alert_id")
    at = F.timestamp_micros("event_us")
    pattern = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    zoned = F.when(number % 3 == 0, F.date_format(at, f"{pattern}'Z'")).when(
        number % 3 == 1, F.date_format(at, f"{pattern}'+0000'")).otherwise(
        F.date_format(at + F.expr("interval 7 hours"), f"{pattern}'+07:00'"))
    message = F.to_json(F.struct(zoned.alias("timestamp"), F.upper("transport").alias("proto")))
    side = lambda end: F.struct(F.col(f"{end}_ip").alias("ip"), F.col(f"{end}_port").alias("port"))
    nested = F.to_json(F.struct(
        F.col("timestamp").alias("@timestamp"), message.alias("message"),
        side("source").alias("source"), side("dest").alias("destination"),
        F.struct(F.when(number % 4 != 0, F.col("transport")).alias("transport"), "community_id")
        .alias("network"),
        F.struct(F.col("rule_name").alias("name"), F.col("rule_severity").alias("severity")).alias("rule"),
    ))
    cut = F.when(number % 13 == 0, F.substring(nested, 1, 34)).otherwise(nested)
    for half in (0, 1):
        alerts.where(number % 2 == half).select(cut).write.mode("append").text(f"{root}/in")
        finish(start_intake(alert_lines(spark, f"{root}/in"), f"{root}/alerts", f"{root}/quarantine",
                            f"{root}/state", once=True))
    good = spark.read.parquet(f"{root}/alerts").select(
        F.lit("alert").alias("kind"), F.col("alert_id").alias("content"), "event_us", "transport", "source_port")
    bad = spark.read.parquet(f"{root}/quarantine").select(
        F.lit("line").alias("kind"), F.col(log_source.CORRUPT).alias("content"))
    return good.unionByName(bad, allowMissingColumns=True)


@query
def alert_conn_stream_join(spark, sf_dir):
    """Alerts and connections as two streams in three runs; the last brings only later times."""
    root = new_table_dir(spark, "connect")
    alerts, conn = view(spark, sf_dir, "v_alerts"), view(spark, sf_dir, "v_conn")
    middle, end = conn.agg(
        ((F.min("ts_us") + F.max("ts_us")) / 2).cast("long").alias("m"), F.max("ts_us").alias("e")).first()
    day = 86_400_000_000
    for low, high, shift in ((0, middle, 0), (middle, end + 1, 0), (end, end + 1, 2 * day)):
        rows = conn.where((F.col("ts_us") >= low) & (F.col("ts_us") < high))
        asked = alerts.where((F.col("event_us") >= low) & (F.col("event_us") < high))
        if shift:  # rows without a match move the watermarks on
            rows = rows.withColumn("community_id", F.lit("end")).withColumn("ts_us", F.col("ts_us") + shift)
            asked = rows.select(F.col("row_id").alias("alert_id"), F.col("ts_us").alias("event_us"),
                                F.lit("no row").alias("community_id"))
        rows.write.mode("append").parquet(f"{root}/conn")
        asked.select("alert_id", "event_us", "community_id").write.mode("append").parquet(f"{root}/alerts")
        finish(start_connect(
            spark.readStream.schema("alert_id long, event_us long, community_id string").parquet(f"{root}/alerts"),
            spark.readStream.schema(conn.schema).parquet(f"{root}/conn"),
            f"{root}/matched", f"{root}/state", once=True))
    return spark.read.parquet(f"{root}/matched")


@query
def alert_enrich_stream(spark, sf_dir):
    """Alerts enriched in micro-batches and numbered on arrival."""
    root = new_table_dir(spark, "enrich")

    def logs():
        return view(spark, sf_dir, "v_conn"), timed_logs(spark, sf_dir)

    finish(start_enrich(event_stream(spark, sf_dir), logs, f"{root}/docs", f"{root}/state",
                        once=True))
    return spark.read.parquet(f"{root}/docs").select(
        "alert_id", "alert_index", "has_connection", "has_evidence", "http_level", "dns_level",
        "ssl_level", "files_level",
    )


@query
def result_forward_stream(spark, sf_dir):
    """Result lines appended to a folder and forwarded from there."""
    root = new_table_dir(spark, "forward")
    lines = view(spark, sf_dir, "v_analyses").select(F.to_json(F.struct("*")).alias("value"))
    lines.write.text(f"{root}/results")
    finish(start_forward(spark, f"{root}/results", f"{root}/target", f"{root}/state", once=True))
    sent = spark.read.text(f"{root}/target")
    return sent.select(
        F.get_json_object("value", "$.processed").cast("long").alias("processed"),
        F.get_json_object("value", "$.classification").alias("classification"),
    )
