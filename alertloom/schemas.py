"""Explicit schemas of the JSON inputs, and the flat tables the operators work on."""

from __future__ import annotations

ALERT_JSON = """
    `@timestamp` STRING, message STRING,
    source STRUCT<ip: STRING, port: STRING>, destination STRUCT<ip: STRING, port: STRING>,
    network STRUCT<transport: STRING, community_id: STRING>,
    rule STRUCT<name: STRING, category: STRING, severity: STRING>,
    event STRUCT<module: STRING, severity: STRING>
"""

ALERT_LOG_JSON = """
    `@timestamp` STRING, `source.ip` STRING, `source.port` STRING, `destination.ip` STRING,
    `destination.port` STRING, `rule.name` STRING,
    original_alert STRUCT<
        `@timestamp`: STRING, message: STRING,
        source: STRUCT<ip: STRING, port: STRING>,
        destination: STRUCT<ip: STRING, port: STRING>,
        network: STRUCT<transport: STRING, community_id: STRING>,
        rule: STRUCT<name: STRING, category: STRING, severity: STRING>,
        event: STRUCT<module: STRING, severity: STRING>>
"""

LOG_JSON = {
    "conn": """
        ts DOUBLE, uid STRING, community_id STRING,
        `id.orig_h` STRING, `id.orig_p` INT, `id.resp_h` STRING, `id.resp_p` INT,
        proto STRING, service STRING, conn_state STRING, duration DOUBLE,
        orig_bytes BIGINT, resp_bytes BIGINT
    """,
    "http": """
        ts DOUBLE, uid STRING, method STRING, host STRING, uri STRING, request_body STRING,
        user_agent STRING, status_code INT, request_body_len BIGINT, response_body_len BIGINT,
        orig_fuids ARRAY<STRING>, orig_filenames ARRAY<STRING>, orig_mime_types ARRAY<STRING>,
        resp_fuids ARRAY<STRING>, resp_filenames ARRAY<STRING>, resp_mime_types ARRAY<STRING>
    """,
    "dns": """
        ts DOUBLE, uid STRING, `id.orig_h` STRING, `id.resp_h` STRING, query STRING,
        qtype_name STRING, rcode_name STRING, TTLs ARRAY<DOUBLE>, answers ARRAY<STRING>
    """,
    "ssl": """
        ts DOUBLE, uid STRING, server_name STRING, ja3 STRING, ja3s STRING, version STRING,
        cipher STRING, cert_chain_fps ARRAY<STRING>, established BOOLEAN, duration DOUBLE,
        validation_status STRING
    """,
    "files": """
        ts DOUBLE, uid STRING, conn_uids ARRAY<STRING>, fuid STRING, filename STRING,
        mime_type STRING, analysis_mime_type STRING, entropy DOUBLE, is_orig BOOLEAN,
        seen_bytes BIGINT, missing_bytes BIGINT, timedout BOOLEAN, md5 STRING, sha1 STRING
    """,
}

# Flat alerts: what every operator downstream of the sources reads.
ALERT_COLUMNS = [
    "alert_id", "timestamp", "event_us", "source_ip", "source_port", "dest_ip", "dest_port",
    "transport", "community_id", "rule_name", "rule_category", "rule_severity", "event_module",
    "event_severity",
]

VERDICT = """
    STRUCT<result: STRUCT<
        reasoning: STRUCT<thought_process: STRING, analyze_alert: STRING,
                          analyze_signals: STRING, synthesize_reasoning: STRING>,
        conclusion: STRUCT<classification: STRING, confidence_score: DOUBLE,
                           reasoning_summary: STRING>>>
"""

ANALYSIS_JSON = f"""
    alert_index BIGINT, processed_at TIMESTAMP, original_alert_signature STRING,
    enriched_prompt_file STRING, llm_analysis {VERDICT}
"""
