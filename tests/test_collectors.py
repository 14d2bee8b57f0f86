import json

import pytest
from pyspark.sql import functions as F

from alertloom.operators.collectors.dns import DnsCollector
from alertloom.operators.collectors.files import FilesCollector
from alertloom.operators.collectors.http import HttpCollector
from alertloom.operators.collectors.ssl import SslCollector
from alertloom.operators.documents import classified, documents, evidence_parts, sessions
from alertloom.schemas import LOG_JSON
from alertloom.sources.logs import log_rows


def log(spark, kind, rows):
    """Log rows in the JSON layout, in order of arrival."""
    lines = [json.dumps({"ts": float(i), "uid": "U", **r}) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    parsed = df.select(F.from_json("value", LOG_JSON[kind]).alias("j")).select("j.*")
    return log_rows(parsed, kind)


def run(spark, collector, rows, uid="U"):
    """Summary and evidence of one session; None if it is not reported."""
    logs = collector.prepare(log(spark, collector.name, rows))
    totals = collector.totals(logs)
    found = [r for r in classified(collector, totals).collect() if r["uid"] == uid]
    items = sorted(
        (r for r in collector.evidence(logs, totals).collect() if r["uid"] == uid),
        key=lambda r: tuple(r["ord"]))
    return (found[0] if found else None), items


def test_http_content_groups_of_three_and_four(spark):
    rows = [{"method": "GET", "uri": f"/x?q=sleep(1)&n={i}"} for i in range(3)]
    rows += [{"method": "POST", "uri": f"/y?cmd=whoami&n={i}"} for i in range(4)]
    s, items = run(spark, HttpCollector(), rows)
    found = [i["item"] for i in items if i["kind"] == "findings"]
    assert [f["type"] for f in found] == ["ContentFinding"] * 3 + ["AggregatedContentFinding"]
    assert found[0]["content"] == "/x?q=sleep(1)&n=0"
    assert found[3]["count"] == 4 and len(found[3]["examples"]) == 3
    assert found[3]["examples"][0] == "/y?cmd=whoami&n=0" and found[3]["source"] == "URI"
    assert s["analysis"]["observed_content_patterns"] == [
        "Time-based Blind", "Web Shell Command in Parameter"]
    assert s["analysis"]["overall_assessment"] == (
        "High Confidence Threat: Session contains indicators of SQL Injection patterns.")
    assert sorted(i["item"]["value"] for i in items if i["kind"] == "methods_used") == [
        "GET", "POST"]


def test_http_traversal_only_in_uri_and_body_after_uri(spark):
    rows = [{"uri": "/a/..%2Fb", "request_body": "../ <script>"}]
    _, items = run(spark, HttpCollector(), rows)
    found = [i["item"] for i in items]
    assert [(f["source"], f["reasons"]) for f in found] == [
        ("URI", ["Potential Directory Traversal"]), ("BODY", ["Script Tag"])]


def test_http_transfers_pair_by_position(spark):
    rows = [{"resp_fuids": ["F1", "F2", "F3"], "resp_filenames": ["b.txt", "a.js"],
             "resp_mime_types": ["text/plain"]},
            {"resp_fuids": ["F1"], "resp_filenames": ["", "ignored.exe"]}]
    s, items = run(spark, HttpCollector(), rows)
    f = items[0]["item"]
    assert (f["type"], f["direction"], f["count"]) == ("AggregatedFileTransfer", "download", 3)
    assert f["filenames"] == ["a.js", "b.txt"] and f["mime_types"] == ["text/plain"]
    assert s["analysis"]["observed_file_transfers"]["downloads"] == "3 files (Suspicious)"
    assert s["analysis"]["overall_assessment"] == (
        "Suspicious Anomaly: Session involves suspicious file downloads.")


def test_http_statistics_and_level(spark):
    rows = [{"status_code": 404, "request_body_len": 5, "host": "1.2.3.4:80", "user_agent": ""},
            {"status_code": 400, "response_body_len": 7, "user_agent": "first"},
            {"status_code": 500, "user_agent": "second", "host": "5.6.7.8"},
            {"status_code": 499}]
    s, _ = run(spark, HttpCollector(), rows)
    assert s["statistics"].asDict() == {"total_requests": 4, "request_bytes": 5,
                                        "response_bytes": 7, "client_error_ratio": 0.75}
    assert s["context"]["user_agent_string"] == "first"
    assert s["analysis"]["observed_destination"] == "Direct-to-IP (1.2.3.4:80)"
    assert s["level"] == "medium"


def test_dns_long_query_alone_is_not_reported(spark):
    s, items = run(spark, DnsCollector(), [{"query": "a" * 51 + ".com", "qtype_name": "TXT"}])
    assert s is None and items == []


@pytest.mark.parametrize("n, failing, reported", [(9, 9, False), (10, 5, True), (10, 4, False)])
def test_dns_failure_ratio(spark, n, failing, reported):
    rows = [{"query": f"h{i}.example.com", "rcode_name": "NXDOMAIN" if i < failing else "NOERROR"}
            for i in range(n)]
    s, items = run(spark, DnsCollector(), rows)
    assert (s is not None) == reported
    if reported:
        assert s["level"] == "critical"
        assert items[0]["item"]["reasons"] == ["High Failure Ratio (50%)"]
        assert items[0]["item"]["content"] == "rcode_name: NXDOMAIN"


@pytest.mark.parametrize("n, reported", [(19, False), (20, True)])
def test_dns_repetition(spark, n, reported):
    s, items = run(spark, DnsCollector(), [{"query": "b.example.com"}] * n)
    assert (s is not None) == reported
    if reported:
        assert [i["item"]["reasons"] for i in items] == [["Repetitive Query (20 times)"]]
        assert s["analysis"]["observed_query_pattern"] == "Repetitive (Beaconing-like)"


def test_dns_first_low_ttl_only(spark):
    rows = [{"query": "a.com", "TTLs": [300.0]}, {"query": "b.com", "TTLs": [90.0, 59.5, 10.0]},
            {"query": "c.com", "TTLs": [1.0], "id.orig_h": "10.0.0.9"}]
    s, items = run(spark, DnsCollector(), rows)
    assert [i["item"]["reasons"] for i in items] == [["Low TTL (59s)"]]
    assert s["analysis"]["observed_ttl_behavior"] == "Low (59s)" and s["level"] == "low"
    assert s["context"]["source_ip"] == "10.0.0.9"


def test_dns_multi_label_suffix_is_not_a_suspicious_tld(spark):
    assert run(spark, DnsCollector(), [{"query": "www.shop.com.cn"}])[0] is None
    s, items = run(spark, DnsCollector(), [{"query": "www.shop.cn"}])
    assert items[0]["item"]["reasons"] == ["Suspicious TLD (.cn)"] and s["level"] == "reference"


def test_ssl_needs_a_name_or_fingerprint(spark):
    assert run(spark, SslCollector(), [{"cipher": "TLS_X"}])[0] is None


@pytest.mark.parametrize("row, text, level", [
    ({"ja3": "e7d4dd046396654b42318a6bd69c5e27"}, "High Confidence Threat", "critical"),
    ({"validation_status": "Self-Signed certificate"}, "Suspicious", "low"),
    ({"version": "TLSv10"}, "Informational", "medium"),
    ({"validation_status": "has expired", "established": True}, "Benign", "reference"),
])
def test_ssl_assessment(spark, row, text, level):
    s, items = run(spark, SslCollector(), [{"server_name": "x.example", **row}])
    assert s["analysis"]["overall_assessment"].startswith(text) and s["level"] == level
    assert ("server_names", "x.example") in [(i["kind"], i["item"]["value"]) for i in items]


@pytest.mark.parametrize("row, score, severity", [
    ({}, None, "Informational"),
    ({"filename": "a.exe"}, 25, "Informational"),
    ({"filename": "a.exe", "mime_type": "application/zip"}, 45, "Medium"),
    ({"filename": "a.exe", "mime_type": "application/zip", "entropy": 7.6}, 75, "High"),
    ({"filename": "a.exe", "mime_type": "application/zip", "entropy": 7.6,
      "analysis_mime_type": "text/plain"}, 115, "Critical"),
])
def test_file_scores(spark, row, score, severity):
    s, items = run(spark, FilesCollector(), [{"fuid": "F", "seen_bytes": 1024, **row}])
    assert s["analysis"]["highest_threat_level"] == severity
    assert s["statistics"]["total_bytes_transferred_kb"] == 1.0
    assert s["level"] == ("reference" if score is None else
                          "critical" if severity == "Critical" else "medium")
    if score is None:
        assert items == []
    else:
        assert items[0]["item"]["avg_risk_score"] == score


def test_file_examples_are_the_first_five_distinct_names(spark):
    rows = [{"fuid": f"F{i}", "filename": n} for i, n in enumerate(
        ["z.exe", "z.exe", "y.exe", "x.exe", "w.exe", "v.exe", "a.exe"])]
    _, items = run(spark, FilesCollector(), rows)
    assert items[0]["item"]["example_filenames"] == ["v.exe", "w.exe", "x.exe", "y.exe", "z.exe"]
    assert items[0]["item"]["count"] == 7


def test_file_belongs_to_all_its_connections(spark):
    rows = [{"fuid": "F", "conn_uids": ["U", "V"]}]
    assert {r["uid"] for r in log(spark, "files", rows).collect()} == {"U", "V"}


def test_large_sessions_are_split_into_parts_without_loss(spark):
    rows = [{"query": f"h{i}.shop.xyz"} for i in range(500)]
    dns = log(spark, "dns", rows)
    collector = DnsCollector()
    evidence = collector.evidence(dns, collector.totals(dns))
    parts = evidence_parts(evidence, limit=100).collect()
    assert len(parts) == 5 and {p["parts"] for p in parts} == {5}
    queries = sorted(i["item"]["content"] for p in parts for i in p["items"])
    assert queries == sorted(r["query"] for r in rows)


def test_document_layout(spark):
    uids = spark.createDataFrame([("U",)], "uid string")
    logs = {
        "http": log(spark, "http", [{"method": "GET", "uri": "/"}]),
        "dns": log(spark, "dns", [{"query": "x.shop.xyz"}]),
        "ssl": log(spark, "ssl", [{"server_name": "x.example", "ja3": "00"}]),
        "files": log(spark, "files", [{"fuid": "F"}]),
    }
    logs["http"] = HttpCollector().prepare(logs["http"])
    session = sessions(uids, logs)
    alerts = spark.createDataFrame([(1, "t", "sig", None), (2, None, None, "cat")],
                                   "alert_id long, timestamp string, rule_name string, "
                                   "rule_category string")
    matched = spark.createDataFrame(
        [(1, "U", ("10.0.0.1", 0, "8.8.8.8", 53, "udp", "", "S0", None, 10, 0))],
        "alert_id long, uid string, conn struct<orig_h: string, orig_p: int, resp_h: string, "
        "resp_p: int, proto: string, service: string, conn_state: string, duration: double, "
        "orig_bytes: long, resp_bytes: long>")
    rows = {r["alert_id"]: r for r in documents(alerts, matched, session).collect()}
    assert json.loads(rows[2]["document"]) == {
        "alert": {"signature": "N/A", "category": "cat", "timestamp": "N/A"}}
    doc = json.loads(rows[1]["document"])
    assert list(doc) == ["alert", "connection", "evidence"]
    assert doc["connection"] == {
        "identity": {"source_ip": "10.0.0.1", "destination_ip": "8.8.8.8", "destination_port": 53,
                     "traffic_direction": "Egress", "transport_protocol": "udp"},
        "statistics": {"duration_seconds": 0.0},
        "analysis": {
            "overall_assessment": "Suspicious: Connection failed with state 'S0', which may "
                                  "indicate scanning.",
            "connection_state_desc": "Connection attempt, no reply",
            "flow_ratio": {"upload_bytes": 10, "download_bytes": 0, "ratio": "N/A"}},
    }
    assert {level: sorted(v) for level, v in doc["evidence"].items()} == {
        "low": ["ssl"], "reference": ["dns", "files", "http"]}
    assert doc["evidence"]["low"]["ssl"]["evidence"] == {
        "server_names": ["x.example"], "ja3_details": [{"hash": "00", "threat_name": None}]}
    assert doc["evidence"]["reference"]["files"]["evidence"] == {"findings": []}
    assert doc["evidence"]["reference"]["http"]["evidence"] == {
        "connection_context": {"methods_used": ["GET"]}}
