"""Alerts, connections and logs derived from the given tables.

Each view is a table, a filter and named expressions that mean the same in Spark and in ANSI SQL
engines; only the words in braces differ. All of a table's rows take part, so every view grows
with its table. A session is a run of neighbouring events; pages and documents are spread over
the same sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"us": "unix_micros(cast(ts as timestamp))", "array": "array", "str": "string",
         "k": "cast(get_json_object(props, '$.k') as bigint)", "double": "double"}
ANSI = {"us": "epoch_us(ts)", "array": "list_value", "str": "varchar",
        "k": "cast(json_extract_string(props, '$.k') as bigint)", "double": "double"}

EVENT_SESSION = "cast(floor(event_id / 320) as bigint)"
PAGE_SESSION = "cast(floor(page_id / 8) as bigint)"
DOC_SESSION = "cast(floor(doc_id / 32) as bigint)"
USER_TEXT = "cast(user_id as {str})"


def uid(session: str) -> str:
    return f"concat('C', cast({session} as {{str}}))"


COMMUNITY = "concat('1:', cast(user_id % 16 as {str}))"
ORIG_H = (
    "case when user_id % 6 = 0 then concat('203.1.113.', cast(user_id % 250 as {str})) "
    "else concat('10.0.', cast(cast(floor(user_id / 250) as bigint) % 250 as {str}), '.', "
    "cast(user_id % 250 as {str})) end"
)
RESP_H = (
    "case user_id % 5 when 0 then concat('8.8.8.', cast(user_id % 200 as {str})) "
    "when 1 then concat('192.168.1.', cast(user_id % 200 as {str})) "
    "when 2 then concat('172.16.0.', cast(user_id % 200 as {str})) "
    "when 3 then '2001:db8::1' else '2606:4700::1111' end"
)
PROTO = "case user_id % 3 when 0 then 'udp' else 'tcp' end"
ORIG_P = "cast(1024 + user_id % 500 as int)"
RESP_P = "cast(case user_id % 4 when 0 then 53 when 1 then 80 else 443 end as int)"

VIEWS: dict[str, tuple[str, str, dict[str, str]]] = {
    "v_alerts": ("events", "event_type = 'error'", {
        "alert_id": "event_id",
        "timestamp": "substr(cast(ts as {str}), 1, 19)",
        "event_us": "case when event_id % 50 = 7 then null else {us} end",
        "source_ip": ORIG_H,
        "source_port": f"cast({ORIG_P} as {{str}})",
        "dest_ip": RESP_H,
        "dest_port": f"cast({RESP_P} as {{str}})",
        "transport": PROTO,
        "community_id": f"case when event_id % 5 = 0 then null else {COMMUNITY} end",
        "rule_name": "concat('RULE ', cast(event_id % 7 as {str}))",
        "rule_category": "case when event_id % 8 = 0 then null else 'Potentially Bad' end",
        "rule_severity": "cast(1 + event_id % 5 as {str})",
        "event_module": "case when event_id % 11 = 0 then 'other' else 'suricata' end",
        "event_severity": "cast(event_id % 6 as {str})",
    }),
    "v_conn": ("events", "event_type <> 'error'", {
        "ts_us": "{us}",
        "row_id": "event_id",
        "uid": uid(EVENT_SESSION),
        "community_id": f"case when user_id % 16 = 13 then null else {COMMUNITY} end",
        "orig_h": ORIG_H,
        "orig_p": ORIG_P,
        "resp_h": RESP_H,
        "resp_p": RESP_P,
        "proto": PROTO,
        "service": "case user_id % 4 when 0 then 'dns' when 1 then 'http' when 2 then 'ssl' "
                   "else null end",
        "conn_state": "case event_id % 10 when 0 then 'S0' when 1 then 'S1' when 2 then 'S2' "
                      "when 3 then 'S3' when 4 then 'REJ' when 5 then 'RSTO' when 6 then 'RSTR' "
                      "when 7 then 'OTH' when 8 then null else 'SF' end",
        "duration": "case when event_id % 10 = 3 then null when event_id % 10 = 4 then 0.0 "
                    "else value end",
        "orig_bytes": "{k}",
        "resp_bytes": "case when event_id % 9 = 0 then 0 else (event_id * 37) % 1000 end",
    }),
    "v_http": ("pages", "true", {
        "uid": uid(PAGE_SESSION),
        "ts_us": "page_id * 1000000",
        "row_id": "page_id",
        "method": "case page_id % 5 when 0 then 'POST' when 1 then 'HEAD' else 'GET' end",
        "host": "case when page_id % 24 = 5 then '198.51.100.7:8080' "
                "else regexp_extract(url, '^https?://([^/]+)', 1) end",
        "uri": "concat(regexp_extract(url, '^https?://[^/]+([^#]*)', 1), case page_id % 16 "
               "when 0 then '?q=a%2527+or+1%253D1' when 1 then '?q=sleep%285%29' "
               "when 2 then '?x=%3Csvg%20onerror%3Dalert%281%29' when 3 then '?cmd=whoami' "
               "when 4 then '/uploads/my_shell.php' when 5 then '/..%2F..%2Fetc/passwd' "
               "when 6 then '?v=100%zz' when 7 then '?t=javascript:go' "
               "when 8 then concat('?h=', md5(url)) else '' end)",
        "request_body": f"case when {PAGE_SESSION} % 3 = 0 then html when page_id % 7 = 0 then '' "
                        "else null end",
        "user_agent": f"case {PAGE_SESSION} % 7 when 0 then 'curl/8.1' "
                      "when 1 then 'Mozilla/4.0 (compatible; MSIE 7.0)' "
                      "when 2 then 'C:/Windows/svchost.exe' when 3 then null when 4 then '' "
                      "else 'Mozilla/5.0 (X11)' end",
        "status_code": f"cast(case when {PAGE_SESSION} % 5 = 4 then 404 when page_id % 6 = 0 "
                       "then 403 when page_id % 6 = 1 then 500 when page_id % 6 = 2 then null "
                       "else 200 end as int)",
        "request_body_len": "case when page_id % 10 = 0 then null else page_id % 700 end",
        "response_body_len": "cast(length(html) as bigint)",
        "orig_fuids": "case when page_id % 9 = 0 then {array}(concat('FU', cast(page_id as {str})))"
                      " else null end",
        "orig_filenames": "case when page_id % 18 = 0 then {array}('notes.txt') else null end",
        "orig_mime_types": "case when page_id % 9 = 0 then {array}('text/plain') else null end",
        "resp_fuids": "case when page_id % 4 = 1 then {array}(concat('FD', cast(page_id as {str})),"
                      " concat('FE', cast(page_id % 16 as {str}))) else null end",
        "resp_filenames": "case when page_id % 8 = 1 then {array}(concat('f', cast(page_id % 6 as "
                          "{str}), case when page_id % 24 = 1 then '.EXE' else '.html' end), '', "
                          "'ignored.exe') else null end",
        "resp_mime_types": "case when page_id % 4 = 1 then {array}('text/html', case when "
                           "page_id % 40 = 1 then 'application/zip' else 'image/png' end) "
                           "else null end",
    }),
    "v_dns": ("events", "event_type = 'view'", {
        "uid": uid(EVENT_SESSION),
        "ts_us": "{us}",
        "row_id": "event_id",
        "orig_h": ORIG_H,
        "resp_h": "case when event_id % 3 = 0 then null else '9.9.9.9' end",
        "query": f"case {EVENT_SESSION} % 6 "
                 "when 0 then concat(substr(md5(cast(event_id as {str})), 1, 20), '.evil.com') "
                 "when 1 then 'beacon.example.com' "
                 "when 2 then concat('www', cast(event_id % 45 as {str}), '.shop.xyz') "
                 "when 3 then concat(repeat('a', 45), cast(event_id % 30 as {str}), "
                 "'.example.org') "
                 "when 4 then case when event_id % 10 = 0 then null else "
                 "concat('h', cast(event_id % 40 as {str}), '.example.com.cn') end "
                 "else concat('h', cast(event_id % 50 as {str}), '.example.net') end",
        "qtype_name": "case when event_id % 9 = 0 then 'TXT' when event_id % 9 = 1 then null "
                      "else 'A' end",
        "rcode_name": f"case when {EVENT_SESSION} % 6 = 5 and event_id % 3 < 2 then 'NXDOMAIN' "
                      "when event_id % 13 = 0 then 'SERVFAIL' else 'NOERROR' end",
        "ttls": f"case when {EVENT_SESSION} % 4 = 0 then {{array}}(cast(300 as double), "
                "cast(event_id % 90 as double)) when event_id % 2 = 0 then "
                "{array}(cast(3600 as double)) else null end",
        "answers": "case when event_id % 4 = 0 then null else {array}(concat('93.184.0.', "
                   "cast(event_id % 20 as {str})), concat('93.185.0.', cast(user_id % 30 as "
                   "{str}))) end",
    }),
    "v_ssl": ("events", "event_type = 'purchase'", {
        "uid": uid(EVENT_SESSION),
        "ts_us": "{us}",
        "row_id": "event_id",
        "server_name": f"case when {EVENT_SESSION} % 9 = 8 then null when event_id % 4 = 0 then "
                       "'www.google.com' when event_id % 4 = 1 then 'ads.tracker.example' "
                       "when event_id % 4 = 2 then 'static-cdn.assets.example.org' else "
                       "concat('h', cast(user_id % 40 as {str}), '.example.co.uk') end",
        "ja3": f"case when {EVENT_SESSION} % 9 = 8 then null when {EVENT_SESSION} % 8 = 0 and "
               "event_id % 5 = 0 then 'e7d4dd046396654b42318a6bd69c5e27' "
               "else md5(cast(user_id % 12 as {str})) end",
        "ja3s": f"case when {EVENT_SESSION} % 8 = 1 then '82365955f7547b74681308061413d939' "
                "when event_id % 3 = 0 then null else md5(cast(event_id % 12 as {str})) end",
        "version": f"case when {EVENT_SESSION} % 5 = 1 then 'TLSv10' when event_id % 2 = 0 then "
                   "'TLSv12' else 'TLSv13' end",
        "cipher": f"case when {EVENT_SESSION} % 7 = 3 then 'TLS_RSA_WITH_3DES_EDE_CBC_SHA' "
                  "else 'TLS_AES_128_GCM_SHA256' end",
        "cert_chain_fps": "case when event_id % 3 = 1 then null else {array}(md5(concat('fp', "
                          "cast(event_id % 10 as {str}))), md5(concat('ca', cast(event_id % 3 as "
                          "{str})))) end",
        "established": f"case when event_id % 7 = 0 then null else {EVENT_SESSION} % 3 <> 1 end",
        "duration": "case when event_id % 6 = 0 then null else value end",
        "validation_status": f"case {EVENT_SESSION} % 6 when 2 then 'Self-Signed certificate' "
                             "when 3 then 'unable to get local issuer certificate' "
                             "when 4 then 'certificate has expired' when 5 then null else 'ok' end",
    }),
    "v_files": ("documents", "true", {
        "uid": uid(DOC_SESSION),
        "ts_us": "doc_id * 1000",
        "row_id": "doc_id",
        "fuid": "concat('F', cast(doc_id as {str}))",
        "filename": f"case when {DOC_SESSION} % 4 = 3 then 'page.html' else case doc_id % 7 "
                    "when 0 then concat('report', cast(doc_id % 90 as {str}), '.pdf') "
                    "when 1 then concat('setup', cast(doc_id % 60 as {str}), '.EXE') "
                    "when 2 then concat('macro', cast(doc_id % 40 as {str}), '.docm') "
                    "when 3 then null when 4 then '' else 'index.html' end end",
        "mime_type": f"case when {DOC_SESSION} % 4 = 3 then 'text/html' else case doc_id % 6 "
                     "when 0 then 'application/x-dosexec' when 1 then null "
                     "when 2 then 'application/zip' else 'text/html' end end",
        "analysis_mime_type": "case when doc_id % 11 = 0 then 'application/x-dosexec' "
                              "when doc_id % 11 = 1 then '' else null end",
        "entropy": f"case when {DOC_SESSION} % 4 = 3 then 4.0 when doc_id % 8 = 0 then null "
                   "else cast(n_chars % 81 as double) / 10 end",
        "is_orig": "case when doc_id % 5 = 0 then null else doc_id % 3 = 0 end",
        "seen_bytes": "case when doc_id % 20 = 0 then null else n_chars end",
        "missing_bytes": "cast(case when doc_id % 9 = 0 then 10 else 0 end as bigint)",
        "timedout": "doc_id % 12 = 0",
        "md5": "md5(text)",
        "sha1": "case when doc_id % 2 = 0 then '' else md5(lang) end",
    }),
    "v_flows": ("orders", "true", {
        "row_key": "o_orderkey",
        "source_ip": "concat('10.0.0.', cast(o_custkey % 250 as {str}))",
        "source_port": "cast(1024 + o_custkey % 100 as int)",
        "dest_ip": "case when o_custkey % 40 = 0 then null else "
                   "concat('192.168.1.', cast(o_custkey % 50 as {str})) end",
        "dest_port": "cast(case when o_custkey % 4 = 0 then 80 else 443 end as int)",
        "protocol": "cast(case when o_custkey % 3 = 0 then 17 else 6 end as int)",
        "original_label": "case o_orderkey % 40 when 0 then 'Web Attack - XSS' "
                          "when 1 then 'Bot' when 2 then 'Infiltration' when 3 then 'FTP-Patator' "
                          "when 4 then 'DDoS' when 5 then 'PortScan' when 6 then 'DoS Hulk' "
                          "else 'BENIGN' end",
    }),
    "v_flow_alerts": ("events", "event_type = 'error'", {
        "alert_id": "event_id",
        "timestamp": "substr(cast(ts as {str}), 1, 19)",
        "source_ip": "case when event_id % 30 = 0 then '' else "
                     "concat('10.0.0.', cast(user_id % 250 as {str})) end",
        "source_port": "cast(1024 + user_id % 100 as int)",
        "dest_ip": "concat('192.168.1.', cast(user_id % 50 as {str}))",
        "dest_port": "cast(case when event_id % 31 = 0 then 0 when user_id % 4 = 0 then 80 "
                     "else 443 end as int)",
        "transport": "case when event_id % 29 = 0 then 'gre' when user_id % 3 = 0 then 'UDP' "
                     "else 'tcp' end",
        "rule_name": "concat('RULE ', cast(event_id % 7 as {str}))",
        "rule_category": "'Potentially Bad'",
        "rule_severity": "cast(1 + event_id % 3 as {str})",
    }),
    # Mapped alerts of their own: one label per row, all classes present.
    "v_mapped": ("orders", "true", {
        "row_key": "o_orderkey",
        "timestamp": "substr(cast(o_orderdate as {str}), 1, 10)",
        "alert_name": "concat('RULE ', cast(o_custkey % 7 as {str}))",
        "source_ip": "concat('10.0.0.', cast(o_custkey % 250 as {str}))",
        "original_label": "case o_custkey % 60 when 0 then ' Web Attack - XSS' "
                          "when 1 then 'Web Attack - Sql Injection' when 2 then 'Bot' "
                          "when 3 then 'Infiltration ' when 4 then 'SSH-Patator' "
                          "when 5 then 'DDoS' when 6 then 'PortScan' when 7 then 'DDoS, DoS Hulk' "
                          "else 'BENIGN' end",
    }),
    "v_analyses": ("labels", "true", {
        "alert_index": "doc_id % 150 + 1",
        "processed": "doc_id",
        "classification": "case when quality = 1 then 'True Positive' else 'False Positive' end",
        "summary": "concat('quality ', cast(quality as {str}), ', toxic ', cast(toxic as {str}))",
    }),
    "v_responses": ("conversations", "true", {
        "alert_id": "conv_id * 100 + turn",
        "response": "case (conv_id + turn) % 6 "
                    "when 0 then concat('Result:\n```json\n{{\"n\": ', cast(turn as {str}), ', "
                    "\"role\": \"', role, '\"}}\n```\n', text) "
                    "when 1 then concat('My answer is {{\"n\": ', cast(turn as {str}), ', "
                    "\"role\": \"', role, '\"}} as said.') "
                    "when 2 then concat('[{{\"n\": 0, \"role\": \"x\"}}, {{\"n\": ', "
                    "cast(turn as {str}), ', \"role\": \"', role, '\"}}]') "
                    "when 3 then concat('[1, ', cast(turn as {str}), ']') "
                    "when 4 then concat('{{\"n\": ', role) else text end",
    }),
}


#: Suffix rules by country, some with a wildcard and an exception, and host names under them.
_COUNTRY = "lower(substr(n_name, 1, 2))"
SUFFIX_RULES = f"""select {_COUNTRY} as rule from {{nation}}
  union all select concat('com.', {_COUNTRY}) from {{nation}}
  union all select concat('*.gov.', {_COUNTRY}) from {{nation}}
  union all select concat('!www.gov.', {_COUNTRY}) from {{nation}}"""
SUFFIX_HOSTS = f"""select concat('H', c_custkey % 9, '.', case c_custkey % 6 when 0 then 'com.'
    when 1 then 'x.com.' when 2 then 'www.gov.' when 3 then 'a.gov.' when 4 then 'b.c.gov.' else '' end,
    case when c_custkey % 17 = 0 then 'nowhere' else {_COUNTRY} end) as host
  from {{customer}} join {{nation}} on c_nationkey = n_nationkey"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, where, columns = VIEWS[name]
    exprs = [f"{e.format(**SPARK)} as `{a}`" for a, e in columns.items()]
    return table(spark, sf_dir, source).where(where.format(**SPARK)).selectExpr(*exprs)


#: Events that a row of these views stands for; their times place it among its session's events.
TIMED = {"v_http": 40, "v_files": 10}


def timed_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A log view with the time of its session's events; rows beyond the events have none."""
    rows = view(spark, sf_dir, name)
    if name not in TIMED:
        return rows
    step = TIMED[name]
    times = table(spark, sf_dir, "events").where(f"event_id % {step} = 0").selectExpr(
        f"cast(event_id / {step} as bigint) as row_id", f"{SPARK['us']} as ts_us")
    return rows.drop("ts_us").join(times, "row_id", "left").select(*rows.columns)


def ansi_timed_view(name: str, alias: str) -> str:
    """The timed view under another name."""
    source, where, columns = VIEWS[name]
    exprs = ", ".join(f'{e.format(**ANSI)} as "{a}"' for a, e in columns.items() if a != "ts_us")
    if name not in TIMED:
        return f"{alias} as (select {exprs}, {ANSI['us']} as ts_us from {source} where {where})"
    return (
        f"{alias} as (select v.*, e.ts_us from (select {exprs} from {source} where {where}) v "
        f"left join (select event_id, {ANSI['us']} as ts_us from events) e "
        f"on e.event_id = v.row_id * {TIMED[name]})"
    )


def ansi_view(name: str) -> str:
    """The same view as the text of a common table expression."""
    source, where, columns = VIEWS[name]
    exprs = ", ".join(f'{e.format(**ANSI)} as "{a}"' for a, e in columns.items())
    return f"{name} as (select {exprs} from {source} where {where.format(**ANSI)})"
