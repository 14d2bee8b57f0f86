"""SQL counterparts of the registered queries, over the same tables.

Written straight from the rules, with plain joins and windows, and without the decompositions
the Spark plans use.
"""

from __future__ import annotations

from alertloom import constants as K
from alertloom.functions.text import CONTENT_REASONS
from alertloom.plans.views import SUFFIX_HOSTS, SUFFIX_RULES, ansi_timed_view, ansi_view

ORACLES: dict[str, str] = {}


def oracle(name: str, body: str, *views: str, ctes: str = "") -> None:
    parts = [ansi_view(v) for v in views]
    if ctes:
        parts.append(ctes)
    ORACLES[name] = (f"with {', '.join(parts)} " if parts else "") + body


def quoted(texts) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in texts)


def hash_sql(port: str = "source_port") -> str:
    return (
        "sha256(cast(to_json(list_value(coalesce(timestamp, ''), coalesce(source_ip, ''), "
        f"coalesce({port}, ''), coalesce(dest_ip, ''), coalesce(dest_port, ''), "
        "coalesce(rule_name, ''))) as varchar))"
    )


SELECTED = (
    "event_module = 'suricata' and "
    "(coalesce(rule_severity in ('1', '2', '3'), false) "
    "or coalesce(event_severity in ('1', '2', '3'), false))"
)

# --- ingestion --------------------------------------------------------------------------------

oracle("alert_filter",
       f"""select alert_id, timestamp, rule_name, rule_severity, event_severity from v_alerts
       where {SELECTED} and cast(timestamp as timestamp) between timestamp '2024-01-05 00:00:00'
       and timestamp '2024-01-20 00:00:00'""", "v_alerts")
oracle("alert_dedup_hash",
       f"""select alert_hash, alert_id, timestamp from (
         select {hash_sql()} as alert_hash, alert_id, timestamp,
           row_number() over (partition by {hash_sql()} order by timestamp, alert_id) as rn
         from v_alerts) where rn = 1""", "v_alerts")
oracle("alert_dedup_stream",
       f"""select distinct {hash_sql()} as alert_hash,
       cast(cast(try_cast(timestamp as timestamp) + interval 7 hour as date) as varchar) as local_day
       from (select * replace (case when alert_id % 10 = 0 then 'unknown' else timestamp end as timestamp)
             from v_alerts)""", "v_alerts")
oracle("intake_quarantine_stream",
       f"""select 'alert' as kind, {hash_sql()} as content, event_us, transport, source_port
       from v_alerts where alert_id % 13 <> 0
       union all select 'line', concat('{{"@timestamp":"', timestamp), null, null, null
       from v_alerts where alert_id % 13 = 0""", "v_alerts")
oracle("alert_anti_log",
       f"""select alert_hash, min(alert_id) as alert_id from
       (select {hash_sql()} as alert_hash, * from v_alerts)
       where alert_hash not in (select {hash_sql()} from v_alerts where event_module = 'other')
       group by alert_hash""", "v_alerts")
oracle("alert_day_counts",
       """select cast(cast(cast(timestamp as timestamp) + interval 7 hour as date) as varchar)
       as local_day, count(*) as n from v_alerts group by 1""", "v_alerts")
oracle("alert_array_backfill",
       f"""select {hash_sql()} as alert_id, timestamp, source_port from v_alerts
       where cast(cast(timestamp as timestamp) + interval 7 hour as date) = date '2024-01-10'""", "v_alerts")
oracle("alert_path_values",
       """select alert_id, case when alert_id % 3 = 0 then 'flat' else rule_name end as rule_name,
       coalesce(rule_category, 'N/A') as rule_category, 'N/A' as rule_severity from v_alerts""", "v_alerts")
oracle("alert_index",
       """select alert_id, timestamp,
       cast(row_number() over (order by timestamp, alert_id) as bigint) as alert_index
       from v_alerts""", "v_alerts")

# --- matching ---------------------------------------------------------------------------------

BY_TUPLE = (
    "a.source_ip = c.orig_h and cast(a.source_port as int) = c.orig_p and a.dest_ip = c.resp_h "
    "and cast(a.dest_port as int) = c.resp_p and lower(a.transport) = c.proto"
)


def match_ctes(tag: str, condition: str, extra: str = "true") -> str:
    return f"""
    {tag}_cand as (select a.alert_id, c.uid, c.row_id, c.ts_us,
        coalesce(nullif(c.duration, 0), -1) as length
      from v_alerts a join v_conn c on {condition} and abs(c.ts_us - a.event_us) < 660000000
      where {extra}),
    {tag}_best as (select alert_id, uid from (select *, row_number() over (partition by alert_id
      order by length desc, ts_us, row_id) as rn from {tag}_cand) where rn = 1 and uid is not null),
    {tag} as (select alert_id, uid, row_id as conn_row from (select c.*, row_number() over (
      partition by c.alert_id order by c.ts_us desc, c.row_id desc) as rn
      from {tag}_cand c join {tag}_best b on c.alert_id = b.alert_id and c.uid = b.uid)
      where rn = 1)"""


COMMUNITY_MATCH = match_ctes("by_id", "a.community_id = c.community_id")
FIRST_HOUR, LAST_HOUR = (f"((a.event_us {side} 659999999) // 3600000000)" for side in "-+")
TUPLE_MATCH = match_ctes(
    "by_tuple", BY_TUPLE,
    "not exists (select 1 from v_conn k where k.community_id = a.community_id "
    f"and k.ts_us // 3600000000 between {FIRST_HOUR} and {LAST_HOUR})",
)
MATCHED = f"""{COMMUNITY_MATCH}, {TUPLE_MATCH},
    matched as (select *, 'community' as matched_by from by_id
                union all select *, 'tuple' as matched_by from by_tuple)"""

oracle("alert_conn_match", "select * from by_id", "v_alerts", "v_conn", ctes=COMMUNITY_MATCH)
oracle("alert_conn_stream_join", "select * from by_id", "v_alerts", "v_conn", ctes=COMMUNITY_MATCH)
oracle("alert_conn_fallback", "select * from by_tuple", "v_alerts", "v_conn", ctes=TUPLE_MATCH)
oracle("alert_match_all",
       """select a.alert_id, m.uid, m.matched_by, m.conn_row
       from v_alerts a left join matched m on a.alert_id = m.alert_id""",
       "v_alerts", "v_conn", ctes=MATCHED)
LOGS = ("http", "dns", "ssl", "files")


def scoped_sql(untimed: bool = False) -> str:
    """The logs as the alerts of a session see them: `uid` is the session with the hours it is seen in.

    A row without a time has no hour; with `untimed` it is seen in all of them, before other rows.
    """
    columns, seen = "r.* exclude (uid)", "r.ts_us // 3600000000 between s.first_hour and s.last_hour"
    if untimed:
        columns += " replace (coalesce(r.ts_us, -1000000000000000000) as ts_us)"
        seen = f"(r.ts_us is null or {seen})"
    return f"""{MATCHED},
    scopes as (select m.alert_id, m.uid, m.conn_row, {FIRST_HOUR} as first_hour, {LAST_HOUR} as last_hour,
        concat(m.uid, '@', {FIRST_HOUR}, case when {LAST_HOUR} > {FIRST_HOUR}
          then concat('-', {LAST_HOUR}) else '' end) as scope
      from matched m join v_alerts a on m.alert_id = a.alert_id),
    spans as (select distinct uid, scope, first_hour, last_hour from scopes),
    """ + ", ".join(ansi_timed_view(f"v_{n}", f"raw_{n}") for n in LOGS) + ", " + ", ".join(
        f"""v_{n} as (select {columns}, s.scope as uid from raw_{n} r join spans s
      on r.uid = s.uid and {seen})"""
        for n in LOGS)


SCOPED = scoped_sql()
oracle("alert_repeat_match",
       """select a.alert_id, m.uid, m.matched_by, m.conn_row from (
         select alert_id from v_alerts
         union all select alert_id from v_alerts, range(2) where alert_id % 3 = 0) a
       left join matched m on a.alert_id = m.alert_id""",
       "v_alerts", "v_conn", ctes=MATCHED)
oracle("session_scan_pruned",
       """select uid, log, count(*) as n from (
       select uid, 'http' as log from v_http union all select uid, 'dns' from v_dns
       union all select uid, 'ssl' from v_ssl union all select uid, 'files' from v_files
       union all select s.scope, 'conn' from v_conn c join spans s on c.uid = s.uid
         and c.ts_us // 3600000000 between s.first_hour and s.last_hour) group by uid, log""",
       "v_alerts", "v_conn", ctes=SCOPED)
oracle("session_fan_out",
       """select uid, log, count(*) as n from (
       select uid, 'http' as log from v_http union all select uid, 'dns' from v_dns
       union all select uid, 'ssl' from v_ssl union all select uid, 'files' from v_files)
       where uid in (select uid from matched) group by uid, log""",
       "v_alerts", "v_conn", "v_http", "v_dns", "v_ssl", "v_files", ctes=MATCHED)
oracle("time_bucket_scan",
       """select p.event_id as alert_id, min(concat(cast(s.day as varchar), '/conn.',
         cast(s.q as varchar))) as path
       from events p join (select distinct cast(ts as date) as day,
           cast(floor(extract(hour from ts) / 6) as int) as q from events) s
         on cast(p.ts as date) = s.day
         and extract(hour from p.ts) >= s.q * 6 and extract(hour from p.ts) < (s.q + 1) * 6
       where p.event_type = 'error' group by p.event_id""")
oracle("log_table_scan",
       """select c.row_id, c.uid, c.ts_us from v_conn c,
       (select min(event_us) - 660000000 as a, max(event_us) + 660000000 as b from v_alerts
        where timestamp between '2024-01-10 00:00:00' and '2024-01-12 23:59:59') s
       where c.ts_us between s.a and s.b""", "v_alerts", "v_conn")
oracle("log_json_scan",
       """select uid, orig_h, conn_state, count(*) as n,
       cast(sum(orig_bytes) as bigint) as orig_bytes from v_conn
       group by uid, orig_h, conn_state""", "v_conn")
oracle("log_discovery",
       """with lines as (select strftime(make_timestamp(ts_us), '%Y-%m-%d') as day,
           extract(hour from make_timestamp(ts_us)) as hour, row_id from v_conn),
         taken as (select case when hour < 12 then 0 else 1 end as run, * from lines
           union all select 2, * from lines where day like '%7' and hour >= 18)
       select cast(run as int) as run, day, count(*) as n, cast(sum(row_id) as bigint) as row_ids
       from taken group by run, day""".replace("with lines", "with " + ansi_view("v_conn") + ", lines"))
oracle("flow_csv_scan",
       """select original_label, protocol, count(*) as n,
       cast(sum(source_port) as bigint) as ports from v_flows where dest_ip is not null
       group by original_label, protocol""", "v_flows")

# --- connections --------------------------------------------------------------------------------


def private_sql(ip: str) -> str:
    """Private addresses among those the views produce: a few blocks are enough here."""
    return (
        f"({ip} like '10.%' or {ip} like '192.168.%' or {ip} like '172.16.%' "
        f"or {ip} like '2001:db8:%')"
    )


FAILED = quoted(K.FAILED_CONN_STATES)
STATE_TEXT = " ".join(f"when '{k}' then '{v}'" for k, v in K.CONN_STATE_TEXT.items())
DIRECTION = (
    f"case when {private_sql('orig_h')} and not {private_sql('resp_h')} then 'Egress' "
    f"when {private_sql('orig_h')} then 'Lateral' when {private_sql('resp_h')} then 'Ingress' "
    "else 'Internet-to-Internet' end"
)
oracle("conn_summary",
       f"""select row_id, orig_h as source_ip, orig_p as source_port,
       {DIRECTION} as traffic_direction, service,
       round(coalesce(duration, 0.0), 4) as duration_seconds,
       case when conn_state in ({FAILED}) then concat('Suspicious: Connection failed with state ''',
         conn_state, ''', which may indicate scanning.')
       else 'Informational: Standard connection recorded.' end as overall_assessment,
       coalesce(case conn_state {STATE_TEXT} end,
         concat('Unknown State (', coalesce(conn_state, 'None'), ')')) as connection_state_desc,
       orig_bytes as upload_bytes, resp_bytes as download_bytes,
       case when resp_bytes > 0 then round(orig_bytes / resp_bytes, 1) end as ratio
       from v_conn""", "v_conn")
oracle("ip_privacy",
       f"""select ip, count(*) as n, {private_sql('ip')} as is_private
       from (select orig_h as ip from v_conn union all select resp_h from v_conn) group by ip""",
       "v_conn")

# --- http ---------------------------------------------------------------------------------------


def decoded_sql(x: str) -> str:
    for _ in range(3):
        x = f"url_decode(replace({x}, '+', ' '))"
    return f"lower({x})"


def reason_flag(reason: str, x: str, uri: bool) -> str:
    if reason == K.TRAVERSAL_REASON:
        return f"(contains({x}, '../') or contains({x}, '..\\'))" if uri else "false"
    pattern = K.CONTENT_PATTERNS[reason].replace("'", "''")
    return f"coalesce(regexp_matches({x}, '{pattern}', 'i'), false)"


def reasons_sql(x: str, uri: bool) -> str:
    """Sorted reason texts of a decoded content, comma-separated."""
    return "concat_ws(',', " + ", ".join(
        f"case when {reason_flag(r, x, uri)} then '{r}' end" for r in CONTENT_REASONS) + ")"


TAGGED = f"""
    decoded as (select *, {decoded_sql('uri')} as du, {decoded_sql('request_body')} as db
      from v_http),
    tagged as (select *, {reasons_sql('du', True)} as uri_reasons,
      {reasons_sql('db', False)} as body_reasons from decoded)"""
oracle("http_content_reasons", "select row_id, uri_reasons, body_reasons from tagged",
       "v_http", ctes=TAGGED)
oracle("document_content_reasons",
       f"select doc_id, {reasons_sql('lower(text)', False)} as reasons from documents")

HITS = f"""{TAGGED},
    hits as (select uid, ts_us * 2 as seen, 'URI' as src, substr(uri, 1, 256) as content,
        uri_reasons as reasons from tagged where uri_reasons <> ''
      union all select uid, ts_us * 2 + 1, 'BODY', substr(request_body, 1, 256), body_reasons
        from tagged where body_reasons <> ''),
    ranked as (select *, row_number() over (partition by uid, reasons order by seen) as rn
      from hits)"""
HTTP_FOUND = """select uid, reasons, count(*) as count,
       concat_ws('/', max(case when src = 'BODY' then 'BODY' end),
                 max(case when src = 'URI' then 'URI' end)) as source,
       string_agg(content, ' | ' order by seen) filter (where rn <= 3) as examples
       from ranked group by uid, reasons"""
oracle("http_findings_grouped", HTTP_FOUND, "v_http", ctes=HITS)

STATS = """
    stats as (select uid, count(*) as total_requests,
        cast(sum(coalesce(request_body_len, 0)) as bigint) as request_bytes,
        cast(sum(coalesce(response_body_len, 0)) as bigint) as response_bytes,
        count(*) filter (where status_code >= 400 and status_code < 500) as client_errors,
        arg_min(user_agent, ts_us) filter (where user_agent <> '') as user_agent,
        arg_min(host, ts_us) filter (where regexp_matches(host, '^[0-9]{1,3}(\\.[0-9]{1,3}){3}(:[0-9]+)?$'))
          as direct_host,
        string_agg(distinct method, ',' order by method) as methods
      from v_http group by uid)"""
oracle("http_session_stats", "select * from stats", "v_http", ctes=STATS)

MOVED = """
    entries as (
      select uid, 'upload' as direction, orig_fuids[i] as fuid, orig_filenames[i] as name,
        orig_mime_types[i] as mime
      from (select *, unnest(range(1, len(orig_fuids) + 1)) as i from v_http
            where orig_fuids is not null)
      union all
      select uid, 'download', resp_fuids[i], resp_filenames[i], resp_mime_types[i]
      from (select *, unnest(range(1, len(resp_fuids) + 1)) as i from v_http
            where resp_fuids is not null)),
    moved as (select uid, direction, count(distinct fuid) as count,
        coalesce(array_to_string(list_slice(list_sort(list(distinct name)
          filter (where name <> '')), 1, 3), ','), 'No valid filenames recorded') as filenames,
        array_to_string(list_sort(list(distinct mime) filter (where mime <> '')), ',')
          as mime_types,
        bool_or(coalesce(lower(regexp_extract(name, '(\\.[^.]*)$', 1)) in
          ('.exe', '.dll', '.bat', '.cmd', '.js', '.ps1', '.jar', '.bin'), false)
          or coalesce(mime in (""" + quoted(K.RISKY_MIME_TYPES) + """), false)) as risky
      from entries group by uid, direction)"""
oracle("http_file_transfers",
       "select uid, direction, count, filenames, mime_types from moved", "v_http", ctes=MOVED)


def ua_any(words, x="lower(coalesce(user_agent, ''))") -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


AGENTS = (
    f"coalesce(nullif(concat_ws(',', case when {ua_any(K.ANOMALOUS_AGENTS)} then "
    f"'Anomalous Pattern' end, case when {ua_any(K.SCRIPTING_AGENTS)} then "
    f"'Scripting/Tool Signature' end, case when {ua_any(K.OUTDATED_AGENTS)} then "
    "'Outdated Browser Signature' end), ''), 'Normal')"
)
oracle("user_agent_classes",
       f"""select user_agent, count(*) as n, {AGENTS} as properties
       from v_http group by user_agent""", "v_http")

HTTP_SUMMARY = f"""{HITS}, {STATS}, {MOVED},
    session_reasons as (select uid, string_agg(distinct r, ',' order by r) as patterns
      from (select uid, unnest(string_split(reasons, ',')) as r from hits) group by uid),
    http_parts as (select s.*, {AGENTS} as agents, coalesce(r.patterns, 'None') as patterns,
        u.count as n_up, d.count as n_down, coalesce(u.risky, false) as bad_up,
        coalesce(d.risky, false) as bad_down
      from stats s left join session_reasons r on s.uid = r.uid
      left join moved u on s.uid = u.uid and u.direction = 'upload'
      left join moved d on s.uid = d.uid and d.direction = 'download'),
    http_texts as (select *,
        concat_ws(', ',
          case when contains(agents, 'Anomalous') then 'an anomalous user agent' end,
          case when bad_up then 'suspicious file uploads' end,
          case when contains(patterns, 'SQLi') or contains(patterns, 'Time-based')
            then 'SQL Injection patterns' end,
          case when contains(patterns, 'Script Tag') or contains(patterns, 'HTML Event')
            then 'Cross-Site Scripting (XSS) patterns' end) as threats,
        concat_ws(', ',
          case when bad_down then 'suspicious file downloads' end,
          case when direct_host is not null then 'a direct-to-IP connection' end,
          case when contains(agents, 'Scripting') then 'a scripting tool user agent' end,
          case when contains(patterns, 'Traversal') then 'directory traversal attempts' end)
          as anomalies from http_parts),
    http_sessions as (select uid,
        case when threats <> '' then
          concat('High Confidence Threat: Session contains indicators of ', threats, '.')
        when anomalies <> '' then
          concat('Suspicious Anomaly: Session involves ', anomalies, '.')
        else 'Benign: No significant threat indicators found.' end as overall_assessment,
        agents, case when direct_host is not null then concat('Direct-to-IP (', direct_host, ')')
          else 'Domain Name' end as destination, patterns,
        case when n_up > 0 then concat(cast(n_up as varchar), ' files (',
          case when bad_up then 'Suspicious' else 'Benign' end, ')') else 'None' end as uploads,
        case when n_down > 0 then concat(cast(n_down as varchar), ' files (',
          case when bad_down then 'Suspicious' else 'Benign' end, ')') else 'None' end
          as downloads,
        case when round(client_errors / total_requests, 2) >= 0.7 then 'medium'
          else 'reference' end as level, total_requests
      from http_texts)"""
oracle("http_assessment",
       "select uid, overall_assessment, agents, destination, patterns, uploads, downloads, level "
       "from http_sessions", "v_http", ctes=HTTP_SUMMARY)

# --- dns ----------------------------------------------------------------------------------------

MULTI = quoted(K.MULTI_LABEL_SUFFIXES)


def entropy_sql(x: str) -> str:
    kept = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    return (
        f"case when length({kept}) > 0 then list_sum(list_transform(list_distinct("
        f"string_split({kept}, '')), lambda ch: -(len(list_filter(string_split({kept}, ''), "
        f"lambda y: y = ch)) / length({kept})) * log2(len(list_filter(string_split({kept}, ''), "
        f"lambda y: y = ch)) / length({kept})))) else 0 end"
    )


def parts_cte(name: str, source: str, host: str) -> str:
    return f"""
    {name}_split as (select *, string_split({host}, '.') as ls from {source}),
    {name}_k as (select *, case when len(ls) >= 2 and lower(concat(ls[-2], '.', ls[-1]))
        in ({MULTI}) then 2 when len(ls) >= 2 then 1 else 0 end as k from {name}_split),
    {name} as (select * exclude (ls, k), array_to_string(ls[len(ls) - k + 1:], '.') as suffix,
        coalesce(ls[len(ls) - k], '') as domain,
        coalesce(array_to_string(ls[:len(ls) - k - 1], '.'), '') as subdomain from {name}_k)"""


DNS = f"""{parts_cte('named', 'v_dns', 'query')},
    signed as (select *, coalesce(query <> '' and suffix in ({quoted(K.DNS_SUSPICIOUS_TLDS)}),
        false) as bad_tld,
        {entropy_sql('subdomain')} as entropy,
        coalesce(rcode_name in ({quoted(K.DNS_FAILURE_CODES)}), false) as failed,
        list_filter(ttls, lambda t: t < 60)[1] as low from named),
    repeats as (select uid, query, count(*) as n from signed where query <> ''
      group by uid, query having count(*) >= 20),
    answered as (select uid, count(distinct a) as distinct_answers
      from (select uid, unnest(answers) as a from v_dns) group by uid),
    low_first as (select uid, arg_min(cast(floor(low) as bigint), ts_us) as low_ttl
      from signed where low is not null group by uid),
    totals as (select s.uid, count(*) as total_queries,
        count(distinct s.query) as distinct_queries,
        coalesce(max(a.distinct_answers), 0) as distinct_answers,
        count(*) filter (where failed) as failed_queries,
        arg_max(rcode_name, ts_us) filter (where failed) as last_failure,
        arg_min(orig_h, ts_us) filter (where orig_h <> '') as source_ip,
        arg_min(resp_h, ts_us) filter (where resp_h <> '') as dns_server,
        max(l.low_ttl) as low_ttl, bool_or(bad_tld) as suspicious_tld,
        bool_or(coalesce(query <> '' and entropy > 3.0, false)) as dga,
        s.uid in (select uid from repeats) as repetitive,
        count(*) >= 10 and count(*) filter (where failed) / count(*) >= 0.5 as high_failure
      from signed s left join answered a on s.uid = a.uid left join low_first l on s.uid = l.uid
      group by s.uid),
    dns_totals as (select *, suspicious_tld or dga or repetitive or high_failure
        or low_ttl is not null as is_reported from totals)"""
oracle("dns_session_stats", "select * from dns_totals", "v_dns", ctes=DNS)

PERCENT = ("concat(cast(cast(round_even(failed_queries * 100 / total_queries, 0) as bigint) "
           "as varchar), '%')")
DNS_FOUND = f"""select uid, type, source, content, reason, count(*) as n from (
       select uid, 'AttributeFinding' as type, 'query_tld' as source, query as content,
         concat('Suspicious TLD (.', suffix, ')') as reason from signed where bad_tld
       union all select uid, 'AttributeFinding', 'query_length', query,
         concat('Long Query (', cast(length(query) as varchar), ' > 50)')
         from signed where length(query) > 50
       union all select uid, 'AttributeFinding', 'query_subdomain', query,
         concat('High Shannon Entropy (', printf('%.2f', entropy), ')')
         from signed where query <> '' and entropy > 3.0
       union all select uid, 'AttributeFinding', 'query_type', query,
         concat('Suspicious QTYPE (', qtype_name, ')')
         from signed where query <> '' and qtype_name in ('*', 'TXT', 'ANY')
       union all select uid, 'AttributeFinding', 'answer_record', cast(low_ttl as varchar),
         concat('Low TTL (', cast(low_ttl as varchar), 's)') from dns_totals
         where low_ttl is not null
       union all select uid, 'PatternFinding', 'query_stream', query,
         concat('Repetitive Query (', cast(n as varchar), ' times)') from repeats
       union all select uid, 'PatternFinding', 'query_stream',
         concat('rcode_name: ', last_failure), concat('High Failure Ratio (', {PERCENT}, ')')
         from dns_totals where high_failure)
       where uid in (select uid from dns_totals where is_reported)
       group by uid, type, source, content, reason"""
oracle("dns_findings", DNS_FOUND, "v_dns", ctes=DNS)

DNS_SUMMARY = f"""{DNS},
    dns_sessions as (select uid,
      case when dga or high_failure or repetitive then
        concat('Potential Threat: Activity exhibits ', concat_ws(', ',
          case when dga then 'DGA-like queries' end,
          case when high_failure then 'a high failure rate' end,
          case when repetitive then 'repetitive beaconing' end), '.')
      when low_ttl is not null or suspicious_tld then
        'Suspicious: Low-confidence anomalies observed (e.g., low TTL, monitored TLDs).'
      else 'Benign: No significant threat indicators found.' end as overall_assessment,
      case when dga then 'High Entropy (DGA-like)' when repetitive then
        'Repetitive (Beaconing-like)' else 'Normal' end as observed_query_pattern,
      concat('Normal (', {PERCENT}, ' failure rate)') as observed_integrity,
      case when suspicious_tld then 'Suspicious' else 'Normal' end as observed_tld_risk,
      case when low_ttl is not null then concat('Low (', cast(low_ttl as varchar), 's)')
        else 'Normal' end as observed_ttl_behavior,
      case when dga or high_failure or repetitive then 'critical' when low_ttl is not null
        then 'low' else 'reference' end as level, total_queries
      from dns_totals where is_reported)"""
oracle("dns_assessment", "select * exclude (total_queries) from dns_sessions", "v_dns",
       ctes=DNS_SUMMARY)

PAGE_HOSTS = "(select distinct regexp_extract(url, '^https?://([^/]+)', 1) as host from pages)"
oracle("dns_entropy",
       f"""select host, round({entropy_sql('host')}, 6) as entropy,
       round({entropy_sql('subdomain')}, 6) as subdomain_entropy from parts""",
       ctes=parts_cte("parts", PAGE_HOSTS, "host"))
oracle("domain_split", "select host, subdomain, domain, suffix from parts", "v_dns",
       ctes=parts_cte("parts", f"(select host from {PAGE_HOSTS} union "
                               "select query from v_dns where query <> '')", "host"))

oracle("domain_suffix_split",
       f"""with rules as (select distinct rule from ({SUFFIX_RULES.format(nation='nation')})),
       hosts as ({SUFFIX_HOSTS.format(nation='nation', customer='customer')}),
       tails as (select distinct host, k, string_split(host, '.') as labels,
           lower(array_to_string(string_split(host, '.')[-k:], '.')) as tail
         from hosts, range(1, 7) r(k) where k <= len(string_split(host, '.'))),
       sizes as (select t.host, arg_max(case when rule[1:1] = '!' then k - 1
           when rule[1:1] = '*' then k + 1 else k end, case when rule[1:1] = '!' then 100 + k
           when rule[1:1] = '*' then k + 1 else k end) as size
         from tails t join rules on rule in (tail, concat('*.', tail), concat('!', tail))
         where rule[1:1] <> '*' or k < len(labels) group by t.host),
       cuts as (select host, string_split(host, '.') as labels, coalesce(size, 0) as size
         from hosts left join sizes using (host))
       select host, array_to_string(labels[:-size - 2], '.') as subdomain,
         coalesce(labels[len(labels) - size], '') as domain,
         case when size = 0 then '' else array_to_string(labels[-size:], '.') end as suffix from cuts""")

# --- tls ----------------------------------------------------------------------------------------

INTEL = ", ".join(f"('ja3_details', '{h}', '{n}')" for h, n in K.MALICIOUS_JA3.items()) + ", " + \
    ", ".join(f"('ja3s_details', '{h}', '{n}')" for h, n in K.MALICIOUS_JA3S.items())
SSL = f"""
    intel(kind, value, threat_name) as (values {INTEL}),
    seen as (select distinct * from (
      select uid, 'server_names' as kind, server_name as value from v_ssl
      union all select uid, 'tls_versions_used', version from v_ssl
      union all select uid, 'ciphers_used', cipher from v_ssl
      union all select uid, 'ja3_details', ja3 from v_ssl
      union all select uid, 'ja3s_details', ja3s from v_ssl
      union all select uid, 'certificate_chain_fingerprints', unnest(cert_chain_fps) from v_ssl)
      where value <> ''),
    ssl_seen as (select s.uid, s.kind, s.value, i.threat_name from seen s
      left join intel i on s.kind = i.kind and s.value = i.value),
    ssl_names as (select uid,
        arg_min(threat_name, value) filter (where kind = 'ja3_details' and threat_name is not null)
          as ja3_threat,
        arg_min(threat_name, value) filter (where kind = 'ja3s_details' and threat_name is not null)
          as ja3s_threat
      from ssl_seen group by uid having bool_or(kind in ('server_names', 'ja3_details'))),
    ssl_totals as (select uid, coalesce(bool_or(established), false) as established,
        round(cast(sum(cast(coalesce(duration, 0) as decimal(20, 6))) as double), 2) as duration,
        bool_or(contains(lower(coalesce(validation_status, '')), 'self-signed')) as self_signed,
        bool_or(contains(lower(coalesce(validation_status, '')), 'unable to get local issuer'))
          as untrusted,
        bool_or(contains(lower(coalesce(validation_status, '')), 'has expired')) as expired,
        coalesce(string_agg(distinct version, ',' order by version)
          filter (where version in ({quoted(K.WEAK_PROTOCOLS)})), '') as weak_protocols,
        coalesce(string_agg(distinct cipher, ',' order by cipher)
          filter (where cipher in ({quoted(K.WEAK_CIPHERS)})), '') as weak_ciphers
      from v_ssl group by uid),
    ssl_facts as (select t.*, n.ja3_threat, n.ja3s_threat from ssl_totals t
      join ssl_names n on t.uid = n.uid)"""
oracle("ssl_session", "select * from ssl_facts", "v_ssl", ctes=SSL)
oracle("ssl_values", "select * from ssl_seen", "v_ssl", ctes=SSL)
oracle("ssl_intel_join", "select * from ssl_seen where threat_name is not null", "v_ssl", ctes=SSL)
SSL_SUMMARY = f"""{SSL},
    ssl_sessions as (select uid,
      case when coalesce(ja3_threat, ja3s_threat) is not null then
        concat('High Confidence Threat: Session contains malware indicators, including ',
          concat_ws(', ', 'a JA3 hash matching ''' || ja3_threat || '''',
            'a JA3S hash matching ''' || ja3s_threat || ''''), '.')
      when self_signed or untrusted then concat('Suspicious: Session involves anomalies like ',
        concat_ws(', ', case when self_signed then 'a self-signed certificate' end,
          case when untrusted then 'an untrusted certificate chain' end), '.')
      when weak_protocols <> '' or weak_ciphers <> '' then
        'Informational: Session used weak encryption, indicating a policy violation.'
      else 'Benign: No significant threat indicators found.' end as overall_assessment,
      nullif(concat_ws(',', case when expired then 'Expired Certificate' end,
        case when self_signed then 'Self-Signed Certificate' end,
        case when untrusted then 'Untrusted Chain' end), '') as issues,
      case when established then 'Successful' else 'Failed' end as handshake_status
      from ssl_facts),
    ssl_levels as (select *, case when starts_with(overall_assessment, 'High Confidence') then
        'critical' when starts_with(overall_assessment, 'Informational') then 'medium'
        when handshake_status = 'Failed' then 'low' else 'reference' end as level
      from ssl_sessions)"""
oracle("ssl_assessment", "select * from ssl_levels", "v_ssl", ctes=SSL_SUMMARY)

TRUSTED = " ".join(f"when '{d}' then '{v}'" for d, v in K.TRUSTED_DOMAINS.items())
WORDS = "list_concat(string_split(lower(host), '.'), string_split(lower(host), '-'))"
oracle("sni_reputation",
       f"""select host, n, case when coalesce(host, '') = '' then 'Unknown' else coalesce(
         case concat(domain, '.', suffix) {TRUSTED} end,
         case when list_has_any({WORDS}, list_value({quoted(K.ADWARE_KEYWORDS)}))
           then 'Adware/Tracker'
         when list_has_any({WORDS}, list_value({quoted(K.BENIGN_KEYWORDS)}))
           then 'Likely Benign Infrastructure' else 'Unknown Reputation' end) end as reputation
       from parts""", "v_ssl",
       ctes=parts_cte("parts", "(select host, count(*) as n from (select server_name as host "
                               f"from v_ssl union all select host from {PAGE_HOSTS}) "
                               "group by host)", "host"))

ORACLES["sni_reputation_join"] = ORACLES["sni_reputation"]
oracle("ssl_weak_join",
       f"""select distinct uid, 'protocol' as kind, version as name from v_ssl
       where version in ({quoted(K.WEAK_PROTOCOLS)})
       union all select distinct uid, 'cipher', cipher from v_ssl where cipher in ({quoted(K.WEAK_CIPHERS)})""",
       "v_ssl")

# --- files --------------------------------------------------------------------------------------

EXTENSIONS = " or ".join(f"ends_with(lower(filename), '{e}')" for e in K.FILE_RISKY_EXTENSIONS)
FILES = f"""
    flags as (select *, coalesce({EXTENSIONS}, false) as f_ext,
        coalesce(mime_type in ({quoted(K.RISKY_MIME_TYPES)}), false) as f_mime,
        coalesce(entropy > 7.5, false) as f_ent,
        coalesce(mime_type <> '' and analysis_mime_type <> ''
          and mime_type <> analysis_mime_type, false) as f_mis from v_files),
    scored as (select *, concat_ws(',', case when f_ent then 'HIGH_ENTROPY' end,
        case when f_mis then 'MIME_MISMATCH' end,
        case when f_ext then 'SUSPICIOUS_EXTENSION' end,
        case when f_mime then 'SUSPICIOUS_MIME' end) as reasons,
        cast(5 + case when f_ext then 20 else 0 end + case when f_mime then 20 else 0 end
          + case when f_ent then 30 else 0 end + case when f_mis then 40 else 0 end as int)
          as risk_score,
        case when is_orig then 'Upload' else 'Download' end as direction,
        coalesce(seen_bytes, 0) as size_bytes from flags),
    rated as (select *, case when risk_score >= 90 then 'Critical' when risk_score >= 70 then
        'High' when risk_score >= 40 then 'Medium' else 'Informational' end as severity,
        case when risk_score >= 90 then 3 when risk_score >= 70 then 2 when risk_score >= 40
        then 1 else 0 end as rank from scored),
    file_names as (select uid, reasons, filename, row_number() over (partition by uid, reasons
        order by min(ts_us), filename) as rn from rated
      where filename <> '' group by uid, reasons, filename),
    file_examples as (select uid, reasons, string_agg(filename, ',' order by filename) as examples
      from file_names where rn <= 5 group by uid, reasons),
    file_groups as (select uid, reasons, count(*) as count, max(severity) as severity,
        max(rank) as rank, max(risk_score) as avg_risk_score,
        string_agg(distinct direction, ',' order by direction) as directions,
        cast(sum(size_bytes) as bigint) as total_size_bytes from rated group by uid, reasons),
    file_sessions as (select uid,
        cast(sum(count) filter (where reasons <> '') as bigint) as bad,
        count(*) filter (where reasons <> '') as suspicious_groups_count,
        max(case when reasons <> '' then rank else 0 end) as top,
        bool_or(contains(reasons, 'MIME_MISMATCH') or contains(reasons, 'HIGH_ENTROPY'))
          as evasion_techniques_detected,
        cast(sum(count) as bigint) as total_files_analyzed,
        round(sum(total_size_bytes) / 1024, 2) as total_bytes_transferred_kb
      from file_groups group by uid),
    file_levels as (select *, coalesce(bad, 0) as suspicious_files_count,
        case top when 3 then 'Critical' when 2 then 'High' when 1 then 'Medium'
          else 'Informational' end as highest_threat_level,
        case when top = 3 then 'critical' when bad >= 1 then 'medium' else 'reference' end
          as level from file_sessions)"""
oracle("files_risk",
       """select uid, fuid, direction, severity, risk_score, size_bytes, reasons,
       nullif(mime_type, '') as file_type_reported, round(entropy, 2) as entropy, md5,
       case when timedout and missing_bytes > 0 then 'Incomplete (Timed Out, Missing Bytes)'
         when timedout then 'Incomplete (Timed Out)' when missing_bytes > 0 then
         'Incomplete (Missing Bytes)' end as transfer_status from rated""",
       "v_files", ctes=FILES)
oracle("files_groups",
       """select g.uid, g.count, g.reasons, g.severity, g.avg_risk_score, g.directions,
       g.total_size_bytes, coalesce(e.examples, 'No valid filenames recorded') as examples
       from file_groups g left join file_examples e on g.uid = e.uid and g.reasons = e.reasons
       where g.reasons <> ''""", "v_files", ctes=FILES)
oracle("files_rollup",
       """select uid, case when suspicious_files_count > 0 then
         concat('Suspicious file activity detected (', cast(suspicious_files_count as varchar),
           ' files)') else 'No suspicious file activity detected' end as session_risk_summary,
       highest_threat_level, evasion_techniques_detected, total_files_analyzed,
       suspicious_files_count, suspicious_groups_count, total_bytes_transferred_kb, level
       from file_levels""", "v_files", ctes=FILES)

# --- documents and verdicts -----------------------------------------------------------------------

ALL_VIEWS = ["v_alerts", "v_conn"]
#: Which collector takes each level: levels in order, within a level the rules in order.
PICKS = """
    rule_flags as (select k.uid, coalesce(h.level = 'medium', false) as http_medium,
        coalesce(starts_with(d.overall_assessment, 'Potential Threat'), false) as dns_critical,
        coalesce(d.observed_query_pattern <> 'Normal', false) as dns_high,
        coalesce(starts_with(d.observed_ttl_behavior, 'Low'), false) as dns_low,
        coalesce(f.highest_threat_level = 'Critical', false) as files_critical,
        coalesce(f.suspicious_files_count >= 1, false) as files_medium,
        coalesce(starts_with(s.overall_assessment, 'High Confidence'), false) as ssl_critical,
        coalesce(starts_with(s.overall_assessment, 'Informational'), false) as ssl_medium,
        coalesce(s.handshake_status = 'Failed', false) as ssl_low
      from (select distinct scope as uid from spans) k left join http_sessions h on k.uid = h.uid
      left join dns_sessions d on k.uid = d.uid left join ssl_levels s on k.uid = s.uid
      left join file_levels f on k.uid = f.uid),
    critical_pick as (select *, case when dns_critical then 'dns' when files_critical then 'files'
      when ssl_critical then 'ssl' else '' end as critical from rule_flags),
    high_pick as (select *, case when dns_high and critical <> 'dns' then 'dns' else '' end as high
      from critical_pick),
    medium_pick as (select *, case when http_medium then 'http'
      when files_medium and critical <> 'files' then 'files'
      when ssl_medium and critical <> 'ssl' then 'ssl' else '' end as medium from high_pick),
    picks as (select *, case when dns_low and 'dns' not in (critical, high) then 'dns'
      when ssl_low and 'ssl' not in (critical, medium) then 'ssl' else '' end as low
      from medium_pick)"""


def level_sql(collector: str, key: str) -> str:
    whens = " ".join(f"when p.{lv} = '{collector}' then '{lv}'" for lv in K.SEVERITY_LEVELS)
    return f"case when {key} is not null then case {whens} else 'reference' end end as {collector}_level"


FACTS = f"""{SCOPED}, {HTTP_SUMMARY}, {DNS_SUMMARY}, {SSL_SUMMARY}, {FILES}, {PICKS},
    facts as (select a.alert_id, a.rule_name, a.rule_category, m.uid is not null as has_connection,
        coalesce(h.uid, d.uid, s.uid, f.uid) is not null as has_evidence,
        {level_sql('http', 'h.uid')}, {level_sql('dns', 'd.uid')}, {level_sql('ssl', 's.uid')},
        {level_sql('files', 'f.uid')}, case when m.uid is not null then {DIRECTION} end as direction,
        h.total_requests as http_requests, d.total_queries as dns_queries,
        f.total_files_analyzed as n_files
      from v_alerts a left join scopes m on a.alert_id = m.alert_id
      left join v_conn c on m.conn_row = c.row_id left join picks p on m.scope = p.uid
      left join http_sessions h on m.scope = h.uid left join dns_sessions d on m.scope = d.uid
      left join ssl_levels s on m.scope = s.uid left join file_levels f on m.scope = f.uid)"""
LEVEL_COLUMNS = ("has_connection, has_evidence, http_level, dns_level, ssl_level, files_level")
oracle("evidence_levels", f"select alert_id, {LEVEL_COLUMNS} from facts", *ALL_VIEWS, ctes=FACTS)
oracle("document_facts",
       """select alert_id, rule_name as signature, coalesce(rule_category, 'N/A') as category,
       direction, coalesce(http_level, '') as http_levels, coalesce(dns_level, '') as dns_levels,
       coalesce(ssl_level, '') as ssl_levels, coalesce(files_level, '') as files_levels,
       http_requests, dns_queries, n_files from facts""", *ALL_VIEWS, ctes=FACTS)
EVIDENCE = f"""{FACTS},
    http_found as ({HTTP_FOUND}), dns_found as ({DNS_FOUND}),
    doc_entries as (
      select uid, 'http' as collector, 'findings' as kind, concat(case when count > 3
        then 'AggregatedContentFinding|' else 'ContentFinding|' end, source, '|', reasons) as value,
        case when count > 3 then 1 else count end as n from http_found
      union all select uid, 'http', 'findings', concat('AggregatedFileTransfer|', direction), 1 from moved
      union all select distinct uid, 'http', 'methods_used', method, 1 from v_http where method is not null
      union all select uid, 'dns', 'findings', concat(type, '|', source, '|', reason), n from dns_found
      union all select uid, 'ssl', kind, value, 1 from ssl_seen where uid in (select uid from ssl_facts)
      union all select uid, 'files', 'findings', concat('AggregatedFileFinding|', reasons), 1 from file_groups
        where reasons <> '')"""
oracle("document_evidence",
       """select s.alert_id, e.collector, e.kind, e.value, cast(sum(e.n) as bigint) as n
       from scopes s join doc_entries e on s.scope = e.uid group by all""", *ALL_VIEWS, ctes=EVIDENCE)
oracle("document_levels_read",
       "select alert_id, http_level, dns_level, ssl_level, files_level from facts where has_evidence",
       *ALL_VIEWS, ctes=FACTS)
oracle("analysis_chain",
       """select alert_index, kind, case when kind = 'record' then case when not asked or number % 2 = 0
           then 'False Positive' else 'True Positive' end when number = 3 then 'I cannot say.'
           else '{"result": {}}' end as content, case when not asked then 1.0::double end as confidence,
         case when kind = 'record' then rule_name end as signature,
         case when kind = 'record' then concat('enriched/alert_enrichment_', alert_index, '.jsonl') end as file
       from (select *, has_connection or has_evidence as asked, cast(rule_name[6:] as int) as number,
           case when (has_connection or has_evidence) and rule_name in ('RULE 3', 'RULE 5')
             then 'refused' else 'record' end as kind
         from facts join (select alert_id, row_number() over (order by timestamp, alert_id) as alert_index
           from v_alerts) using (alert_id))""", *ALL_VIEWS, ctes=FACTS)
oracle("evidence_levels_by_file",
       """select alert_id, case when http_level is not null then 'reference' end as http_level,
       case when dns_level is null then null when p.dns_low and not (p.files_medium and p.ssl_low)
         then 'low' else 'reference' end as dns_level,
       case when ssl_level is null then null when p.ssl_low then 'high' else 'reference' end as ssl_level,
       case when files_level is null then null when not p.files_medium then 'reference'
         when p.ssl_low then 'low' else 'high' end as files_level
       from facts left join scopes s using (alert_id) left join rule_flags p on s.scope = p.uid""",
       *ALL_VIEWS, ctes=FACTS)
oracle("auto_fp_routing",
       """select alert_id,
       case when not has_connection and not has_evidence then 'False Positive' end
         as classification,
       case when not has_connection and not has_evidence then concat('The alert signature ''',
         rule_name, ''' suggests a potential threat, but this is only a claim that requires ',
         'corroboration.') end as analyze_alert,
       has_connection or has_evidence as needs_inference from facts""", *ALL_VIEWS, ctes=FACTS)
oracle("inference_requests",
       """select alert_id, 'default' as model, cast(2048 as int) as max_tokens, 'user' as role,
       true as has_document from matched""", "v_alerts", "v_conn", ctes=MATCHED)
oracle("response_parse",
       """select alert_id, case when kind < 3 then cast(turn as int) end as n,
       case when kind < 3 then role end as role, kind < 3 as is_readable
       from (select conv_id * 100 + turn as alert_id, turn, role, (conv_id + turn) % 6 as kind
             from conversations)""")

# --- ground truth ---------------------------------------------------------------------------------

LABELS = """
    labels_of as (select source_ip, source_port, dest_ip, dest_port, protocol,
        string_agg(distinct original_label, ', ' order by original_label) as original_label
      from v_flows where dest_ip is not null group by 1, 2, 3, 4, 5)"""
oracle("flow_labels", "select * from labels_of", "v_flows", ctes=LABELS)
oracle("map_alert_labels",
       """select a.timestamp, a.rule_name as alert_name, a.rule_category as category,
       a.rule_severity as severity, a.source_ip, a.source_port, a.dest_ip as destination_ip,
       a.dest_port as destination_port, a.transport, l.original_label
       from v_flow_alerts a join labels_of l on a.source_ip = l.source_ip
         and a.source_port = l.source_port and a.dest_ip = l.dest_ip
         and a.dest_port = l.dest_port
         and case upper(a.transport) when 'TCP' then 6 when 'UDP' then 17 when 'ICMP' then 1
           else -1 end = l.protocol
       where a.source_ip <> '' and a.dest_port <> 0""", "v_flow_alerts", "v_flows", ctes=LABELS)

QUOTAS = ", ".join(
    f"('{label}', '{group}', {n})" for group, (labels, n) in K.TP_QUOTAS.items()
    for label in labels
)
oracle("mapped_csv_scan",
       f"""select original_label, transport, count(*) as n, cast(sum(destination_port) as bigint) as ports
       from ({ORACLES['map_alert_labels']}) group by original_label, transport""")
oracle("quota_sample",
       """select row_key, timestamp, alert_name, source_ip, original_label,
       case when original_label = 'BENIGN' then 'FP' else 'TP' end as classification_label
       from (select * exclude (rn) from benign where rn <= 50
             union all select * exclude (category, quota, rn) from taken
             union all select * exclude (rn) from rest
               where rn <= 150 - (select count(*) from taken))""", "v_mapped",
       ctes=f"""quotas(label, category, quota) as (values {QUOTAS}),
    drawn as (select * replace (trim(original_label) as original_label),
      md5(concat('42', cast(row_key as varchar))) as draw from v_mapped),
    benign as (select *, row_number() over (order by draw, row_key) as rn from drawn
      where original_label = 'BENIGN'),
    grouped as (select d.*, q.category, q.quota, row_number() over (partition by q.category
      order by draw, row_key) as rn from drawn d join quotas q on d.original_label = q.label),
    taken as (select * from grouped where rn <= quota),
    rest as (select *, row_number() over (order by draw, row_key) as rn from drawn
      where original_label <> 'BENIGN' and row_key not in (select row_key from taken))""")
oracle("label_counts",
       "select trim(original_label) as original_label, count(*) as n from v_mapped group by 1",
       "v_mapped")
oracle("label_tp_fp",
       """select case when trim(original_label) = 'BENIGN' then 'FP' else 'TP' end
       as classification_label, count(*) as n from v_mapped group by 1""", "v_mapped")

RAW = """
    last_raw as (select timestamp, rule_name, source_ip, max(alert_id) as alert_id
      from v_flow_alerts where timestamp <> '' and rule_name <> '' and source_ip <> ''
      group by 1, 2, 3),
    wanted as (select alert_id as row_key, case when alert_id % 10 = 1 then '1999-01-01'
      else timestamp end as timestamp, rule_name, source_ip from v_flow_alerts),
    looked as (select w.row_key, w.source_ip, r.alert_id as raw_alert_id from wanted w
      left join last_raw r on w.timestamp = r.timestamp and w.rule_name = r.rule_name
        and w.source_ip = r.source_ip)"""
oracle("raw_alert_lookup", "select row_key, raw_alert_id from looked where source_ip <> ''",
       "v_flow_alerts", ctes=RAW)
oracle("raw_alert_counts",
       "select count(raw_alert_id) as n_found, count(*) - count(raw_alert_id) as n_missing "
       "from looked", "v_flow_alerts", ctes=RAW)

# --- serving --------------------------------------------------------------------------------------

SERVED = """
    indexed as (select *, row_number() over (order by timestamp, alert_id) - 1 as alert_index
      from v_alerts),
    latest as (select alert_index - 1 as alert_index, arg_max(classification, processed) as c,
      arg_max(summary, processed) as s from v_analyses group by 1),
    served as (select concat(i.timestamp, '-', cast(i.alert_index as varchar)) as unique_id,
      i.alert_index, i.timestamp, i.rule_name as alert_name, i.source_ip, i.source_port,
      i.dest_ip, i.dest_port, coalesce(l.c, 'Pending') as llm_verdict,
      coalesce(l.s, 'No summary available.') as reasoning_summary
      from indexed i left join latest l on i.alert_index = l.alert_index)"""
oracle("triage_view", "select * from served", "v_alerts", "v_analyses", ctes=SERVED)
oracle("triage_search",
       """select unique_id, source_ip, dest_ip, llm_verdict from served
       where (contains(lower(alert_name), '10.0.0.1') or contains(source_ip, '10.0.0.1')
         or contains(dest_ip, '10.0.0.1')) and llm_verdict = 'True Positive'""",
       "v_alerts", "v_analyses", ctes=SERVED)
oracle("triage_page",
       """select alert_index, alert_name, llm_verdict from served
       where contains(lower(alert_name), 'rule 3') order by alert_index desc limit 20 offset
       (select (least(2, greatest(ceil(count(*) / 20), 1)) - 1) * 20 from served
        where contains(lower(alert_name), 'rule 3'))""",
       "v_alerts", "v_analyses", ctes=SERVED)
oracle("triage_deep_page",
       """with """ + ansi_view("v_alerts") + ", " + ansi_view("v_analyses") + f""", {SERVED},
       placed as (select *, row_number() over (order by alert_index desc) - 1 as place, count(*) over () as n
         from served)
       select cast(page as int) as page, alert_index, unique_id from placed, (values (1), (90)) w(page)
       where place // 20 = least(page, greatest(1, ceil(n / 20))) - 1""")
oracle("triage_details",
       """select unique_id, strftime(cast(timestamp as timestamp), '%Y-%m-%d %H:%M:%S') as shown,
       case when llm_verdict = 'Pending' then '{"status":"Pending Analysis"}' else
         concat('{"conclusion":{"classification":"', llm_verdict, '","reasoning_summary":"',
           reasoning_summary, '"}}') end as llm_result_json from served""",
       "v_alerts", "v_analyses", ctes=SERVED)
oracle("triage_page_size",
       """select count(*) as n_total, cast(greatest(ceil(count(*) / 20), 1) as bigint) as n_pages
       from served where contains(lower(alert_name), 'rule 3')""",
       "v_alerts", "v_analyses", ctes=SERVED)

# --- streams --------------------------------------------------------------------------------------

oracle("alert_ingest_stream",
       f"""select {hash_sql()} as alert_hash, min(alert_id) as alert_id,
       cast(cast(cast(timestamp as timestamp) + interval 7 hour as date) as varchar) as local_day
       from v_alerts where {SELECTED} group by {hash_sql()}, 3""", "v_alerts")
oracle("alert_enrich_stream",
       f"""select f.alert_id, i.alert_index, {LEVEL_COLUMNS} from facts f join (select alert_id,
         cast(row_number() over (order by timestamp, alert_id) as bigint) as alert_index
         from v_alerts) i on f.alert_id = i.alert_id""", *ALL_VIEWS,
       ctes=FACTS.replace(SCOPED, scoped_sql(untimed=True)))
oracle("result_forward_stream", "select processed, classification from v_analyses", "v_analyses")
