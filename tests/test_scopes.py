"""What an alert sees depends on the alert alone: hours, fallback, copies, and shared levels."""

import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from alertloom.operators.match import match_alerts, session_scopes, with_row_key
from alertloom.operators.rules import with_levels
from alertloom.plans.enrich import band_folders, enrich, scoped_logs
from alertloom.sources.logs import in_folders, read_log_table, write_log_table
from alertloom.streaming.enrich import start_enrich
from tests.test_match import ALERT, CONN, S, T0, alert, conn

LOG_ROWS = {
    "http": "method string, host string, uri string, request_body string, user_agent string, status_code int, "
            "request_body_len long, response_body_len long, orig_fuids array<string>, orig_filenames array<string>, "
            "orig_mime_types array<string>, resp_fuids array<string>, resp_filenames array<string>, "
            "resp_mime_types array<string>",
    "dns": "orig_h string, resp_h string, query string, qtype_name string, rcode_name string, ttls array<double>, "
           "answers array<string>",
    "ssl": "server_name string, ja3 string, ja3s string, version string, cipher string, cert_chain_fps array<string>, "
           "established boolean, duration double, validation_status string",
    "files": "fuid string, filename string, mime_type string, analysis_mime_type string, entropy double, is_orig boolean, "
             "seen_bytes long, missing_bytes long, timedout boolean, md5 string, sha1 string",
}


def logs(spark, dns=(), ssl=()):
    """Log tables whose rows are (uid, seconds from T0)."""
    found = {}
    for name, columns in LOG_ROWS.items():
        rows = spark.createDataFrame(
            [(u, T0 + at * S, i) for i, (u, at) in enumerate({"dns": dns, "ssl": ssl}.get(name, ()))],
            "uid string, ts_us long, row_id long")
        for column in columns.split(", "):
            c, kind = column.split(" ")
            rows = rows.withColumn(c, F.lit(None).cast(kind))
        found[name] = rows
    found["dns"] = found["dns"].withColumn("query", F.lit("a.example.com")).withColumn(
        "ttls", F.array(F.lit(5.0)))
    found["ssl"] = found["ssl"].withColumn("established", F.lit(False)).withColumn("server_name", F.lit("x.example"))
    return found


def full(rows):
    return [(*r, f"2023-11-14T22:13:{i:02d}", "rule", "category") for i, r in enumerate(rows)]


FULL = ALERT + ", timestamp string, rule_name string, rule_category string"


def test_a_row_in_another_hour_does_not_block_the_fallback(spark):
    conns = [conn("far", "c1", 5000, 1), conn("near", "other", 10, 2)]
    got = match_alerts(spark.createDataFrame([alert(1, "c1")], ALERT), spark.createDataFrame(conns, CONN)).collect()
    assert [(r["uid"], r["matched_by"]) for r in got] == [("near", "tuple")]


def test_a_longest_connection_without_uid_is_none(spark):
    conns = [conn(None, "c1", 1, 1, 9.0), conn("short", "c1", 2, 2, 1.0)]
    assert match_alerts(spark.createDataFrame([alert(1, "c1")], ALERT), spark.createDataFrame(conns, CONN)).count() == 0


def test_documents_do_not_depend_on_the_batch(spark):
    alerts = [alert(1, "c1"), alert(2, "c1", 5000), alert(3, "c2"), alert(4, "c2", 5000), alert(5, "c3", None)]
    conns = [conn("u", "c1", 1, 1), conn("u", "c1", 5001, 2), conn("far", "c2", 5100, 3), conn("near", "other", 10, 4)]
    tables = spark.createDataFrame(conns, CONN), logs(spark, [("u", 3), ("u", 5003), ("near", 9)], [("u", 5004)])

    def documents(rows):
        return {(r["alert_id"], r["document"]) for r in enrich(spark.createDataFrame(full(rows), FULL).withColumn(
            "timestamp", F.lit("t")), *tables).collect()}

    together = documents(alerts)
    assert len(together) == 5
    assert together == documents(alerts[:2]) | documents(alerts[2:])
    assert together == set().union(*[documents([a]) for a in alerts])
    assert sum('"ssl"' in d for _, d in together) == 1  # the handshake is in the hours of one alert alone


def test_copies_of_an_alert_have_one_document_each(spark):
    rows = spark.createDataFrame(full([alert(1, "c1")] * 4 + [alert(2, None, 0, ("9.9.9.9", "1", "8.8.8.8", "2", "tcp"))] * 3), FULL)
    tables = spark.createDataFrame([conn("u", "c1", 1, 1)], CONN), logs(spark, [("u", 3)])
    docs = enrich(rows, *tables).collect()
    assert sorted((r["alert_id"], r["uid"]) for r in docs if r["uid"]) == [(1, "u")] * 4
    assert len(docs) == 7 and len({r["alert_row"] for r in docs}) == 7


def test_copies_in_a_stream_have_one_number_each(spark, tmp_path):
    rows = [alert(1, "c1")] * 3 + [alert(2, "c1")] * 2
    for i, part in enumerate([rows[:3], rows[2:]]):  # two files, the second repeats the first
        spark.createDataFrame(full(part), FULL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FULL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    tables = spark.createDataFrame([conn("u", "c1", 1, 1)], CONN), logs(spark, [("u", 3)])
    running = start_enrich(stream, lambda: tables, str(tmp_path / "docs"), str(tmp_path / "state"), once=True)
    running.awaitTermination()
    docs = spark.read.parquet(str(tmp_path / "docs")).collect()
    assert sorted(r["alert_index"] for r in docs) == [1, 2, 3, 4, 5, 6]
    assert {r["batch"] for r in docs} == {0, 1}


@pytest.mark.parametrize("by", [("dt",), ("dt", "hour")])
def test_all_logs_are_pruned_to_the_hours_of_alerts(spark, tmp_path, by):
    day = 86400
    alerts = spark.createDataFrame([alert(1, "c1"), alert(2, "c1", 3 * day)], ALERT)
    conns = spark.createDataFrame([conn(f"u{i}", "c1", i * day // 4, i) for i in range(20)], CONN)
    every = {"conn": conns, **logs(spark, [(f"u{i}", i * day // 4) for i in range(20)], [("u0", 1), ("u1", day)])}
    tables = {}
    for name, rows in every.items():
        path = str(tmp_path / name)
        write_log_table(rows, path, by=by)
        if spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / name)).isEmpty():
            tables[name] = rows.withColumn("dt", F.to_date(F.timestamp_micros("ts_us")))
        else:
            tables[name] = read_log_table(spark, path)
    near = in_folders(tables["conn"], band_folders(alerts))
    assert {r["dt"] for r in near.collect()} == {dt.date(2023, 11, 14), dt.date(2023, 11, 17)}
    matched = match_alerts(alerts, near)
    scopes, scoped = scoped_logs(alerts, matched, {k: tables[k] for k in ("dns", "ssl")})
    assert {(r["uid"].split("@")[0], r["row_id"]) for r in scoped["dns"].collect()} == {("u0", 0), ("u12", 12)}
    for rows in (near, *scoped.values()):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruning" in plan


def without_time(rows, row):
    return rows.withColumn("ts_us", F.when(F.col("row_id") != row, F.col("ts_us")))


def test_a_stream_leaves_out_no_row_for_want_of_a_time(spark, tmp_path):
    spark.createDataFrame(full([alert(1, "c1"), alert(2, "c1", 10000)]), FULL).write.parquet(str(tmp_path / "in"))
    found = logs(spark, dns=[("u", 5000), ("other", 1)], ssl=[("u", 10001), ("u", 5000)])
    tables = (spark.createDataFrame([conn("u", "c1", 1, 1), conn("u", "c1", 10001, 2)], CONN),
              {**found, "dns": without_time(found["dns"], 0)})
    stream = spark.readStream.schema(FULL).parquet(str(tmp_path / "in"))
    start_enrich(stream, lambda: tables, str(tmp_path / "docs"), str(tmp_path / "state"), once=True).awaitTermination()
    docs = {r["alert_id"]: json.loads(r["document"]) for r in spark.read.parquet(str(tmp_path / "docs")).collect()}
    blocks = {i: {c: b["statistics"] for level in d["evidence"].values() for c, b in level.items()} for i, d in docs.items()}
    assert {i: sorted(b) for i, b in blocks.items()} == {1: ["dns"], 2: ["dns", "ssl"]}  # ssl has a time, of one alert's hours
    assert all(b["dns"]["total_queries"] == 1 for b in blocks.values())


def test_stream_and_sql_keep_events_without_a_time(spark, tmp_path):
    db = duckdb.connect()
    for name, rows in {  # two sessions of alerts and connections; dns and ssl rows are hours away or have no time
        "events": """select i as event_id, case when i % 8 = 6 or i % 16 = 7 or i % 80 = 40 then null else timestamp '2024-01-01 00:05:00'
            + to_days(i // 320) + to_hours(case when i % 4 < 2 then 0 else 5 end) + to_seconds(i % 320) end as ts, i // 4 % 6 as user_id,
            ['error', 'other', 'view', 'purchase'][i % 4 + 1] as event_type, (i % 9)::double as value, '{"k": 1}' as props""",
        "pages": "select i as page_id, 'https://h/' || i as url, '<p>' as html",
        "documents": "select i as doc_id, 'text ' || i as text, 'en' as lang, 's' as source, 9 as n_chars",
    }.items():
        db.execute(f"create table {name} as {rows} from range({dict(events=640, pages=24, documents=96)[name]}) t(i)")
        db.execute(f"copy {name} to '{tmp_path}/{name}.parquet'")
    columns = ["alert_id", "has_connection", "has_evidence", "http_level", "dns_level", "ssl_level", "files_level"]
    got = sorted((tuple(r) for r in entry_module.queries()["alert_enrich_stream"](spark, str(tmp_path)).select(*columns).collect()), key=repr)
    assert got == sorted(db.execute(f"select {', '.join(columns)} from ({entry_module.oracle_sql()['alert_enrich_stream']})").fetchall(), key=repr)
    assert {r[1] for r in got} == {True, False}
    assert all(all(level is not None for level in r[3:]) for r in got if r[1])


@pytest.mark.parametrize("by", [("dt",), ("dt", "hour")])
def test_the_folder_of_rows_without_a_time_is_read_where_asked(spark, tmp_path, by):
    alerts = spark.createDataFrame([alert(1, "c1")], ALERT)
    write_log_table(without_time(logs(spark, dns=[("u", 1), ("u", 9000), ("u", 2), ("v", 1)])["dns"], 1), str(tmp_path / "dns"), by=by)
    log = {"dns": read_log_table(spark, str(tmp_path / "dns"))}
    matched = alerts.select("alert_id", F.lit("u").alias("uid"))
    for untimed, want in ((False, [0, 2]), (True, [0, 1, 2])):
        rows = scoped_logs(alerts, matched, log, untimed=untimed)[1]["dns"]
        assert sorted(r["row_id"] for r in rows.collect()) == want
        assert "dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString()


def test_scopes_share_hours(spark):
    alerts = spark.createDataFrame([alert(1, "c1"), alert(2, "c1", 5), alert(3, "c1", 2400)], ALERT)
    scopes = session_scopes(alerts, match_alerts(alerts, spark.createDataFrame([conn("u", "c1", 1800, 1)], CONN)))
    assert scopes.count() == 1
    scopes = session_scopes(alerts, alerts.select("alert_id", F.lit("u").alias("uid"))).collect()
    assert len({r["scope"] for r in scopes}) == 2 and all(len(r["hours"]) <= 2 for r in scopes)


def levels(spark, rules, **blocks):
    fields = ", ".join(f"{c} struct<analysis: struct<a: string>>" for c in blocks)
    row = tuple(None if v is None else ((v,),) for v in blocks.values())
    got = with_levels(spark.createDataFrame([row], fields), list(blocks), rules).first()
    return {c: got[c] and got[c]["level"] for c in blocks}


def test_a_level_has_one_collector(spark):
    low = [("low", "dns", "analysis.a", "equals", "x"), ("low", "ssl", "analysis.a", "equals", "x")]
    assert levels(spark, low, dns="x", ssl="x") == {"dns": "low", "ssl": "reference"}
    assert levels(spark, low[::-1], dns="x", ssl="x") == {"dns": "reference", "ssl": "low"}
    assert levels(spark, low, dns=None, ssl="x") == {"dns": None, "ssl": "low"}
    rules = [("critical", "http", "analysis.a", "equals", "x"), ("critical", "dns", "analysis.a", "equals", "x"),
             ("high", "http", "analysis.a", "equals", "x"), ("medium", "dns", "analysis.a", "equals", "x"), *low]
    assert levels(spark, rules, http="x", dns="x", ssl="x") == {"http": "critical", "dns": "medium", "ssl": "low"}


def test_alert_rows_are_told_apart(spark):
    rows = with_row_key(spark.createDataFrame([alert(1, "c1")] * 5, ALERT))
    assert rows.select("alert_row").distinct().count() == 5


def test_evidence_is_put_into_json_once_a_session(spark):
    alerts = spark.createDataFrame(full([alert(1, "c1"), alert(2, "c1"), alert(3, "none", 0.0, ("9.9.9.9", "9", "9.9.9.9", "9", "tcp"))]), FULL)
    docs = enrich(alerts, spark.createDataFrame([conn("u", "c1", 1, 1)], CONN), logs(spark, dns=[("u", 5)], ssl=[("u", 6)]))
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert "items" not in plan[:plan.index("Join")]
    found = {r["alert_id"]: (list(json.loads(r["document"])), json.loads(r["document"]).get("evidence"), r["has_evidence"])
             for r in docs.collect()}
    assert [found[i][0] for i in (1, 2, 3)] == [["alert", "connection", "evidence"]] * 2 + [["alert"]]
    assert found[1][1] == found[2][1] and {c for level in found[1][1].values() for c in level} == {"dns", "ssl"}
    assert [found[i][2] for i in (1, 2, 3)] == [True, True, False]
