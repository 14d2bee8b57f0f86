import json

from pyspark.sql import functions as F

from alertloom import constants as K
from alertloom.operators.ingest import deduplicate, new_alerts, select_alerts
from alertloom.operators.numbering import continue_numbers, number_rows
from alertloom.operators.rules import rule_condition, severity_level
from alertloom.operators.timefiles import covering_file
from alertloom.sources import logs
from alertloom.sources.alerts import (
    alert_hash, alerts_of_day, document_at, flatten_alerts, path_value, read_alert_log,
    read_alerts_json, read_document_files,
)
from alertloom.sources.flows import read_flows
from alertloom.sources.refdata import public_suffixes, read_rules
from alertloom.sources.sinks import write_documents
from alertloom.streaming.ingest import alert_stream, bounded_dedup, start_ingest


def nested(i, ts="2024-05-01T20:00:00Z", port=80, severity="1", module="suricata"):
    return {
        "@timestamp": ts, "message": json.dumps({"timestamp": ts, "proto": "TCP"}),
        "source": {"ip": f"10.0.0.{i}", "port": port}, "destination": {"ip": "8.8.8.8", "port": 53},
        "network": {"community_id": "1:x"}, "rule": {"name": "r", "severity": severity},
        "event": {"module": module, "severity": None},
    }


def write_lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_malformed_lines_go_to_quarantine(spark, tmp_path):
    path = write_lines(tmp_path / "conn.log", [
        {"ts": 1.5, "uid": "a", "id.orig_h": "h", "id.orig_p": 5}, "{broken", "",
        {"ts": 2.5, "uid": "b", "extra": 1}])
    raw = logs.read_log_json(spark, "conn", path)
    assert [r[0] for r in logs.quarantine(raw).collect()] == ["{broken"]
    rows = logs.log_rows(raw, "conn").orderBy("ts_us").collect()
    assert [(r["uid"], r["ts_us"], r["orig_h"], r["orig_p"]) for r in rows] == [
        ("a", 1_500_000, "h", 5), ("b", 2_500_000, None, None)]


def test_hot_rows_repeat_no_archive_rows(spark, tmp_path):
    a = {"ts": 1.0, "uid": "a"}
    b = {"ts": 2.0, "uid": "a", "cipher": "x"}
    one = logs.read_log(spark, "ssl", write_lines(tmp_path / "1.log", [a, b]))
    two = logs.read_log(spark, "ssl", write_lines(tmp_path / "2.log", [b, {**b, "cipher": "y"}]))
    assert logs.with_hot(one, two).count() == 3


def test_partition_pruning_crosses_midnight(spark, tmp_path):
    path = str(tmp_path / "t")
    day = 86_400_000_000
    rows = spark.createDataFrame(
        [(f"u{h}", h * 3_600_000_000, h) for h in range(20, 29)], "uid string, ts_us long, row_id int")
    logs.write_log_table(rows, path)
    read = logs.prune_to(logs.read_log_table(spark, path), day - 660_000_000, day + 660_000_000)
    assert [r["uid"] for r in read.collect()] == ["u24"]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_file_discovery_and_time_spans(spark, tmp_path):
    root = tmp_path / "logs"
    for name in ("conn.00:00:00-01:00:00.log.gz", "conn.23:00:00-00:00:00.log.gz", "readme.txt"):
        write_lines(root / "2024-05-01" / name, ["x"])
    write_lines(root / "other" / "conn.01:00:00-02:00:00.log.gz", ["x"])
    found = logs.list_log_files(spark, str(root))
    assert found.count() == 2
    manifest = found.where(F.col("path").contains("00:00:00-01")).withColumn("length", F.lit(1))
    assert logs.changed_files(found, manifest).count() == found.where("length <> 1").count() + \
        found.where("length = 1").count() - 1
    spans = logs.file_spans(found).withColumn("day", F.col("day").cast("string"))
    points = spark.createDataFrame(
        [(1, "2024-05-01", 0), (2, "2024-05-01", 3600), (3, "2024-05-01", 86399)],
        "id int, day string, second int")
    got = {r["id"]: r["path"].rsplit("/", 1)[1] for r in covering_file(points, spans, ["id"]).collect()}
    assert got == {1: "conn.00:00:00-01:00:00.log.gz", 3: "conn.23:00:00-00:00:00.log.gz"}


def test_flow_csv_headers_and_types(spark, tmp_path):
    a = write_lines(tmp_path / "a.csv", [
        "Flow ID, Source IP, Source Port, Destination IP, Destination Port, Protocol, Label",
        "x,1.1.1.1,80,2.2.2.2,443.0,6,BENIGN", "y,1.1.1.1,,2.2.2.2,443,6,Bot"])
    b = write_lines(tmp_path / "b.csv", [
        "Label,Protocol,Destination Port,Destination IP,Source Port,Source IP",
        "Bot,17,53,2.2.2.2,9,3.3.3.3"])
    rows = {tuple(r) for r in read_flows(spark, a, b).collect()}
    assert rows == {("1.1.1.1", 80, "2.2.2.2", 443, 6, "BENIGN"),
                    ("3.3.3.3", 9, "2.2.2.2", 53, 17, "Bot")}


def test_alerts_flatten_from_lines_array_and_day_log(spark, tmp_path):
    rows = [nested(1), nested(2, port="54066.0")]
    lines = read_alerts_json(spark, write_lines(tmp_path / "a.jsonl", [*rows, "{bad"]))
    array = read_alerts_json(spark, write_lines(tmp_path / "a.json", [json.dumps(rows)]),
                             array_file=True)
    log = read_alert_log(spark, write_lines(tmp_path / "log.jsonl", [
        {"@timestamp": r["@timestamp"], "source.ip": r["source"]["ip"], "original_alert": r}
        for r in rows]))
    flats = [flatten_alerts(df).drop("original_alert").orderBy("source_ip").collect()
             for df in (lines, array, log)]
    assert flats[0] == flats[1] == flats[2] and len(flats[0]) == 2
    first = flats[0][0]
    assert first["transport"] == "tcp" and first["event_us"] == 1714593600000000
    assert [r["source_port"] for r in flats[0]] == ["80", "54066"]


def test_selection_and_deduplication(spark, tmp_path):
    rows = [nested(1, port=54066), nested(1, port="54066.0"), nested(2, severity="9"),
            nested(3, module="x"), nested(4, ts="2024-05-02T00:00:00Z")]
    flat = flatten_alerts(read_alerts_json(spark, write_lines(tmp_path / "a.jsonl", rows)))
    chosen = select_alerts(flat, end=F.lit("2024-05-01 20:00:00").cast("timestamp"))
    assert chosen.count() == 2 and deduplicate(chosen).count() == 1
    log = flat.where(F.col("source_ip") == "10.0.0.1").withColumn("alert_hash", alert_hash())
    fresh = new_alerts(flat, flat, log).collect()
    assert [r["source_ip"] for r in fresh][-1] == "10.0.0.4" and len(fresh) == 3
    # 20:00 UTC is already the next day at UTC+7.
    assert alerts_of_day(flat, "2024-05-02", K.LOCAL_TIME_ZONE).count() == 5


def test_row_numbers_are_dense_and_continue(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"),
                                  F.lit("same").alias("hot"))
    rows = number_rows(df, [F.col("hot"), F.col("v")]).collect()
    assert sorted((r["v"], r["row_number"]) for r in rows) == [(i, i) for i in range(1000)]
    more = continue_numbers(df, spark.createDataFrame([(41,)], "alert_index long"), [F.col("v")])
    assert more.agg(F.min("alert_index"), F.max("alert_index")).first() == (42, 1041)


def test_documents_by_file_and_day(spark, tmp_path):
    for i in (1, 12):
        write_lines(tmp_path / "d" / f"alert_enrichment_{i}.jsonl",
                    [json.dumps({"alert": {"signature": f"s{i}"}}, indent=4)])
    docs = read_document_files(spark, str(tmp_path / "d"))
    row = document_at(docs, 12).select(
        F.expr("variant_get(document, '$.alert.signature', 'string')")).first()
    assert row[0] == "s12"
    out = spark.createDataFrame([("2024-05-01T00:00:00Z", "{}"), (None, "{}")],
                                "timestamp string, document string")
    write_documents(out, str(tmp_path / "out"))
    assert {r["dt"] for r in spark.read.text(str(tmp_path / "out")).selectExpr(
        "cast(dt as string) dt").collect()} == {"2024-05-01", "unknown"}


def test_rules_guard_types_and_paths(spark):
    df = spark.createDataFrame([(("High", 0.7, True, ["x"]),)],
                               "analysis struct<a: string, r: double, flag: boolean, l: array<string>>")
    schema = df.schema

    def holds(path, check, value):
        c = rule_condition(("high", "c", path, check, value), schema)
        return None if c is None else df.select(c).first()[0]

    assert holds("analysis.a", "equals", "High") and holds("analysis.r", "gte", 0.7)
    assert holds("analysis.a", "startswith", "Hi") and holds("analysis.l", "contains", "x")
    assert holds("analysis.flag", "equals", "Yes") is None
    assert holds("analysis.missing", "equals", 1) is None
    assert holds("evidence.findings[*].reasons", "contains", "x") is None
    level = severity_level("c", schema, [("low", "c", "analysis.a", "equals", "High"),
                                         ("high", "c", "analysis.r", "gte", 0.5)])
    assert df.select(level).first()[0] == "high"


def test_stream_equals_batch_across_files_and_restarts(spark, tmp_path):
    src, log, state = tmp_path / "src", str(tmp_path / "log"), str(tmp_path / "state")
    write_lines(src / "1.jsonl", [nested(1), nested(1, port="80.0"), nested(2), "{bad"])
    start_ingest(alert_stream(spark, str(src)), log, state, once=True).awaitTermination()
    write_lines(src / "2.jsonl", [nested(2), nested(3), nested(5, ts="2024-05-01T10:00:00Z")])
    start_ingest(alert_stream(spark, str(src)), log, state, once=True).awaitTermination()
    got = spark.read.parquet(log)
    assert sorted(r["source_ip"] for r in got.collect()) == [f"10.0.0.{i}" for i in (1, 2, 3, 5)]
    assert {str(r["local_day"]) for r in got.collect()} == {"2024-05-01", "2024-05-02"}


def test_bounded_dedup_stream(spark, tmp_path):
    write_lines(tmp_path / "s" / "1.jsonl", [nested(1), nested(1), nested(2)])
    out = str(tmp_path / "o")
    (bounded_dedup(alert_stream(spark, str(tmp_path / "s"))).writeStream.format("parquet")
     .option("path", out).option("checkpointLocation", str(tmp_path / "c"))
     .trigger(availableNow=True).start().awaitTermination())
    assert spark.read.parquet(out).count() == 2


def test_path_value_prefers_flat_columns(spark):
    df = spark.createDataFrame([("flat", ("nested", None))],
                               "`rule.name` string, rule struct<name: string, category: string>")
    row = df.select(path_value(df, "rule.name"), path_value(df, "rule.category"),
                    path_value(df, "rule.none.x", "?")).first()
    assert tuple(row) == ("flat", "N/A", "?")
    only = df.select("rule")
    assert only.select(path_value(only, "rule.name")).first()[0] == "nested"


def test_configuration_files(spark, tmp_path):
    rules = write_lines(tmp_path / "rules.json", [json.dumps({"HIGH": [
        {"collector": "dns", "path": "analysis.a", "check": "gte", "value": 3}]})])
    assert read_rules(spark, rules) == [("high", "dns", "analysis.a", "gte", 3)]
    suffixes = write_lines(tmp_path / "psl.dat", ["// list", "com", "*.ck", ""])
    assert public_suffixes(suffixes) == ["com", "*.ck"]
