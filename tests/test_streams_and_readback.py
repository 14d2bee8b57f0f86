"""Streams that remember or set lines aside, files read on, documents read back, stored pages."""

import json

import pytest
from pyspark.sql import functions as F

from alertloom.operators.readback import PUBLISHED, INTENDED, document_levels, evidence_rows, path_values
from alertloom.operators.serving import store_result, stored_page
from alertloom.plans.answers import answer_alerts
from alertloom.sources.alerts import read_analyses
from alertloom.sources.discovery import sync_lines
from alertloom.operators.verdicts import classify
from alertloom.streaming import connect
from alertloom.streaming.connect import start_connect
from alertloom.streaming.ingest import alert_lines, append_new, start_dedup, start_ingest, start_intake
from tests.test_match import CONN, S, T0, conn

FLAT = ("alert_id string, timestamp string, source_ip string, source_port string, dest_ip string, dest_port string, "
        "rule_name string")


def flat(i, timestamp, port="1"):
    return (f"a{i}", timestamp, "1.1.1.1", port, "2.2.2.2", "2", f"rule {i}")


BATCHES = [
    [flat(1, "2024-01-01 00:00:00"), flat(1, "2024-01-01 00:00:00"), flat(2, "no time"), flat(3, None)],
    [flat(1, "2024-01-01 00:00:00", "1.0"), flat(2, "no time"), flat(3, None), flat(4, "2030-01-01 00:00:00")],
    [flat(5, "1999-01-01 00:00:00"), flat(4, "2030-01-01 00:00:00")],
]


@pytest.mark.parametrize("start", [start_dedup, start_ingest])
def test_each_alert_is_logged_once_over_runs(spark, tmp_path, start):
    into, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    for batch in BATCHES:
        spark.createDataFrame(batch, FLAT).coalesce(1).write.mode("append").parquet(into)
        start(spark.readStream.schema(FLAT).parquet(into), log, state, once=True).awaitTermination()
    rows = spark.read.parquet(log).collect()
    assert sorted(r["alert_id"] for r in rows) == ["a1", "a2", "a3", "a4", "a5"]
    assert sorted(str(r["local_day"]) for r in rows) == ["1999-01-01", "2024-01-01", "2030-01-01", "None", "None"]


def test_a_cycle_run_again_adds_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.createDataFrame([], "alert_hash string, local_day date").write.partitionBy("local_day").parquet(log)
    for _ in range(2):
        append_new(spark.createDataFrame(BATCHES[0], FLAT), log)
    assert spark.read.parquet(log).count() == 3


def test_lines_are_alerts_or_in_quarantine(spark, tmp_path):
    into = tmp_path / "in"
    into.mkdir()
    good = json.dumps({"@timestamp": "t", "message": '{"timestamp": "2024-01-01T07:00:00+07:00", "proto": "UDP"}'})
    (into / "a.json").write_text(f'{good}\n\n{{"broken\nnot json\n{good}\n')
    alerts, bad, state = (str(tmp_path / n) for n in ("alerts", "bad", "state"))
    for more in ("", f"[1\n{good}\n"):
        if more:
            (into / "b.json").write_text(more)
        start_intake(alert_lines(spark, str(into)), alerts, bad, state, once=True).awaitTermination()
    rows = spark.read.parquet(alerts).collect()
    assert [(r["transport"], r["event_us"]) for r in rows] == [("udp", 1_704_067_200_000_000)] * 3
    assert sorted(r["_corrupt_record"] for r in spark.read.parquet(bad).collect()) == ["[1", "not json", '{"broken']


def test_two_streams_match_like_tables(spark, tmp_path):
    conns = [conn("short", "c", 1, 1, 1.0), conn("long", "c", 2, 2, 9.0), conn("long", "c", 600, 3, 1.0),
             conn("far", "c", 661, 4, 99.0), conn(None, "d", 1, 5, 9.0), conn("e", "d", 1, 6, 1.0)]
    alerts = [(1, T0, "c"), (2, T0, "d"), (3, T0, ""), (4, None, "c"), (5, T0 + S, "none")]
    last = 86400
    for i, (a, c) in enumerate([(alerts[:2], conns[:1]), (alerts[2:], conns[1:]),
                                ([(9, T0 + last * S, "x")], [conn("z", "y", last, 9)])]):
        spark.createDataFrame(a, "alert_id long, event_us long, community_id string").write.mode("append").parquet(str(tmp_path / "a"))
        spark.createDataFrame(c, CONN).write.mode("append").parquet(str(tmp_path / "c"))
        start_connect(spark.readStream.schema("alert_id long, event_us long, community_id string").parquet(str(tmp_path / "a")),
                      spark.readStream.schema(CONN).parquet(str(tmp_path / "c")), str(tmp_path / "out"),
                      str(tmp_path / "state"), once=True).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "long", 3)]


def test_files_are_read_on_from_where_they_ended(spark, tmp_path):
    root, manifest, out = tmp_path / "logs", str(tmp_path / "manifest"), str(tmp_path / "out")
    (root / "day").mkdir(parents=True)
    a, b, c = (root / "day" / n for n in ("a.log", "b.log", "c c.log"))

    def run(expected):
        n = sync_lines(spark, str(root), "*.log", manifest, out)
        assert sorted(r["value"] for r in spark.read.parquet(out).where(f"run = {n}").collect()) == sorted(expected)
        return n

    a.write_bytes("ä1\na2\na3 is cu".encode())
    b.write_bytes(b"b1\r\n\nb3\n")
    assert run(["ä1", "a2", "b1\r", "", "b3"]) == 0
    a.write_bytes("ä1\na2\na3 is cut\n".encode())
    c.write_bytes(b"c1\n")
    assert run(["a3 is cut", "c1"]) == 1
    assert sync_lines(spark, str(root), "*.log", manifest, out) == 1  # nothing new
    b.write_bytes(b"n1\n")  # another, shorter file
    assert run(["n1"]) == 2
    long = [f"line {i} " + "x" * (i % 50) for i in range(4000)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several splits
    try:
        c.write_text("c1\n" + "\n".join(long) + "\n")
        assert run(long) == 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


DOCUMENT = {"alert": {"signature": "s"}, "evidence": {
    "high": {"dns": {"analysis": {"observed_query_pattern": "High Entropy (DGA-like)"},
                     "evidence": {"findings": [{"type": "T", "source": "q", "reasons": ["r1", "r2"]}]}}},
    "medium": {"files": {"analysis": {"highest_threat_level": "High"}, "statistics": {"suspicious_files_count": 2},
                         "evidence": {"findings": [{"reasons": ["HIGH_ENTROPY"], "risk_score": 95}, {"reasons": []}]}}},
    "reference": {"http": {"analysis": {}, "evidence": {"connection_context": {"methods_used": ["GET"], "user_agent_string": "x"}}},
                  "ssl": {"analysis": {}, "evidence": {"ja3_details": [{"hash": "h", "threat_name": None}], "server_names": ["n"]}}}}}


def docs_of(spark):
    rows = [(1, json.dumps(DOCUMENT)), (2, json.dumps({"alert": {}})), (3, "{cut"), (4, None)]
    return spark.createDataFrame(rows, "alert_id long, document string")


def test_evidence_is_read_back(spark):
    got = {(r["alert_id"], r["level"], r["collector"], r["kind"], r["place"], r["value"]) for r in evidence_rows(docs_of(spark)).collect()}
    assert got == {
        (1, "high", "dns", "findings", 0, "T|q|r1,r2"), (1, "medium", "files", "findings", 0, "HIGH_ENTROPY"),
        (1, "medium", "files", "findings", 1, ""), (1, "reference", "http", "methods_used", 0, "GET"),
        (1, "reference", "ssl", "ja3_details", 0, "h"), (1, "reference", "ssl", "server_names", 0, "n")}


def test_paths_with_wildcards(spark):
    value = F.parse_json(F.lit(json.dumps({"a": [{"b": [{"c": 1}, {"c": 2}]}, {"b": 7}, {}], "d": {"e": "x"}})))
    for path, want in {"a[*].b[*].c": ["1", "2"], "d.e": ["x"], "a[*].z": [], "d[*].e": [], "q.r": []}.items():
        got = spark.range(1).select(F.transform(path_values(value, path), lambda v: v.cast("string")).alias("v")).first()["v"]
        assert got == want, path


def test_wildcard_rules_hold_only_as_intended(spark):
    levels = {m: {r["alert_id"]: (r["dns_level"], r["files_level"], r["http_level"]) for r in document_levels(docs_of(spark), mode=m).collect()}
              for m in (PUBLISHED, INTENDED)}
    assert levels[PUBLISHED] == {1: ("high", "medium", "reference")}
    assert levels[INTENDED] == {1: ("high", "critical", "reference")}


def test_pages_of_a_stored_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("alertloom.operators.serving.BLOCK_ROWS", 30)
    path = str(tmp_path / "result")
    store_result(spark.range(205).withColumnRenamed("id", "alert_index"), path)
    for number, first in ((1, 204), (2, 184), (6, 104), (11, 4), (99, 4), (0, 204)):
        rows = [r["alert_index"] for r in stored_page(spark, path, number).collect()]
        assert rows == list(range(first, max(first - 20, -1), -1))
    plan = stored_page(spark, path, 6)
    assert len(plan.inputFiles()) > 0 and "PartitionFilters: [isnotnull(block" in plan._jdf.queryExecution().executedPlan().toString()
    store_result(spark.range(0).withColumnRenamed("id", "alert_index"), path)
    assert stored_page(spark, path, 3).count() == 0


def test_an_answer_counts_once_and_the_rest_is_kept(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, 0, f"rule {i}", i > 1, False, "{}") for i in range(1, 6)],
        "alert_index long, part int, rule_name string, has_connection boolean, has_evidence boolean, document string")

    def classifier(batches):
        said = {2: '{"result": {"conclusion": {"classification": "True Positive"}}}', 3: "no idea", 4: '{"result": 1}', 5: None}
        for batch in batches:
            yield batch.drop(columns="request").assign(response=batch["alert_index"].map(said))

    for _ in range(2):
        answer_alerts(docs, classifier, "system", "{{ENRICHED_PROMPT}}", str(tmp_path / "out"), str(tmp_path / "bad"), "r")
    records = {r["alert_index"]: r["llm_analysis"]["result"]["conclusion"]["classification"]
               for r in read_analyses(spark, str(tmp_path / "out")).collect()}
    assert records == {1: "False Positive", 2: "True Positive"}
    bad = spark.read.schema("alert_index long, response string, block string").json(str(tmp_path / "bad")).collect()
    assert sorted((r["alert_index"], r["block"]) for r in bad) == [(3, None), (4, '{"result": 1}'), (5, None)]


def test_streams_that_come_late_or_run_again(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    spark.createDataFrame([], "alert_id long, uid string, conn_row long").write.parquet(out)
    spark.createDataFrame([], connect.BEGUN).write.parquet(f"{state}/begun")
    batches = [
        # Two keys of one alert: the longest connection of both; copies of an alert are one, no id is an id.
        ([(1, T0, "c"), (1, T0, "d"), (1, T0, "c"), (None, T0, "d")],
         [conn("a", "c", 1, 1, 1.0), conn("b", "d", 2, 2, 5.0), conn("b", "c", 9, 3, 0.0)]),
        ([(2, T0 + 2000 * S, "c")], [conn("z", "c", 2000, 4)]),
        ([(3, T0, "c"), (4, T0 + 1900 * S, "c")], [conn("late", "c", 3, 5, 99.0), conn("y", "c", 9000, 6)]),
        ([(5, T0 + 9000 * S, "x")], [conn("x", "y", 9000, 7)]),
    ]
    for i, (a, c) in enumerate(batches):
        both = connect.arrivals(spark.createDataFrame(a, "alert_id long, event_us long, community_id string"),
                                spark.createDataFrame(c, CONN))
        for _ in range(2):  # the rerun answers nothing twice
            connect.connect_batch(both, i, out, state)
    rows = sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str)
    assert rows == [(1, "b", 3), (2, "z", 4), (4, "z", 4), (None, "b", 2)]


def test_stream_state_grows_with_rows_not_with_pairs(spark):
    asked = spark.range(400).selectExpr("id as alert_id", "'c' as key", f"{T0} + id * 1000 as at_us")
    seen = spark.range(4000).selectExpr("'c' as key", f"{T0} + id * 1000 as ts_us", "cast(id % 7 as string) as uid",
                                        "id as row_id", "cast(id % 1000 as double) as duration")
    got = connect.connected(asked, seen)
    assert {tuple(r)[1:] for r in got.collect()} == {("5", 3999 - (3999 - 5) % 7)}



def test_batches_of_a_classifier_are_bounded_by_bytes(spark):
    requests = spark.range(0, 60, 1, 1).selectExpr("id as alert_id", "repeat('x', 1000000) as request")

    def sizes(batches):
        for batch in batches:
            yield batch.drop(columns="request").assign(response=str(len(batch)))

    assert max(int(r["response"]) for r in classify(requests, sizes).collect()) <= 8


def test_rules_are_asked_before_the_shuffle(spark):
    plan = document_levels(docs_of(spark))._jdf.queryExecution().optimizedPlan().toString()
    shuffled = plan[plan.index("Aggregate"):].split("\n")[0]
    assert "block" not in shuffled and "rules" in shuffled


def test_texts_are_read_back_in_one_pass(spark):
    assert "Union" not in evidence_rows(docs_of(spark))._jdf.queryExecution().optimizedPlan().toString()
