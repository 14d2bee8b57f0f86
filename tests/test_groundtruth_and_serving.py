import json

from pyspark.sql import functions as F

from alertloom import constants as K
from alertloom.operators import groundtruth as G, serving as S, verdicts as V
from alertloom.operators.ingest import last_of_each


def test_flow_labels_are_sorted(spark):
    flows = spark.createDataFrame([("a", 1, "b", 2, 6, "B"), ("a", 1, "b", 2, 6, "A"),
                                   ("a", 1, "b", 2, 6, "B")],
                                  "source_ip string, source_port int, dest_ip string, "
                                  "dest_port int, protocol int, original_label string")
    assert [r["original_label"] for r in G.flow_labels(flows).collect()] == ["A, B"]
    alerts = spark.createDataFrame(
        [("t", "a", "1.0", "b", 2, "TCP"), ("t", "a", "0", "b", 2, "TCP"),
         ("t", "a", "1", "b", 2, "gre"), ("t", None, "1", "b", 2, "TCP")],
        "timestamp string, source_ip string, source_port string, dest_ip string, dest_port int, "
        "transport string").selectExpr("*", "'n' rule_name", "'c' rule_category",
                                       "'1' rule_severity")
    assert G.map_alerts(alerts, flows).count() == 1


def sample(spark, counts):
    rows = [(f"{label}-{i}", label) for label, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id string, original_label string")
    got = G.quota_sample(df, "id").collect()
    assert len({r["id"] for r in got}) == len(got)
    by = {}
    for r in got:
        by[r["original_label"]] = by.get(r["original_label"], 0) + 1
    return by


def test_quotas_and_fill(spark):
    got = sample(spark, {"BENIGN": 80, "Bot": 100, "DDoS": 100, "SSH-Patator": 5, "DDoS, X": 100,
                         "Web Attack - XSS": 60})
    assert got["BENIGN"] == 50 and sum(got.values()) == 200
    assert got["SSH-Patator"] == 5
    assert got["Bot"] >= 30 and got["DDoS"] >= 55 and got["Web Attack - XSS"] >= 45
    # 45 + 30 + 5 + 55 are quotas; the other 15 come from any attack rows.
    assert sum(n for k, n in got.items() if k != "BENIGN") == 150


def test_few_attacks_are_all_taken(spark):
    got = sample(spark, {"BENIGN": 10, "Bot": 60, "Odd": 20})
    assert got == {"BENIGN": 10, "Bot": 60, "Odd": 20}


def test_class_column_position(spark):
    df = spark.createDataFrame([(1, "BENIGN", 2), (1, "Bot", 2)], "a int, original_label string, z int")
    out = G.with_class(df)
    assert out.columns == ["a", "original_label", "classification_label", "z"]
    assert [r["classification_label"] for r in out.collect()] == ["FP", "TP"]


def test_raw_lookup_last_wins(spark):
    alerts = spark.createDataFrame([("t", "r", "s", 1), ("t", "r", "s", 2), ("t", "", "s", 3)],
                                   "timestamp string, rule_name string, source_ip string, n int")
    wanted = spark.createDataFrame([("t", "r", "s"), ("t", "", "s"), ("u", "r", "s")],
                                   "timestamp string, alert_name string, source_ip string")
    found = G.raw_alert_lookup(wanted, alerts, ["n"])
    assert sorted(r["raw_alert"]["n"] for r in found.where("raw_alert is not null").collect()) == [2]
    assert tuple(G.lookup_counts(found).first()) == (1, 2)


def view(spark, n=45):
    alerts = spark.range(n).select(
        F.col("id").alias("alert_index"), F.lit("2024-05-01T00:00:00Z").alias("timestamp"),
        F.when(F.col("id") % 2 == 0, "Scan A").alias("rule_name"),
        F.concat(F.lit("10.0.0."), F.col("id").cast("string")).alias("source_ip"),
        *[F.lit(None).cast("string").alias(c) for c in ("source_port", "dest_ip", "dest_port")])
    analyses = spark.createDataFrame(
        [(1, 1, "False Positive"), (1, 2, "True Positive"), (3, 1, None)],
        "alert_index long, processed_at int, c string").withColumn(
        "llm_analysis", F.struct(F.struct(F.struct(
            F.col("c").alias("classification"), F.lit("why").alias("reasoning_summary"))
            .alias("conclusion")).alias("result")))
    return S.triage_view(alerts, analyses)


def test_triage_view_takes_the_last_analysis_and_defaults(spark):
    rows = {r["alert_index"]: r for r in view(spark).collect()}
    assert (rows[0]["llm_verdict"], rows[0]["reasoning_summary"]) == ("True Positive", "why")
    assert rows[1]["llm_verdict"] == "Pending" and rows[1]["alert_name"] == "N/A"
    assert rows[1]["reasoning_summary"] == "No summary available."
    assert rows[2]["llm_verdict"] == "Pending" and rows[2]["reasoning_summary"] == "why"
    assert rows[1]["unique_id"] == "2024-05-01T00:00:00Z-1"
    assert json.loads(rows[1]["llm_result_json"]) == {"status": "Pending Analysis"}


def test_search_and_pages(spark, monkeypatch):
    v = view(spark)
    assert S.search(v, "SCAN").count() == 23 and S.search(v, "10.0.0.4").count() == 6
    assert S.search(v, "", "True Positive").count() == 1
    assert tuple(S.result_size(v).first()) == (45, 3)
    assert tuple(S.result_size(v.where("false")).first()) == (0, 1)
    early = [[r["alert_index"] for r in S.page(v, p).collect()] for p in (1, 2, 3, 9)]
    assert early == [list(range(44, 24, -1)), list(range(24, 4, -1)), [4, 3, 2, 1, 0],
                     [4, 3, 2, 1, 0]]
    assert S.page(v, 1, ground_truth=True).first()["alert_index"] == 0
    monkeypatch.setattr(S, "BLOCK_ROWS", 7)
    assert [[r["alert_index"] for r in S.page(v, p).collect()] for p in (1, 2, 3, 9)] == early


def docs(spark):
    return spark.createDataFrame(
        [(1, 0, "sig", False, False, "{}"), (2, 0, None, True, False, '{"alert":{}}')],
        "alert_index long, part int, rule_name string, has_connection boolean, "
        "has_evidence boolean, document string").withColumn("alert_id", F.col("alert_index"))


def test_default_verdicts(spark):
    row = V.default_analyses(docs(spark)).collect()
    assert [r["alert_index"] for r in row] == [1]
    result = row[0]["llm_analysis"]["result"]
    assert result["conclusion"]["classification"] == "False Positive"
    assert result["reasoning"]["analyze_alert"].startswith("The alert signature 'sig' suggests")


def test_requests_and_responses(spark):
    requests = V.request_rows(docs(spark), "m", "system text", "# CONTEXT\n{{ENRICHED_PROMPT}}\n")
    body = json.loads(requests.first()["request"])
    assert body["messages"][0] == {"role": "system", "content": "system text"}
    assert '# CONTEXT\n{"alert":{}}\n' in body["messages"][1]["content"]
    assert body["max_tokens"] == K.REQUEST_MAX_TOKENS and body["stream"] is False
    assert V.classify(requests).first()["response"] is None

    def answer(batches):
        for pdf in batches:
            yield pdf[["alert_id", "part"]].assign(
                response='```json\n{"result": {"conclusion": {"classification": "True Positive", '
                         '"confidence_score": 1}}}\n```')

    parsed = V.parse_responses(V.classify(requests, answer))
    conclusion = parsed.first()["llm_analysis"]["result"]["conclusion"]
    assert conclusion["classification"] == "True Positive" and conclusion["confidence_score"] == 1.0
    bad = V.parse_responses(spark.createDataFrame([("no json",), ("{oops}",)], "response string"))
    assert sorted(str(r["block"]) for r in V.unreadable(bad).collect()) == ["None", "{oops}"]


def test_last_of_each(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c")], "k int, o int, v string")
    assert sorted(r["v"] for r in last_of_each(df, ["k"], ["o"]).collect()) == ["b", "c"]
