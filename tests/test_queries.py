"""Every registered query against its SQL, the invariants of documents, and plan checks."""

import json
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from alertloom.functions.text import CONTENT_REASONS
from alertloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "pages", "labels", "conversations", "orders", "customer", "nation"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    number = float(value)
    return None if math.isnan(number) else round(number, 9)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = entry_module.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = db.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    assert got == want and got


def test_all_but_the_nested_documents_have_sql():
    assert set(QUERIES) - set(entry_module.oracle_sql()) == {"triage_documents"}


def test_document_invariants(spark):
    rows = entry_module.entry(spark).collect()
    assert rows
    for row in rows:
        doc = json.loads(row["document"])
        if "connection" in doc:
            analysis = doc["connection"]["analysis"]
            failed = bool(re.search("state '(S[0-3]|REJ)'", analysis["overall_assessment"]))
            assert analysis["overall_assessment"].startswith("Suspicious") == failed
            flow = analysis["flow_ratio"]
            if flow["download_bytes"] <= 0:
                assert flow["ratio"] == "N/A"
            else:
                assert abs(flow["ratio"] - flow["upload_bytes"] / flow["download_bytes"]) <= 0.05001
        else:
            assert "evidence" not in doc
        for level, found in doc.get("evidence", {}).items():
            for collector, payload in found.items():
                assert row[f"{collector}_level"] == level
                findings = payload["evidence"].get("findings", [])
                if collector == "http":
                    reasons = {r for f in findings for r in f.get("reasons", [])}
                    assert payload["analysis"]["observed_content_patterns"] == (
                        sorted(reasons) or ["None"])
                    assert reasons <= set(CONTENT_REASONS)
                    for f in findings:
                        if f["type"] == "AggregatedContentFinding":
                            assert f["count"] > 3 and len(f["examples"]) == 3
                if collector == "ssl":
                    assert {"server_names", "ja3_details"} & set(payload["evidence"])


@pytest.mark.parametrize("name", ["alert_conn_match", "http_assessment", "dns_assessment",
                                  "ssl_assessment", "files_rollup", "triage_documents",
                                  "map_alert_labels", "triage_view", "alert_dedup_hash"])
def test_plans_stay_in_the_jvm_and_join_on_keys(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan, word


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["alert_day_counts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "props" not in schema and "value" not in schema


def test_top_n_is_cut_before_the_shuffle(spark):
    from alertloom.operators.collectors.base import first_n

    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = first_n(df, ["k"], ["id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan.split("Exchange hashpartitioning")[1]
