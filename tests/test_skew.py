"""Hot keys: results stay whole, and groupings combine before they shuffle."""

from pyspark.sql import functions as F

from alertloom.operators.collectors.dns import DnsCollector
from alertloom.operators.collectors.http import HttpCollector
from alertloom.operators.documents import sessions
from alertloom.operators.match import match_alerts
from alertloom.plans.views import view
from alertloom.session import stage

DATA = "/root/testdata/sf0.001"


def hot(df, column, value):
    """A third of all rows under one key."""
    return df.withColumn(column, F.when(F.col("row_id") % 3 == 0, value).otherwise(F.col(column)))


def test_hot_community_and_bucket(spark):
    conn = view(spark, DATA, "v_conn")
    # A third of the connections share one id and one instant, and so do many alerts.
    at = conn.agg(F.max("ts_us")).first()[0]
    packed = stage(
        hot(conn, "community_id", "1:hot").withColumn(
            "ts_us", F.when(F.col("community_id") == "1:hot", at).otherwise(F.col("ts_us"))),
        "packed")
    alerts = view(spark, DATA, "v_alerts").withColumn(
        "community_id", F.lit("1:hot")).withColumn("event_us", F.lit(at))
    got = match_alerts(alerts, packed).select("alert_id", "uid", "conn.row_id").collect()
    best = packed.where("community_id = '1:hot'").select(
        F.max_by("uid", F.struct(F.expr("coalesce(nullif(duration, 0), -1)"), -F.col("row_id"))),
    ).first()[0]
    last = packed.where((F.col("community_id") == "1:hot") & (F.col("uid") == best)).agg(
        F.max("row_id")).first()[0]
    assert len(got) == alerts.count()
    assert {(r["uid"], r["row_id"]) for r in got} == {(best, last)}


def test_hot_session_keeps_all_evidence(spark):
    logs = {n: view(spark, DATA, f"v_{n}") for n in ("http", "dns", "ssl", "files")}
    logs["http"] = HttpCollector().prepare(logs["http"])
    logs = {n: stage(df.withColumn("uid", F.lit("C0")), n) for n, df in logs.items()}
    collector = DnsCollector()
    want = collector.evidence(logs["dns"], collector.totals(logs["dns"])).count()
    rows = sessions(spark.createDataFrame([("C0",)], "uid string"), logs, limit=50).collect()
    assert len(rows) == rows[0]["parts"] > 1
    assert sum(i["collector"] == "dns" for r in rows for i in r["items"]) == want > 50


def test_totals_combine_before_the_shuffle(spark):
    for collector, name in ((HttpCollector(), "v_http"), (DnsCollector(), "v_dns")):
        plan = collector.totals(
            collector.prepare(view(spark, DATA, name)))._jdf.queryExecution().executedPlan()
        text = plan.toString()
        assert "partial_" in text and "collect_list" not in text


def test_matching_plan_salts_and_combines(spark):
    conn = stage(view(spark, DATA, "v_conn"), "conn")
    text = match_alerts(view(spark, DATA, "v_alerts"), conn)._jdf.queryExecution(
        ).executedPlan().toString()
    assert "_salt" in text and "partial_max" in text
