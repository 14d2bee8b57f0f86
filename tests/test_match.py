import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators.band import band_best
from alertloom.operators.match import match_alerts, session_rows

CONN = ("uid string, community_id string, ts_us long, row_id long, orig_h string, orig_p int, "
        "resp_h string, resp_p int, proto string, service string, conn_state string, "
        "duration double, orig_bytes long, resp_bytes long")
ALERT = ("alert_id long, event_us long, community_id string, source_ip string, source_port string,"
         " dest_ip string, dest_port string, transport string")
S = 1_000_000
T0 = 1_700_000_000 * S


def conn(uid, cid, offset_s, row, duration=1.0, tup=("1.1.1.1", 1, "2.2.2.2", 2, "tcp")):
    return (uid, cid, T0 + int(offset_s * S), row, *tup, None, "SF", duration, 1, 1)


def alert(i, cid, offset_s=0.0, tup=("1.1.1.1", "1.0", "2.2.2.2", "2", "TCP")):
    us = None if offset_s is None else T0 + int(offset_s * S)
    return (i, us, cid, *tup)


def matched(spark, alerts, conns):
    out = match_alerts(spark.createDataFrame(alerts, ALERT), spark.createDataFrame(conns, CONN))
    return {r["alert_id"]: (r["uid"], r["conn"]["row_id"], r["matched_by"])
            for r in out.collect()}


def test_band_is_open(spark):
    conns = [conn(f"u{i}", f"c{i}", off, i)
             for i, off in enumerate([-660.0, -659.9, 659.9, 660.0, 0.0])]
    got = matched(spark, [alert(i, f"c{i}") for i in range(5)], conns)
    assert sorted(got) == [1, 2, 4]


def test_longest_duration_wins_and_first_seen_breaks_ties(spark):
    conns = [conn("null", "c", 1, 1, None), conn("zero", "c", 2, 2, 0.0),
             conn("first", "c", 3, 3, 5.0), conn("second", "c", 4, 4, 5.0)]
    assert matched(spark, [alert(1, "c")], conns)[1] == ("first", 3, "community")


def test_last_row_of_the_uid_describes_the_connection(spark):
    conns = [conn("u", "c", 1, 1, 9.0), conn("u", "c", 2, 2, 1.0), conn("u", "c", 700, 3, 1.0),
             conn("v", "c", 3, 4, 2.0)]
    assert matched(spark, [alert(1, "c")], conns)[1] == ("u", 2, "community")


def test_fallback_only_without_any_community_row(spark):
    conns = [conn("far", "c1", 1500, 1), conn("near", "other", 10, 2)]
    got = matched(spark, [alert(1, "c1"), alert(2, "nowhere"), alert(3, None), alert(4, ""),
                          alert(5, "nowhere", None)], conns)
    # Alert 1 has a raw hit outside the band, in an hour of it, so its 5-tuple is not asked for.
    assert got == {i: ("near", 2, "tuple") for i in (2, 3, 4)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_band_best_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    half = rng.choice([7, 50, 660]) * S
    # One key holds most rows, and many rows share an instant or a cell.
    instants = [rng.randrange(0, 20 * half) for _ in range(30)]
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b"]),
             rng.choice(instants) + rng.choice([0, 0, half, -half, half - 1, 1, rng.randrange(3 * S)]),
             rng.randrange(1000)) for _ in range(600)]
    probes = list({(rng.choice(["hot", "hot", "a", "z"]),
                    rng.choice(instants) + rng.choice([0, 1, half, rng.randrange(half)]))
                   for _ in range(150)})
    want = {}
    for k, at in probes:
        held = [v for (rk, t, v) in rows if rk == k and abs(t - at) < half]
        if held:
            want[(k, at)] = max(held)
    df = spark.createDataFrame(rows, "k string, ts_us long, v int").select(
        "k", "ts_us", F.struct("v").alias("cand"))
    points = spark.createDataFrame(probes, "k string, at_us long")
    got = band_best(points, df, ["k"], half).collect()
    assert {(r["k"], r["at_us"]): r["best"]["v"] for r in got} == want


def test_session_rows_keeps_every_row_of_a_hot_uid(spark):
    log = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("hot").alias("uid"),
        F.col("id").alias("row_id"))
    uids = spark.createDataFrame([("hot",), ("hot",), ("3",)], "uid string")
    assert session_rows(log, uids).count() == log.where("uid in ('hot', '3')").count()
