"""Labelled ground truth: flow labels, quota samples, raw alert look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from alertloom import constants as K
from alertloom.functions.text import normal_port
from alertloom.operators.collectors.base import first_n
from alertloom.operators.ingest import last_of_each

TUPLE = ["source_ip", "source_port", "dest_ip", "dest_port", "protocol"]


def flow_labels(flows: DataFrame) -> DataFrame:
    """The distinct labels of each 5-tuple, sorted and joined by commas.

    Labels come from a short list of attack classes, so the sets are small.
    """
    return flows.groupBy(*TUPLE).agg(
        F.array_join(F.array_sort(F.collect_set("original_label")), ", ").alias("original_label")
    )


def protocol_number(transport: Column) -> Column:
    numbers = F.create_map(*[F.lit(x) for kv in K.PROTOCOL_NUMBERS.items() for x in kv])
    return F.coalesce(numbers[F.upper(transport)], F.lit(-1))


def with_full_tuple(alerts: DataFrame) -> DataFrame:
    """Alerts with a complete 5-tuple: no empty address, no zero port, a known protocol."""
    return alerts.withColumn("protocol", protocol_number(F.col("transport"))).where(
        (F.col("source_ip") != "") & (F.col("source_port") != 0)
        & (F.col("dest_ip") != "") & (F.col("dest_port") != 0) & (F.col("protocol") != -1)
    )


def map_alerts(alerts: DataFrame, flows: DataFrame) -> DataFrame:
    """Alerts with the labels of their flow."""
    keyed = with_full_tuple(
        alerts.withColumn("source_port", normal_port(F.col("source_port")).try_cast("int"))
        .withColumn("dest_port", normal_port(F.col("dest_port")).try_cast("int"))
    )
    return keyed.join(flow_labels(flows), TUPLE).select(
        "timestamp", F.col("rule_name").alias("alert_name"),
        F.col("rule_category").alias("category"), F.col("rule_severity").alias("severity"),
        "source_ip", "source_port", F.col("dest_ip").alias("destination_ip"),
        F.col("dest_port").alias("destination_port"), "transport", "original_label",
    )


def shuffle_key(key: str, seed: str = K.SAMPLE_SEED) -> Column:
    """A repeatable random order, the same in any engine with MD5."""
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def quota_sample(mapped: DataFrame, key: str, seed: str = K.SAMPLE_SEED) -> DataFrame:
    """50 benign and 150 attack rows: quotas per class group, then any other attack rows.

    `key` identifies a row. Labels are single texts; joined labels belong to no group. With
    fewer than 150 attack rows all are taken.
    """
    rows = mapped.withColumn("original_label", F.trim("original_label")).withColumn(
        "_draw", shuffle_key(key, seed)
    )
    benign = (
        rows.where(F.col("original_label") == K.BENIGN_LABEL)
        .orderBy("_draw", key).limit(K.FP_SAMPLES)
    )
    attacks = rows.where(F.col("original_label") != K.BENIGN_LABEL)

    group = F.lit(None).cast("string")
    quota = F.lit(None).cast("int")
    for name, (names, n) in K.TP_QUOTAS.items():
        hit = F.col("original_label").isin(names)
        group = F.when(hit, name).otherwise(group)
        quota = F.when(hit, n).otherwise(quota)
    grouped = attacks.withColumn("_group", group).withColumn("_quota", quota)
    most = max(n for _, n in K.TP_QUOTAS.values())
    # Two limits: the constant one is applied before the shuffle, the group's own after it.
    taken = (
        first_n(grouped.where(F.col("_group").isNotNull()), ["_group"], ["_draw", key], most)
        .where(F.col("rn") <= F.col("_quota"))
        .drop("rn", "_group", "_quota")
    )
    rest = (
        attacks.join(taken.select(key), key, "left_anti")
        .orderBy("_draw", key).limit(K.TP_SAMPLES)
        .withColumn("rn", F.row_number().over(Window.orderBy("_draw", key)))
    )
    missing = taken.agg((F.lit(K.TP_SAMPLES) - F.count("*")).alias("missing"))
    # One-row table: the shortfall.
    fill = rest.join(F.broadcast(missing), F.col("rn") <= F.col("missing")).drop("rn", "missing")
    columns = [*mapped.columns, "_draw"]
    both = taken.select(columns).unionByName(fill.select(columns))
    return (
        benign.select(columns).unionByName(both).orderBy("_draw", key).drop("_draw")
    )


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("original_label").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


def with_class(df: DataFrame) -> DataFrame:
    """`classification_label` right after `original_label`; the last column is kept as well."""
    label = F.when(F.col("original_label") == K.BENIGN_LABEL, "FP").otherwise("TP")
    at = df.columns.index("original_label") + 1
    before, after = df.columns[:at], df.columns[at:]
    return df.select(*before, label.alias("classification_label"), *after)


RAW_KEYS = ["timestamp", "rule_name", "source_ip"]


def raw_alert_lookup(sample: DataFrame, alerts: DataFrame, order: list[str]) -> DataFrame:
    """Sampled rows (timestamp, alert_name, source_ip) with their raw alert or null.

    Of several alerts with one key the last wins; alerts with an empty key part are ignored.
    """
    keyed = alerts.where(
        (F.col("timestamp") != "") & (F.col("rule_name") != "") & (F.col("source_ip") != "")
    )
    last = last_of_each(keyed, RAW_KEYS, order)
    raw = last.select(
        *[F.col(k).alias(f"_{k}") for k in RAW_KEYS], F.struct(*last.columns).alias("raw_alert")
    )
    return sample.join(
        raw,
        (sample["timestamp"] == F.col("_timestamp")) & (sample["alert_name"] == F.col("_rule_name"))
        & (sample["source_ip"] == F.col("_source_ip")),
        "left",
    ).drop(*[f"_{k}" for k in RAW_KEYS])


def lookup_counts(looked_up: DataFrame) -> DataFrame:
    missing = F.col("raw_alert").isNull()
    return looked_up.agg(
        F.count_if(~missing).alias("n_found"), F.count_if(missing).alias("n_missing")
    )
