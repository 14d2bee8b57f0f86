"""Reference tables: threat intelligence, weak settings, reputation, public suffixes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from alertloom import constants as K


def intel_table(spark: SparkSession, hashes: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(hashes.items()), "hash STRING, threat_name STRING")


def ja3_intel(spark: SparkSession) -> DataFrame:
    return intel_table(spark, K.MALICIOUS_JA3)


def ja3s_intel(spark: SparkSession) -> DataFrame:
    return intel_table(spark, K.MALICIOUS_JA3S)


def weak_settings(spark: SparkSession) -> DataFrame:
    rows = [("protocol", p) for p in K.WEAK_PROTOCOLS] + [("cipher", c) for c in K.WEAK_CIPHERS]
    return spark.createDataFrame(rows, "kind STRING, name STRING")


def reputation_table(spark: SparkSession) -> DataFrame:
    rows = [("domain", d, label) for d, label in K.TRUSTED_DOMAINS.items()]
    rows += [("keyword", w, "Adware/Tracker") for w in K.ADWARE_KEYWORDS]
    rows += [("keyword", w, "Likely Benign Infrastructure") for w in K.BENIGN_KEYWORDS]
    return spark.createDataFrame(rows, "kind STRING, name STRING, label STRING")


def public_suffixes(path: str) -> list[str]:
    """Rules of a public suffix list file, for `domain_parts`; a list of some ten thousand."""
    with open(path, encoding="utf-8") as lines:
        stripped = (line.strip() for line in lines)
        return [s for s in stripped if s and not s.startswith("//")]


#: The list that Spark's own libraries carry, and the line that opens its part of private domains.
SUFFIX_RESOURCE = "mozilla/public-suffix-list.txt"
PRIVATE_SUFFIXES = "===BEGIN PRIVATE DOMAINS==="


def suffix_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """rule: the registries' rules of a public suffix list, from a file that Spark reads.

    Without a path it is the list on the class path of Spark. Some ten thousand short rows.
    """
    if path is not None:
        text = spark.read.text(path, wholetext=True).first()["value"]
    else:
        loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
        found = loader.getResourceAsStream(SUFFIX_RESOURCE)
        if found is None:
            raise FileNotFoundError(f"{SUFFIX_RESOURCE} is not on the class path: name a list by path")
        text = bytes(found.readAllBytes()).decode()
    lines = text.partition(PRIVATE_SUFFIXES)[0].splitlines()
    kept = [(line.strip(),) for line in lines if line.strip() and not line.startswith("//")]
    return spark.createDataFrame(kept, "rule STRING")


def read_rules(spark: SparkSession, path: str) -> list[tuple[str, str, str, str, object]]:
    """Severity rules from a JSON file that Spark reads: {level: [{collector, path, check, value}, ...]}."""
    by_level = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    return [
        (level.lower(), r["collector"], r["path"], r["check"], r["value"])
        for level, rules in by_level.items() for r in rules
    ]
