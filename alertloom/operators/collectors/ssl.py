"""TLS sessions: certificates, weak settings, client and server fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertloom import constants as K
from alertloom.functions.text import labels, sentence
from alertloom.operators.collectors.base import evidence_rows, item, position
from alertloom.operators.suffixes import with_domain_parts

SINGLE_KINDS = {
    "server_names": "server_name",
    "tls_versions_used": "version",
    "ciphers_used": "cipher",
    "ja3_details": "ja3",
    "ja3s_details": "ja3s",
}
FINGERPRINTS = "certificate_chain_fingerprints"


def known_hashes(df: DataFrame, intel: dict[str, DataFrame] | None = None) -> DataFrame:
    """Adds `threat_name` to distinct (uid, kind, value) rows.

    By default the built-in tables are looked up as map literals. Larger intelligence comes as
    tables (hash, threat_name) by kind, joined after duplicates are gone.
    """
    kind, value = F.col("kind"), F.col("value")
    if intel is None:
        def known(table: dict[str, str]) -> Column:
            return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[value]

        return df.withColumn(
            "threat_name",
            F.when(kind == "ja3_details", known(K.MALICIOUS_JA3))
            .when(kind == "ja3s_details", known(K.MALICIOUS_JA3S)),
        )
    tables = [t.select(F.lit(k).alias("kind"), F.col("hash").alias("value"), "threat_name")
              for k, t in intel.items()]
    joined = tables[0]
    for t in tables[1:]:
        joined = joined.unionByName(t)
    return df.join(joined.dropDuplicates(["kind", "value"]), ["kind", "value"], "left")


class SslCollector:
    name = "ssl"

    def __init__(self, intel: dict[str, DataFrame] | None = None):
        self.intel = intel

    def prepare(self, rows: DataFrame) -> DataFrame:
        return rows

    def values(self, rows: DataFrame) -> DataFrame:
        """Distinct texts seen in a session: uid, kind, value, threat_name."""
        singles = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("value"))
                   for k, c in SINGLE_KINDS.items()]
        chain = F.transform(
            F.coalesce("cert_chain_fps", F.array().cast("array<string>")),
            lambda v: F.struct(F.lit(FINGERPRINTS).alias("kind"), v.alias("value")),
        )
        seen = (
            rows.select("uid", F.explode(F.concat(F.array(*singles), chain)).alias("v"))
            .select("uid", "v.*").where(F.col("value") != "").distinct()
        )
        return known_hashes(seen, self.intel)

    def totals(self, rows: DataFrame) -> DataFrame:
        """Flags, weak settings and duration of a session; no row without SNI and JA3."""
        status = F.lower("validation_status")
        # Weak settings come from short fixed lists, so these sets stay small.
        flags = rows.groupBy("uid").agg(
            F.coalesce(F.bool_or("established"), F.lit(False)).alias("established"),
            F.sum(F.coalesce(F.col("duration"), F.lit(0.0)).cast("decimal(20,6)"))
            .cast("double").alias("duration"),
            *[F.coalesce(F.bool_or(status.contains(text)), F.lit(False)).alias(issue)
              for issue, text in K.CERTIFICATE_ISSUES.items()],
            F.array_sort(F.collect_set(
                F.when(F.col("version").isin(K.WEAK_PROTOCOLS), F.col("version"))))
            .alias("weak_protocols"),
            F.array_sort(F.collect_set(
                F.when(F.col("cipher").isin(K.WEAK_CIPHERS), F.col("cipher"))))
            .alias("weak_ciphers"),
        )
        kind = F.col("kind")

        def threat(name: str) -> Column:
            hit = (kind == name) & F.col("threat_name").isNotNull()
            return F.min_by("threat_name", F.when(hit, F.col("value"))).alias(f"{name}_threat")

        seen = self.values(rows).groupBy("uid").agg(
            F.bool_or(kind.isin("server_names", "ja3_details")).alias("has_name"),
            threat("ja3_details"), threat("ja3s_details"),
        ).where("has_name")
        return seen.join(flags, "uid")

    def summary(self, totals: DataFrame) -> DataFrame:
        s = totals
        ja3, ja3s = F.col("ja3_details_threat"), F.col("ja3s_details_threat")
        threats = F.array_compact(F.array(
            F.when(ja3.isNotNull(), F.format_string("a JA3 hash matching '%s'", ja3)),
            F.when(ja3s.isNotNull(), F.format_string("a JA3S hash matching '%s'", ja3s)),
        ))
        anomalies = labels(
            (F.col("Self-Signed Certificate"), "a self-signed certificate"),
            (F.col("Untrusted Chain"), "an untrusted certificate chain"),
        )
        weak = (F.size("weak_protocols") > 0) | (F.size("weak_ciphers") > 0)
        assessment = (
            F.when(F.size(threats) > 0,
                   sentence("High Confidence Threat: Session contains malware indicators, "
                            "including ", threats))
            .when(F.size(anomalies) > 0,
                  sentence("Suspicious: Session involves anomalies like ", anomalies))
            .when(weak, "Informational: Session used weak encryption, indicating a policy "
                        "violation.")
            .otherwise("Benign: No significant threat indicators found.")
        )
        issues = labels(*[(F.col(i), i) for i in sorted(K.CERTIFICATE_ISSUES)])

        def filled(array: Column) -> Column:
            return F.when(F.size(array) > 0, array)

        return s.select(
            "uid",
            F.struct(
                assessment.alias("overall_assessment"),
                filled(issues).alias("observed_certificate_issues"),
                filled(F.col("weak_protocols")).alias("observed_weak_protocols"),
                filled(F.col("weak_ciphers")).alias("observed_weak_ciphers"),
                F.when(F.col("established"), "Successful").otherwise("Failed")
                .alias("handshake_status"),
            ).alias("analysis"),
            F.struct(F.round("duration", 4).alias("connection_duration_sec")).alias("statistics"),
            F.struct(F.lit(None).cast("string").alias("none")).alias("context"),
        )

    def evidence(self, rows: DataFrame, totals: DataFrame) -> DataFrame:
        return evidence_rows(
            self.values(rows), "ssl", F.col("kind"), position(),
            item(value=F.col("value"), threat_name=F.col("threat_name")),
        )


def weak_by_table(rows: DataFrame, weak: DataFrame) -> DataFrame:
    """uid, kind, name: the weak protocols and ciphers of each session, from a table (kind, name)."""
    named = rows.select("uid", F.inline(F.array(
        F.struct(F.lit("protocol").alias("kind"), F.col("version").alias("name")),
        F.struct(F.lit("cipher").alias("kind"), F.col("cipher").alias("name")))))
    return named.distinct().join(weak, ["kind", "name"], "left_semi").select("uid", "kind", "name")


def reputation_by_table(hosts: DataFrame, reputation: DataFrame, rules: DataFrame) -> DataFrame:
    """host, reputation of distinct hosts, from a table (kind, name, label) of domains and keywords.

    A listed registered domain decides; else the words of a name do, adware before benign ones.
    `rules` are those of a public suffix list.
    """
    split = with_domain_parts(hosts, "host", rules).withColumn(
        "name", F.concat_ws(".", "parts.domain", "parts.suffix")).drop("parts")
    domains = reputation.where("kind = 'domain'").select("name", F.col("label").alias("_domain"))
    words = split.select("host", F.explode(F.array_union(
        F.split(F.lower("host"), r"\."), F.split(F.lower("host"), "-"))).alias("name"))
    keywords = reputation.where("kind = 'keyword'").select("name", "label")
    # In order of their names, adware comes first.
    by_word = words.join(keywords, "name").groupBy("host").agg(F.min("label").alias("_word"))
    empty = F.coalesce(F.col("host"), F.lit("")) == ""
    return split.join(domains, "name", "left").join(by_word, "host", "left").select(
        "host", F.when(empty, "Unknown").otherwise(
            F.coalesce("_domain", "_word", F.lit("Unknown Reputation"))).alias("reputation"))
