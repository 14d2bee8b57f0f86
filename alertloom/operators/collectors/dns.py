"""DNS sessions: query statistics and anomalies."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from alertloom import constants as K
from alertloom.functions.network import domain_parts
from alertloom.functions.text import labels, percent_text, sentence, shannon_entropy
from alertloom.operators.collectors.base import (
    LAST, arrival, evidence_rows, first_value, item, position,
)
from alertloom.operators.match import session_rows
from alertloom.operators.suffixes import with_domain_parts
from alertloom.sources.refdata import suffix_rules


def query_signs(df: DataFrame, suffixes: Iterable[str] | DataFrame | None = None) -> DataFrame:
    """Adds what a query name alone shows: `suffix`, `bad_tld`, `long_query`, `entropy`, `dga`.

    `suffixes` are the rules of a public suffix list: a table (column `rule`), or a few texts.
    """
    rules = suffix_rules(df.sparkSession) if suffixes is None else suffixes
    if isinstance(rules, DataFrame):
        named = with_domain_parts(df, "query", rules, "_parts")
    else:
        named = df.withColumn("_parts", domain_parts(F.col("query"), rules))
    return (
        named.withColumn("suffix", F.col("_parts.suffix"))
        .withColumn("bad_tld", F.coalesce(F.col("suffix").isin(K.DNS_SUSPICIOUS_TLDS), F.lit(False)))
        .withColumn("long_query", F.coalesce(F.length("query") > K.DNS_LONG_QUERY, F.lit(False)))
        .withColumn("entropy", shannon_entropy(F.col("_parts.subdomain")))
        .withColumn("dga", F.coalesce(F.col("entropy") > K.DNS_HIGH_ENTROPY, F.lit(False)))
        .drop("_parts")
    )


def failed():
    return F.col("rcode_name").isin(K.DNS_FAILURE_CODES)


class DnsCollector:
    name = "dns"

    def __init__(self, suffixes: Iterable[str] | DataFrame | None = None):
        self.suffixes = suffixes

    def prepare(self, rows: DataFrame) -> DataFrame:
        return rows

    def queries(self, rows: DataFrame) -> DataFrame:
        """One row per session and distinct query (null for rows without one)."""
        return rows.groupBy("uid", F.expr("nullif(query, '')").alias("query")).agg(
            F.count("*").alias("n"),
            F.count_if(failed()).alias("n_failed"),
            F.min("ts_us").alias("first_seen"),
        )

    def totals(self, rows: DataFrame) -> DataFrame:
        """All counts and flags of a session, with `is_reported`: whether any anomaly holds."""
        # Name checks run once per distinct query, not once per row.
        counts = query_signs(self.queries(rows), self.suffixes).groupBy("uid").agg(
            F.sum("n").alias("total_queries"),
            F.count("query").alias("distinct_queries"),
            F.sum("n_failed").alias("failed_queries"),
            F.bool_or("bad_tld").alias("suspicious_tld"),
            F.bool_or("dga").alias("dga"),
            F.bool_or(F.col("query").isNotNull() & (F.col("n") >= K.DNS_REPEATED_QUERY))
            .alias("repetitive"),
        )
        low = F.get(F.filter("ttls", lambda t: t < K.DNS_LOW_TTL), F.lit(0)).cast("long")
        context = rows.withColumn("_low", low).groupBy("uid").agg(
            first_value(F.col("orig_h")).alias("source_ip"),
            first_value(F.col("resp_h")).alias("dns_server"),
            F.max_by(F.when(failed(), F.col("rcode_name")), F.when(failed(), arrival()))
            .alias("last_failure"),
            F.min(F.when(F.col("_low").isNotNull(), F.struct("ts_us", "row_id", "_low")))
            .alias("low_ttl"),
        )
        answers = (
            rows.select("uid", F.explode("answers").alias("answer")).distinct()
            .groupBy("uid").agg(F.count("*").alias("distinct_answers"))
        )
        t = counts.join(context, "uid", "left").join(answers, "uid", "left")
        total, bad = F.col("total_queries"), F.col("failed_queries")
        return (
            t.withColumn("distinct_answers", F.coalesce("distinct_answers", F.lit(0)))
            .withColumn("high_failure", (total >= K.DNS_MIN_QUERIES)
                        & (bad / total >= K.DNS_FAILURE_RATIO))
            .withColumn("has_low_ttl", F.col("low_ttl").isNotNull())
            .withColumn("is_reported", F.col("suspicious_tld") | F.col("dga")
                        | F.col("repetitive") | F.col("high_failure") | F.col("has_low_ttl"))
        )

    def summary(self, totals: DataFrame) -> DataFrame:
        s = totals.where("is_reported")
        reasons = labels(
            (F.col("dga"), "DGA-like queries"),
            (F.col("high_failure"), "a high failure rate"),
            (F.col("repetitive"), "repetitive beaconing"),
        )
        assessment = (
            F.when(F.size(reasons) > 0,
                   sentence("Potential Threat: Activity exhibits ", reasons))
            .when(F.col("has_low_ttl") | F.col("suspicious_tld"),
                  "Suspicious: Low-confidence anomalies observed (e.g., low TTL, monitored TLDs).")
            .otherwise("Benign: No significant threat indicators found.")
        )
        rate = percent_text(F.col("failed_queries"), F.col("total_queries"))
        return s.select(
            "uid",
            F.struct(
                assessment.alias("overall_assessment"),
                F.when(F.col("dga"), "High Entropy (DGA-like)")
                .when(F.col("repetitive"), "Repetitive (Beaconing-like)")
                .otherwise("Normal").alias("observed_query_pattern"),
                F.format_string("Normal (%s failure rate)", rate).alias("observed_integrity"),
                F.when(F.col("suspicious_tld"), "Suspicious").otherwise("Normal")
                .alias("observed_tld_risk"),
                F.when(F.col("has_low_ttl"), F.format_string("Low (%ds)", F.col("low_ttl._low")))
                .otherwise("Normal").alias("observed_ttl_behavior"),
            ).alias("analysis"),
            F.struct(
                "total_queries", "distinct_queries",
                F.round(F.col("failed_queries") / F.col("total_queries"), 2)
                .alias("failed_queries_ratio"),
                "distinct_answers",
            ).alias("statistics"),
            F.struct("source_ip", F.col("dns_server").alias("destination_dns_server"))
            .alias("context"),
        )

    def evidence(self, rows: DataFrame, totals: DataFrame) -> DataFrame:
        totals = totals.where("is_reported")
        reported = session_rows(rows, totals)

        def finding(kind: str, source: str, content, reason):
            return item(type=F.lit(kind), source=F.lit(source), content=content,
                        reasons=F.array(reason))

        query = F.col("query")
        signed = query_signs(reported.where(query != ""), self.suffixes)
        checks = [
            (F.col("bad_tld"), "query_tld", F.format_string("Suspicious TLD (.%s)", "suffix")),
            (F.col("long_query"), "query_length",
             F.format_string(f"Long Query (%d > {K.DNS_LONG_QUERY})", F.length("query"))),
            (F.col("dga"), "query_subdomain",
             F.format_string("High Shannon Entropy (%.2f)", "entropy")),
            (F.col("qtype_name").isin(K.DNS_SUSPICIOUS_TYPES), "query_type",
             F.format_string("Suspicious QTYPE (%s)", "qtype_name")),
        ]
        found = F.array_compact(F.array(*[
            F.when(cond, F.struct(F.lit(i).alias("n"),
                                  finding("AttributeFinding", source, query, text).alias("item")))
            for i, (cond, source, text) in enumerate(checks)
        ]))
        per_row = signed.select("uid", "ts_us", "row_id", F.explode(found).alias("f"))
        rows_out = evidence_rows(
            per_row, "dns", "findings",
            position(F.col("ts_us"), F.col("row_id"), F.col("f.n")), F.col("f.item"),
        )

        low = F.col("low_ttl._low")
        ttl_out = evidence_rows(
            totals.where("has_low_ttl"), "dns", "findings",
            position(F.col("low_ttl.ts_us"), F.col("low_ttl.row_id"), len(checks)),
            finding("AttributeFinding", "answer_record", low.cast("string"),
                    F.format_string("Low TTL (%ds)", low)),
        )
        repeated = self.queries(reported).where(
            F.col("query").isNotNull() & (F.col("n") >= K.DNS_REPEATED_QUERY)
        )
        repeat_out = evidence_rows(
            repeated, "dns", "findings", position(LAST, F.col("first_seen"), F.col("n")),
            finding("PatternFinding", "query_stream", query,
                    F.format_string("Repetitive Query (%d times)", "n")),
        )
        rate = percent_text(F.col("failed_queries"), F.col("total_queries"))
        failure_out = evidence_rows(
            totals.where("high_failure"), "dns", "findings", position(LAST, LAST),
            finding("PatternFinding", "query_stream",
                    F.concat(F.lit("rcode_name: "), "last_failure"),
                    F.format_string("High Failure Ratio (%s)", rate)),
        )
        return (
            rows_out.unionByName(ttl_out).unionByName(repeat_out).unionByName(failure_out)
        )
