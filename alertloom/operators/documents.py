"""Sessions, their evidence in bounded parts, and the nested document of an alert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from alertloom import constants as K
from alertloom.operators.collectors.base import Collector
from alertloom.operators.collectors.conn import connection_block
from alertloom.operators.collectors.dns import DnsCollector
from alertloom.operators.collectors.files import FilesCollector
from alertloom.operators.collectors.http import HttpCollector
from alertloom.operators.collectors.ssl import SslCollector
from alertloom.operators.rules import REFERENCE, Rule, severity_level, with_levels
from alertloom.session import stage, stage_all

LEVELS = [*K.SEVERITY_LEVELS, REFERENCE]
PART_LIMIT = 10_000


def default_collectors() -> list[Collector]:
    return [HttpCollector(), DnsCollector(), SslCollector(), FilesCollector()]


def classified(collector: Collector, totals: DataFrame,
               rules: Sequence[Rule] = K.SEVERITY_RULES) -> DataFrame:
    """The summary of each reported session, with its severity `level` if it stands alone."""
    s = collector.summary(totals)
    return s.withColumn("level", severity_level(collector.name, s.schema, rules))


def session_summaries(uids: DataFrame, totals: dict[str, DataFrame],
                      collectors: Sequence[Collector],
                      rules: Sequence[Rule] = K.SEVERITY_RULES) -> DataFrame:
    """One row per uid, with a struct (analysis, statistics, context, level) per collector."""
    out = uids.select("uid").distinct()
    for c in collectors:
        block = F.struct("analysis", "statistics", "context").alias(c.name)
        out = out.join(c.summary(totals[c.name]).select("uid", block), "uid", "left")
    return with_levels(out, [c.name for c in collectors], rules)


def session_evidence(logs: dict[str, DataFrame], totals: dict[str, DataFrame],
                     collectors: Sequence[Collector]) -> DataFrame:
    """The long table of evidence: uid, collector, kind, ord, item."""
    first, *rest = [c.evidence(logs[c.name], totals[c.name]) for c in collectors]
    for e in rest:
        first = first.unionByName(e)
    return first


def evidence_parts(evidence: DataFrame, limit: int = PART_LIMIT) -> DataFrame:
    """uid, part, parts, items: the evidence of a session in parts of about `limit` rows.

    Nearly all sessions have one part. A larger one is dealt out over as many parts as it
    needs, so nothing is dropped and no group outgrows a task.
    """
    large = (
        evidence.groupBy("uid").count().where(F.col("count") > limit)
        .select("uid", F.ceil(F.col("count") / limit).cast("int").alias("_parts"))
    )
    dealt = evidence.join(large, "uid", "left").withColumn(
        "parts", F.coalesce("_parts", F.lit(1))
    ).withColumn(
        "part",
        F.pmod(F.xxhash64("collector", "kind", "ord", "item"), F.col("parts")).cast("int"),
    )
    return dealt.groupBy("uid", "part").agg(
        F.max("parts").alias("parts"),
        F.array_sort(F.collect_list(F.struct("collector", "kind", "ord", "item"))).alias("items"),
    )


def sessions(uids: DataFrame, logs: dict[str, DataFrame],
             collectors: Sequence[Collector] | None = None,
             rules: Sequence[Rule] = K.SEVERITY_RULES, limit: int = PART_LIMIT) -> DataFrame:
    """Summaries joined with evidence parts; part 0 exists for every uid.

    Totals and the evidence table are staged: both are read by several branches.
    """
    collectors = list(collectors or default_collectors())
    totals = stage_all({c.name: c.totals(logs[c.name]) for c in collectors})
    evidence = stage(session_evidence(logs, totals, collectors), "evidence")
    summary = session_summaries(uids, totals, collectors, rules)
    return (
        summary.join(evidence_parts(evidence, limit), "uid", "left")
        .withColumn("part", F.coalesce("part", F.lit(0)))
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
    )


def _items(collector: str, kind: str) -> Column:
    chosen = F.filter("items", lambda e: (e["collector"] == collector) & (e["kind"] == kind))
    found = F.transform(chosen, lambda e: e["item"])
    return F.when(F.size(found) > 0, found)


def _values(collector: str, kind: str) -> Column:
    return F.transform(_items(collector, kind), lambda i: i["value"])


def _any(**fields: Column) -> Column:
    """A struct of the given fields, null when all of them are."""
    present = F.lit(False)
    for c in fields.values():
        present = present | c.isNotNull()
    return F.when(present, F.struct(*[c.alias(n) for n, c in fields.items()]))


def _hashes(kind: str) -> Column:
    # A hash without a known threat keeps an explicit JSON null.
    return F.transform(
        _items("ssl", kind),
        lambda i: F.struct(
            i["value"].alias("hash"),
            F.coalesce(i["threat_name"].cast("variant"), F.parse_json(F.lit("null")))
            .alias("threat_name"),
        ),
    )


def evidence_payload(collector: str) -> Column:
    """The evidence object of one collector as it stands in a document."""
    block = F.col(collector)
    if collector == "http":
        evidence = F.struct(
            F.struct(
                F.coalesce(_values("http", "methods_used"), F.array().cast("array<string>"))
                .alias("methods_used"),
                block["context"]["user_agent_string"].alias("user_agent_string"),
            ).alias("connection_context"),
            _items("http", "findings").alias("findings"),
        )
    elif collector == "dns":
        context = block["context"]
        evidence = F.struct(
            _any(source_ip=context["source_ip"],
                 destination_dns_server=context["destination_dns_server"])
            .alias("connection_context"),
            _items("dns", "findings").alias("findings"),
        )
    elif collector == "ssl":
        evidence = F.struct(
            *[_values("ssl", k).alias(k) for k in (
                "server_names", "tls_versions_used", "ciphers_used",
                "certificate_chain_fingerprints")],
            _hashes("ja3_details").alias("ja3_details"),
            _hashes("ja3s_details").alias("ja3s_details"),
        )
    else:
        evidence = F.struct(
            F.coalesce(_items(collector, "findings"), F.array()).alias("findings")
        )
    order = {"analysis": block["analysis"], "evidence": evidence,
             "statistics": block["statistics"]}
    if collector in ("ssl", "files"):
        order = {k: order[k] for k in ("analysis", "statistics", "evidence")}
    return F.when(block.isNotNull(), F.struct(*[c.alias(n) for n, c in order.items()]))


def evidence_block(collectors: Sequence[str]) -> Column:
    """Payloads under their severity levels; levels without any are absent."""
    by_level = {}
    for level in LEVELS:
        by_level[level] = _any(**{
            c: F.when(F.col(c)["level"] == level, F.col(f"_{c}")) for c in collectors
        })
    return _any(**by_level)


def alert_header() -> Column:
    return F.struct(
        F.coalesce("rule_name", F.lit("N/A")).alias("signature"),
        F.coalesce("rule_category", F.lit("N/A")).alias("category"),
        F.coalesce("timestamp", F.lit("N/A")).alias("timestamp"),
    )


def _json_connection() -> Column:
    """The connection block with the ratio as a number or the text N/A."""
    c = F.col("connection")
    ratio = F.coalesce(c["analysis"]["flow_ratio"]["ratio"].cast("variant"),
                       F.lit("N/A").cast("variant"))
    analysis = c["analysis"].withField("flow_ratio",
                                       c["analysis"]["flow_ratio"].withField("ratio", ratio))
    return F.when(c.isNotNull(), c.withField("analysis", analysis))


def session_payloads(session: DataFrame, collectors: Sequence[str]) -> DataFrame:
    """uid, part, parts, _told: the levels of a session part and its evidence as JSON.

    All of it belongs to the session, so it is worked out before alerts are joined, however many
    alerts share the session.
    """
    has_evidence = F.lit(False)
    for c in collectors:
        session = session.withColumn(f"_{c}", evidence_payload(c))
        has_evidence = has_evidence | F.col(c).isNotNull()
    return session.select("uid", "part", "parts", F.struct(
        has_evidence.alias("has_evidence"),
        *[F.col(c)["level"].alias(f"{c}_level") for c in collectors],
        F.to_json(evidence_block(collectors)).alias("evidence"),
    ).alias("_told"))


def attach_sessions(alerts: DataFrame, matched: DataFrame, session: DataFrame,
                    id_col: str = "alert_id") -> DataFrame:
    """Alerts left-joined with their connection and the evidence of its session.

    `matched` has the session's key as `scope`, or else its uid is the key. Unmatched alerts keep
    a null key, which an outer join leaves where it is.
    """
    key = "scope" if "scope" in matched.columns else "uid"
    known = alerts.join(matched.withColumn("_key", F.col(key)), id_col, "left")
    return (
        known.join(session.withColumnRenamed("uid", "_key"), "_key", "left").drop("_key")
        .withColumn("part", F.coalesce("part", F.lit(0)))
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("connection", connection_block(F.col("conn")))
    )


def documents(alerts: DataFrame, matched: DataFrame, session: DataFrame,
              collectors: Sequence[str] = ("http", "dns", "ssl", "files"),
              id_col: str = "alert_id") -> DataFrame:
    """One row per alert row (and evidence part): typed blocks and the JSON document.

    `id_col` tells the rows of `alerts` apart, also where alerts are equal. The evidence is put into
    JSON once for each session part; an alert only adds its own header and connection to that text.
    """
    joined = attach_sessions(alerts, matched, session_payloads(session, collectors), id_col)
    own = F.to_json(F.struct(alert_header().alias("alert"), _json_connection().alias("connection")))
    told, head = F.col("_told"), F.col("_head")
    opened = F.substring(head, F.lit(1), F.length(head) - 1)
    whole = F.concat(opened, F.lit(',"evidence":'), told["evidence"], F.lit("}"))
    return joined.withColumn("_head", own).select(
        *dict.fromkeys([id_col, "alert_id"]), "timestamp", "rule_name", "part", "parts", "uid",
        F.col("connection").isNotNull().alias("has_connection"),
        F.coalesce(told["has_evidence"], F.lit(False)).alias("has_evidence"),
        *[told[f"{c}_level"].alias(f"{c}_level") for c in collectors],
        F.coalesce(whole, head).alias("document"),
    )
