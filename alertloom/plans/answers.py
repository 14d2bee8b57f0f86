"""From documents to analysis records: requests, answers, defaults and a quarantine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from alertloom.operators import verdicts as V
from alertloom.session import stage
from alertloom.sources.sinks import write_analyses, write_run

RECORD_KEYS = ("alert_index", "part")


def answer_alerts(docs: DataFrame, classifier: Callable, system_text: str, template: str,
                  analyses_path: str, quarantine_path: str, run: str, model: str = "default") -> None:
    """Write the analysis of each document (alert_index, part, rule_name, document, ...).

    Documents without evidence get the default verdict, the others the classifier's. Each request is
    asked once and its answer written before it is read, so that a lost executor costs no second
    question to a finished one. Answers without a usable verdict go to a quarantine with the text
    found in them, and give no record. A run has folders of its own, which a rerun overwrites.
    """
    requests = V.request_rows(docs, model, system_text, template, RECORD_KEYS)
    answers = V.parse_responses(stage(V.classify(requests, classifier), "answers"))
    usable = F.col("llm_analysis.result.conclusion.classification").isNotNull()
    told = answers.where(usable).select(*RECORD_KEYS, "llm_analysis")
    named = docs.select(*RECORD_KEYS, "rule_name").join(told, list(RECORD_KEYS))
    records = V.analysis_records(named).unionByName(V.default_analyses(docs))
    write_analyses(records, analyses_path, run)
    refused = answers.where(~F.coalesce(usable, F.lit(False))).select(
        *RECORD_KEYS, "response", V.json_block(F.col("response")).alias("block"))
    write_run(refused, quarantine_path, run)
