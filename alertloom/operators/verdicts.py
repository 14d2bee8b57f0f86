"""Routing by evidence, default verdicts, request rows and parsed responses."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from alertloom import constants as K
from alertloom.functions.jsontext import json_block, response_object
from alertloom.schemas import VERDICT

BATCH_BYTES = 4 << 20


def lacks_evidence() -> Column:
    return ~F.col("has_connection") & ~F.col("has_evidence")


def without_evidence(docs: DataFrame) -> DataFrame:
    """Alerts that are false positives by default."""
    return docs.where(lacks_evidence())


def needs_inference(docs: DataFrame) -> DataFrame:
    return docs.where(~lacks_evidence())


def default_verdict(signature: Column) -> Column:
    return F.struct(
        F.struct(
            F.struct(
                F.lit(K.NO_EVIDENCE_THOUGHT).alias("thought_process"),
                F.format_string(K.NO_EVIDENCE_ALERT, F.coalesce(signature, F.lit("N/A")))
                .alias("analyze_alert"),
                F.lit(K.NO_EVIDENCE_SIGNALS).alias("analyze_signals"),
                F.lit(K.NO_EVIDENCE_SYNTHESIS).alias("synthesize_reasoning"),
            ).alias("reasoning"),
            F.struct(
                F.lit(K.FALSE_POSITIVE).alias("classification"),
                F.lit(1.0).alias("confidence_score"),
                F.lit(K.NO_EVIDENCE_SUMMARY).alias("reasoning_summary"),
            ).alias("conclusion"),
        ).alias("result")
    )


def request_rows(docs: DataFrame, model: str, system_text: str, template: str,
                 keys: Sequence[str] = ("alert_id", "part")) -> DataFrame:
    """Keys and the request body for a chat-completion service; `template` has the slot of the document."""
    user = F.replace(F.lit(template), F.lit(K.CONTEXT_SLOT), F.col("document"))

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    body = F.struct(
        F.lit(model).alias("model"),
        F.array(message("system", F.lit(system_text)), message("user", user)).alias("messages"),
        F.lit(K.REQUEST_TEMPERATURE).alias("temperature"),
        F.lit(K.REQUEST_MAX_TOKENS).alias("max_tokens"),
        F.lit(False).alias("stream"),
        F.lit(False).alias("cache_prompt"),
    )
    return needs_inference(docs).select(*keys, F.to_json(body).alias("request"))


def classify(requests: DataFrame, classifier: Callable | None = None) -> DataFrame:
    """Answers of a user-supplied classifier, a `mapInPandas` function of the request rows.

    It gets batches of requests and yields their keys with a `response`. Without one there are no
    answers yet. Batches are cut by bytes, so long documents need no more memory than short ones.
    """
    requests.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    keys = requests.drop("request")
    answers = keys.withColumn("response", F.lit(None).cast("string"))
    return answers if classifier is None else requests.mapInPandas(classifier, answers.schema)


def parse_responses(responses: DataFrame) -> DataFrame:
    """Adds `llm_analysis` (null if unusable) and `is_readable`."""
    found = F.to_json(response_object(F.col("response")))
    return responses.withColumn("is_readable", found.isNotNull()).withColumn(
        "llm_analysis", F.from_json(found, VERDICT.strip())
    )


def unreadable(parsed: DataFrame) -> DataFrame:
    """Responses to quarantine, with the JSON text that was found in them."""
    return parsed.where(~F.col("is_readable")).withColumn("block", json_block(F.col("response")))


def default_analyses(docs: DataFrame) -> DataFrame:
    """Analysis records of the alerts without evidence; rows need an `alert_index`."""
    return analysis_records(
        without_evidence(docs).withColumn("llm_analysis", default_verdict(F.col("rule_name")))
    )


def analysis_records(df: DataFrame, folder: str = "enriched") -> DataFrame:
    return df.select(
        "alert_index",
        F.current_timestamp().alias("processed_at"),
        F.coalesce("rule_name", F.lit("N/A")).alias("original_alert_signature"),
        F.format_string(f"{folder}/alert_enrichment_%d.jsonl", "alert_index")
        .alias("enriched_prompt_file"),
        "llm_analysis",
    )
