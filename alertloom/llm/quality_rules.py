"""Quality rules as a short-circuit cascade, with built-in functions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertloom.session import stage

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows, on average, on which costs and selectivities are estimated, and the tasks that hold them.
SAMPLE_ROWS, SAMPLE_TASKS = 1024, 8


@dataclass(frozen=True)
class Rule:
    """A document fails the rule if `fails`, over the columns of `base_signals`, is true."""

    name: str
    fails: Column


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(without(text, characters))


def rules() -> list[Rule]:
    text, n = F.col("text"), F.col("n_words")
    letters = F.greatest(F.length(text), F.lit(1))
    return [
        Rule("symbols", F.col("n_symbols") * 5 > n),
        Rule("repeated_lines", F.col("n_dup_lines") * 10 > F.col("n_lines") * 3),
        Rule("word_length", (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 30)),
        Rule("capitals", count_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") * 2 > letters),
        Rule("exclamations", count_of(text, "!?") * 2 > n),
        Rule("digits", count_of(text, "0123456789") * 10 > letters * 3),
        Rule("brackets", count_of(text, "{}[]()=;") * 10 > letters),
    ]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words stand in windows that the array of words holds twice or more.

    Windows are hashed and sorted with their place, so equal ones are neighbours.
    """
    last = (F.size(words) - WINDOW).cast("int")
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(
        F.array().cast("array<int>"))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(
        F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))).alias("h"), i.alias("i"))))

    def places(w: Column) -> Column:
        same = lambda x, k: x["h"].eqNullSafe(F.get(w, k)["h"])
        twice = F.filter(w, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    # A window adds the words that the window before it has not covered.
    add = lambda acc, i: F.struct(
        (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(let(windows, places), zero, add, lambda acc: acc["n"])


def base_signals(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and the counts of each whole text, without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split("text", BLANK_RUN), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(without(x, BLANKS)) > 0)
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("u")))
    long = {
        "n_words": F.col("_w.n"),
        "word_chars": F.length(without(F.col("text"), BLANKS)),
        "n_symbols": count_of(F.col("text"), SYMBOLS),
        "n_lines": F.col("_l.n"),
        "n_dup_lines": F.col("_l.n") - F.col("_l.u"),
        "n_repeat_words": F.col("_w.r"),
    }
    return (
        docs.select("doc_id", text.alias("text"))
        .select("doc_id", "text", of_words.alias("_w"), of_lines.alias("_l"))
        .select("doc_id", "text", *(v.cast("long").alias(k) for k, v in long.items()))
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def ordered_rules(docs: DataFrame, given: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a sample, best first.

    Rows are drawn one by one at a rate that leaves `sample_rows` of all, wherever they lie, and only they
    have their signals computed; they are dealt out over a few tasks, so no task's load grows with the table.
    The order decides how early a document is given up, never whether it is: all rules must pass.
    """
    rate = min(1.0, sample_rows / max(docs.count(), 1))
    drawn = docs.sample(rate, seed=1).select("doc_id", "text").repartition(SAMPLE_TASKS)
    sample = stage(base_signals(drawn).filter(~base_failed()), "rule-sample")
    shares = sample.agg(*(F.avg(r.fails.cast("double")).alias(r.name) for r in given)).first()

    def seconds(condition: Column) -> float:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            sample.agg(F.count_if(condition)).first()
            best = min(best, time.perf_counter() - start)
        return best

    nothing = seconds(F.length("text") < 0)
    cost = {r.name: max(seconds(r.fails) - nothing, 1e-4) for r in given}
    return sorted(given, key=lambda r: (-(shares[r.name] or 0.0) / cost[r.name], r.name))


def quality_cascade(docs: DataFrame, given: list[Rule] | None = None,
                    sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, base counts, base_failed, failed_rule (null if none), kept.

    A document leaves the cascade at the first rule that it fails; later rules are not evaluated
    for it. Null texts count as empty, have no words and so fail the base rule. Null ids, repeated
    rows and further columns change nothing; an empty table gives an empty result, its rules in
    the order given by name.
    """
    signals = base_signals(docs)
    chosen = ordered_rules(docs, rules() if given is None else given, sample_rows)
    verdict = F.when(base_failed(), F.lit("base"))
    for rule in chosen:
        verdict = verdict.when(rule.fails, F.lit(rule.name))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return (
        signals.withColumn("failed_rule", verdict)
        .select("doc_id", *counts, base_failed().alias("base_failed"), "failed_rule",
                F.col("failed_rule").isNull().alias("kept"))
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_cascade(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.drop("failed_rule")  # which rule came first depends on the measured costs


ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), words AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM base
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS k
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM repeated) GROUP BY r
), counts AS (
  SELECT doc_id, text, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         greatest(length(text), 1) AS chars
  FROM counts
), verdicts AS (
  SELECT *,
    n_symbols * 5 > n_words OR n_dup_lines * 10 > n_lines * 3
    OR word_chars < n_words * 2 OR word_chars > n_words * 30
    OR length(regexp_replace(text, '[^A-Z]', '', 'g')) * 2 > chars
    OR length(regexp_replace(text, '[^!?]', '', 'g')) * 2 > n_words
    OR length(regexp_replace(text, '[^0-9]', '', 'g')) * 10 > chars * 3
    OR length(regexp_replace(text, '[^{}()=;\[\]]', '', 'g')) * 10 > chars AS failed
  FROM judged
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT failed AS kept
FROM verdicts
"""
