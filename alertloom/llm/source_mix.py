"""Mixing sources to target weights: bounded iterative proportional fitting, then sampling by its probabilities."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertloom.session import stage

OTHER = "other"
#: Sides of the mix and their target shares of tokens. A value that is not listed, null included, is `other`.
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.10, OTHER: 0.05}
SOURCES = {**{f"src{i}": 0.049 for i in range(20)}, OTHER: 0.02}
TOPICS = {"prose": 0.80, "list": 0.10, "table": 0.05, "markup": 0.05}
#: Share of all tokens that the sample holds.
BUDGET = 0.5
ROUNDS, TOLERANCE = 200, 1e-9
#: Beyond this factor a value's target cannot be met beside the others.
MAX_FACTOR = 1e12


def n_tokens(text: Column) -> Column:
    """Blanks plus one: a cheap count of words of the whole text; null and empty texts have none."""
    whole = F.coalesce(text, F.lit(""))
    blanks = F.length(whole) - F.length(F.translate(whole, " \n", ""))
    return F.when(whole == "", F.lit(0)).otherwise(blanks + 1).cast("long")


def topic_of(text: Column) -> Column:
    """The form of a text stands in for its topic: a table, markup, a list of short lines, or prose."""
    whole = F.coalesce(text, F.lit(""))
    size = F.length(whole)
    count = lambda chars: size - F.length(F.translate(whole, chars, ""))
    return (
        F.when(count("|") * 100 > size, F.lit("table"))
        .when(count("#$%&<>{}") * 100 > size, F.lit("markup"))
        .when(count("\n") * 60 > size, F.lit("list"))
        .otherwise(F.lit("prose"))
    )


@dataclass
class Mix:
    """Inclusion probability per cell of the sides, and how far the sample then is from its targets."""

    targets: Mapping[str, Mapping[str, float]]
    budget: float
    cells: dict[tuple, float] = field(default_factory=dict)
    probability: dict[tuple, float] = field(default_factory=dict)
    #: Largest gap between the wanted and the expected tokens of a value, as a share of the sample.
    gap: float = 0.0


def reachable(goal: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Goals of one side cut to the tokens there are; what is cut off goes to the others in proportion.

    Goals without any weight fall back to the tokens held, so the sum is kept wherever the tokens allow it.
    """
    goal, wanted = goal.astype(float), min(goal.sum(), held.sum())
    full = np.zeros(len(goal), bool)
    while True:
        open_ = ~full
        left = max(wanted - held[full].sum(), 0.0)
        weight = goal[open_] if goal[open_].sum() > 0 else held[open_]
        cut = np.where(full, held, 0.0)
        if weight.sum() > 0:
            cut[open_] = weight * (left / weight.sum())
        over = open_ & (cut > held)
        if not over.any():
            return cut
        full |= over


def factor(tokens: np.ndarray, weight: np.ndarray, goal: float) -> float:
    """The one x for which the tokens, each cell by its weight times x but at most whole, sum to the goal.

    The sum is piecewise linear in x; cells become whole in the order of falling weight.
    """
    order = np.argsort(-weight, kind="stable")
    order = order[weight[order] > 0]
    n, w = tokens[order], weight[order]
    if not len(n) or goal >= n.sum():
        return 1.0 / w.min() if len(n) else 1.0
    whole = np.concatenate([[0.0], np.cumsum(n)[:-1]])
    rest = np.cumsum((n * w)[::-1])[::-1]
    x = (goal - whole) / rest
    return float(max(x[np.flatnonzero(x * w <= 1.0 + 1e-12)[0]], 0.0))


def rake(cells: Mapping[tuple, float], targets: Mapping[str, Mapping[str, float]], budget: float = BUDGET) -> Mix:
    """Probabilities that meet each side's target shares of the budget, in proportion to `cells` otherwise.

    Bounded proportional fitting: a cell's probability is the product of one factor per side, at most
    1. Sides are fitted in turn, and the factor of a value is the one that meets its target with the caps in force,
    so what a whole cell cannot give is raked from the free cells of the same value. Targets of a
    value beyond its tokens are cut to them and the others of its side scaled up. Targets that can only not be
    met together leave a `gap`; every cell without tokens is kept whole, as it costs nothing.
    """
    keys = sorted(k for k, n in cells.items() if n > 0)
    mix = Mix(targets, budget, dict(cells), {k: 1.0 for k in cells})
    if not keys:
        return mix
    tokens = np.array([float(cells[k]) for k in keys])
    total = tokens.sum() * budget
    sides_ = []
    for at, wanted in enumerate(targets.values()):
        names = sorted({k[at] for k in keys})
        place = np.array([names.index(k[at]) for k in keys])
        held = np.bincount(place, tokens, len(names))
        goal = np.array([max(wanted.get(x, 0.0), 0.0) for x in names])
        goal = reachable(goal * (total / goal.sum()) if goal.sum() else held * budget, held)
        sides_.append((place, goal, np.ones(len(names))))
    weight = np.full(len(keys), float(budget))
    for _ in range(ROUNDS):
        for place, goal, factors in sides_:
            for v in range(len(goal)):
                own = np.flatnonzero(place == v)
                before = weight[own] / factors[v] if factors[v] else weight[own]
                factors[v] = min(factor(tokens[own], before, goal[v]), MAX_FACTOR)
                weight[own] = before * factors[v] if factors[v] else 0.0
        expected = tokens * np.minimum(weight, 1.0)
        mix.gap = max(float(np.abs(np.bincount(p, expected, len(g)) - g).max()) for p, g, _ in sides_) / max(total, 1.0)
        if mix.gap < TOLERANCE:
            break
    mix.probability.update(zip(keys, np.minimum(weight, 1.0).tolist(), strict=True))
    return mix


REPORT = "side string, value string, tokens long, target double, attained double, reachable boolean"


def attained(spark: SparkSession, mix: Mix) -> DataFrame:
    """One row per value of each side: its tokens, target and expected share, and if its own tokens suffice.

    A value that no document has is listed with no tokens. The table has one row per value of the targets.
    """
    kept = {k: n * mix.probability[k] for k, n in mix.cells.items()}
    total, whole = sum(kept.values()), sum(mix.cells.values()) * mix.budget
    rows = []
    for at, (side, wanted) in enumerate(mix.targets.items()):
        for value in sorted({*wanted, *(k[at] for k in mix.cells)}):
            tokens = sum(n for k, n in mix.cells.items() if k[at] == value)
            own = sum(n for k, n in kept.items() if k[at] == value)
            goal = float(wanted.get(value, 0.0))
            rows.append((side, value, int(tokens), goal, own / total if total else 0.0, tokens >= goal * whole))
    return spark.createDataFrame(rows, REPORT)


def sides(docs: DataFrame, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """`docs` with _source, _lang, _topic, _tokens; names that no target lists become `other`."""
    known = lambda c, side: F.when(F.col(c).isin(*targets[side]), F.col(c)).otherwise(OTHER)
    return docs.withColumns({
        "_source": known("source", "source"), "_lang": known("lang", "lang"),
        "_topic": topic_of(F.col("text")), "_tokens": n_tokens(F.col("text")),
    })


def fit(facts: DataFrame, targets: Mapping[str, Mapping[str, float]], budget: float = BUDGET) -> Mix:
    """Tokens of all documents by cell, raked to the targets and the budget.

    The driver gets one row per cell, at most the product of the targets' sizes, as names that are not
    listed count as one.
    """
    names = ["_source", "_lang", "_topic"]
    rows = facts.groupBy(*names).agg(F.sum("_tokens").alias("n")).collect()
    return rake({tuple(r[c] for c in names): int(r["n"]) for r in rows}, targets, budget)


def with_probability(facts: DataFrame, mix: Mix) -> DataFrame:
    """Adds probability, draw (0 to 1, from the id alone) and sampled."""
    spark = facts.sparkSession
    rows = [(*k, float(p)) for k, p in sorted(mix.probability.items())]
    table = spark.createDataFrame(rows, "_source string, _lang string, _topic string, probability double")
    head = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10)
    # One row per cell of the targets.
    return (
        facts.join(F.broadcast(table), ["_source", "_lang", "_topic"], "left")
        .withColumn("probability", F.coalesce("probability", F.lit(0.0)))
        .withColumn("draw", head.cast("double") / float(1 << 32))
        .withColumn("sampled", F.col("draw") < F.col("probability"))
    )


TARGETS = {"source": SOURCES, "lang": LANGUAGES, "topic": TOPICS}


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None,
          budget: float = BUDGET) -> DataFrame:
    """One row per document: doc_id, source_group, lang_group, topic, n_tokens, probability, draw, sampled.

    Whole documents are drawn, independently, by a hash of the id: a run gives the same sample
    again, and rows that repeat an id share its draw. Null sources and languages count as `other`, null
    texts as prose without tokens; a cell without tokens is kept whole, as it costs nothing; a null id draws
    like an empty one. An empty table gives an empty result.
    """
    wanted = TARGETS if targets is None else targets
    narrow = sides(docs.select("doc_id", "text", "lang", "source"), wanted)
    facts = stage(narrow.select("doc_id", "_source", "_lang", "_topic", "_tokens"), "mix-facts")
    return with_probability(facts, fit(facts, wanted, budget)).select(
        "doc_id", F.col("_source").alias("source_group"), F.col("_lang").alias("lang_group"),
        F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), "probability", "draw", "sampled")


def sample_mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None,
               budget: float = BUDGET) -> DataFrame:
    """The sampled documents with all their columns; each is judged within the scan, without a join back."""
    wanted = TARGETS if targets is None else targets
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text", "lang", "source")  # no name can clash
    facts = sides(packed, wanted)
    mix = fit(facts, wanted, budget)
    return with_probability(facts, mix).filter("sampled").select("row.*")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
