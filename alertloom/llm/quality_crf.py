"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from alertloom.llm.common import crc_part, hashed_sample
from alertloom.session import stage

#: Labelled documents learned from, per label.
PER_LABEL = 1500
ROUNDS, RATE, DECAY = 250, 0.1, 2e-4
THRESHOLD = 0.3
SLICE = 1 << 20

_BYTE_KINDS = {
    "upper": range(65, 91), "lower": [*range(97, 123), *range(128, 256)], "digit": range(48, 58),
    "symbol": b"#*$%&<>{}[]=_~^@\\", "bar": b"|", "shout": b"!?", "stop": b".,;:", "blank": b" \t\r\x0b\x0c",
}
FEATURES = [*_BYTE_KINDS, "length", "word_length", "ends_sentence", "seen_before", "repeats_words"]


def _kind_table() -> np.ndarray:
    table = np.zeros((len(_BYTE_KINDS), 256), bool)
    for i, members in enumerate(_BYTE_KINDS.values()):
        table[i, list(members)] = True
    return table


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of the texts, line lengths in bytes, and how many lines each text has.

    A line's row holds its own features, then those of the line before and the line after.
    """
    lines = [t.encode().split(b"\n") for t in texts]
    counts = np.array([len(x) for x in lines])
    flat = [x for own in lines for x in own]
    sizes = np.array([len(x) for x in flat])
    data = np.frombuffer(b"".join(x + b"\n" for x in flat), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    own = np.zeros((len(flat), len(FEATURES)))
    for i, row in enumerate(_kind_table()):
        own[:, i] = np.add.reduceat(row[data].astype(np.int32), starts) / np.maximum(sizes, 1)
    at = len(_BYTE_KINDS)
    own[:, at] = np.log1p(sizes) / 8
    words = [x.split() for x in flat]
    n = np.array([len(w) for w in words])
    own[:, at + 1] = np.minimum(sizes / np.maximum(n, 1) / 10, 3)
    own[:, at + 2] = [x[-1:] in (b".", b"?", b"!") for x in flat]
    k = 0
    for doc in lines:
        seen: set[bytes] = set()
        for line in doc:
            own[k, at + 3] = line in seen and len(line) > 0
            seen.add(line)
            k += 1
    own[:, at + 4] = [1 - len(set(w)) / len(w) if w else 0 for w in words]
    first = np.cumsum(counts) - counts
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first] = 0
    after[first + counts - 1] = 0
    return np.hstack([own, before, after, np.ones((len(flat), 1))]), sizes, counts


def chain(unary: np.ndarray, counts: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once: P(good) of each line, and expected transitions.

    `unary` is the score of good over bad for each line, `step` the 2 x 2 transition scores.
    Messages are log ratios of good to bad, which is all that two states need.
    """
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    begin, length = first[order], counts[order]
    longest = int(length.max(initial=0))
    alive = [int(np.searchsorted(-length, -j, side="left")) for j in range(longest)]
    ahead, back = np.zeros(len(unary)), np.zeros(len(unary))
    for j in range(longest):
        at = begin[:alive[j]] + j
        ahead[at] = unary[at]
        if j:
            m = ahead[at - 1]
            ahead[at] += np.logaddexp(m + step[1, 1], step[0, 1]) - np.logaddexp(m + step[1, 0], step[0, 0])
    for j in range(longest - 2, -1, -1):
        at = begin[:alive[j + 1]] + j
        m = back[at + 1] + unary[at + 1]
        back[at] = np.logaddexp(m + step[1, 1], step[1, 0]) - np.logaddexp(m + step[0, 1], step[0, 0])
    good = 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60)))
    inner = np.ones(len(unary), bool)
    inner[first + counts - 1] = False
    i = np.flatnonzero(inner)
    a, b = ahead[i], back[i + 1] + unary[i + 1]
    joint = np.stack([np.full(len(i), step[0, 0]), step[0, 1] + b, step[1, 0] + a, step[1, 1] + a + b])
    joint = np.exp(joint - joint.max(axis=0, initial=-np.inf)) if len(i) else joint
    joint = joint / np.maximum(joint.sum(axis=0), 1e-300)
    return good, joint.sum(axis=1).reshape(2, 2)


@dataclass
class Crf:
    weights: np.ndarray
    step: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of the lines' probabilities of being good."""
        found = np.zeros(len(texts))
        held: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            held.append(i)
            size += len(text)
            if size >= SLICE or i == len(texts) - 1:
                x, sizes, counts = line_features([texts[k] for k in held])
                good, _ = chain(x @ self.weights, counts, self.step)
                starts = np.cumsum(counts) - counts
                weight = sizes + 1.0
                found[held] = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
                held, size = [], 0
        return found


def train(texts: list[str], labels: np.ndarray, weight: np.ndarray | None = None) -> Crf:
    """Maximum likelihood of line labels, each line taking its document's label."""
    width = 3 * len(FEATURES) + 1
    crf = Crf(np.zeros(width), np.zeros((2, 2)))
    if len(set(labels.tolist())) < 2:
        crf.weights[-1] = 0.0 if not len(labels) else (4.0 if labels[0] else -4.0)
        return crf
    x, _, counts = line_features(texts)
    y = np.repeat(labels.astype(float), counts)
    inner = counts - 1
    seen = np.array([[inner[labels == 0].sum(), 0.0], [0.0, inner[labels == 1].sum()]])
    speed, square = [np.zeros(width), np.zeros((2, 2))], [np.zeros(width), np.zeros((2, 2))]
    for t in range(1, ROUNDS + 1):
        good, expected = chain(x @ crf.weights, counts, crf.step)
        slopes = [(x.T @ (y - good)) / len(y) - DECAY * crf.weights, (seen - expected) / len(y) - DECAY * crf.step]
        for k, (value, slope) in enumerate(zip((crf.weights, crf.step), slopes, strict=True)):
            speed[k] = 0.9 * speed[k] + 0.1 * slope
            square[k] = 0.999 * square[k] + 0.001 * slope**2
            value += RATE * (speed[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
    return crf


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Crf:
    """Trains on a bounded sample: of each label the documents whose hashed id is smallest.

    Contradictory labels of one document count as the lower one; null ids, labels and texts are
    left out. The driver gets at most 2 x `per_label` texts.
    """
    usable = (
        labels.filter((crc_part(F.col("doc_id"), 5) != 0) & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    binary = usable.filter(F.col("quality").isin(0, 1))
    chosen = stage(hashed_sample(binary, "quality", per_label), "quality-sample")
    # At most 2 x per_label ids, so the broadcast is bounded.
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text IS NOT NULL")
        .select("doc_id", "quality", "text").dropDuplicates(["doc_id"]).toPandas()
        .sort_values("doc_id")
    )
    return train(rows["text"].to_list(), rows["quality"].to_numpy(int))


def score(docs: DataFrame, model: Crf, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted. Null texts count as empty, which is one line without bytes.

    Null ids and repeated rows pass through; other columns are not looked at; an empty table
    gives an empty result. Nothing is shuffled.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(crc_part(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs, fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")
