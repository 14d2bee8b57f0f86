"""Language identification with error-correcting output codes over byte n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from alertloom.llm.common import crc_part, hashed_sample, trimmed
from alertloom.session import stage

#: Hash buckets of the n-grams of two and three bytes.
BUCKETS = 1 << 15
#: Documents learned from: at most so many of a language, and in all.
PER_LANGUAGE, IN_ALL = 1500, 12_000
#: A prediction is flagged if the runner-up comes within this share of the score.
AMBIGUOUS = 0.6
UNKNOWN = "und"
#: Characters of documents whose n-grams are weighed together; a longer text is taken alone.
SLICE = 1 << 16
LETTER = regex.compile(r"\p{L}")


def code_words(n: int, seed: int = 7) -> np.ndarray:
    """A row of -1 and 1 for each of n languages: exhaustive up to 5, else the best of random codes."""
    if n <= 5:
        columns = [[1 if (k >> i) & 1 else -1 for i in range(n)] for k in range(1, 1 << max(n - 1, 0))]
        return np.array(columns, np.int8).reshape(len(columns), n).T
    random, bits = np.random.default_rng(seed), math.ceil(10 * math.log2(n))
    best, distance = None, -1
    for _ in range(50):
        code = random.choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if least > distance:
            best, distance = code, least
    return best


#: Lower case for A-Z; everything in ASCII that is no letter becomes a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, where each text's begin, and how many it has."""
    data = np.frombuffer(b"".join(b" " + t.translate(_FOLD) + b"  " for t in texts), np.uint8)
    sizes = np.array([len(t) + 3 for t in texts])
    ends = np.cumsum(sizes)
    wide = data.astype(np.uint32)
    two = wide << 8 | np.roll(wide, -1)
    three = two << 8 | np.roll(wide, -2)
    spread = lambda x, m: (x * np.uint32(m)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    both = np.stack([spread(two, 2654435769), spread(three, 2246822519)], axis=1)
    skip = np.concatenate([ends - 1, ends - 2])  # n-grams that would reach into the next text
    keep = np.ones(len(data), bool)
    keep[skip] = False
    return both[keep].reshape(-1), (ends - sizes - 2 * np.arange(len(texts))) * 2, (sizes - 2) * 2


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        """Mean weight of each text's n-grams, per bit of the code."""
        found = np.zeros((len(texts), self.code.shape[1]))
        held: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            held.append(i)
            size += len(text)
            if size >= SLICE or i == len(texts) - 1:
                buckets, starts, counts = grams([texts[k].encode() for k in held])
                sums = np.add.reduceat(self.weights[buckets], starts, axis=0, dtype=np.float64)
                found[held] = sums / counts[:, None]
                held, size = [], 0
        return (found - self.shift) / self.scale

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text.

        The loss of a code word is the trust-weighted logistic loss of its bits against the
        margins; the nearest word wins, and the score is its share in a softmax of the losses.
        """
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        unsure = np.ones(len(texts), bool)
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if known and self.languages:
            z = 3 * self.margins([texts[i] for i in known])
            loss = np.logaddexp(0, -z[:, None, :] * self.code[None]) @ self.trust
            likely = np.exp(loss.min(axis=1, keepdims=True) - loss)
            likely /= likely.sum(axis=1, keepdims=True)
            best = likely.argmax(axis=1)
            top = likely[np.arange(len(known)), best]
            second = np.sort(likely, axis=1)[:, -2] if len(self.languages) > 1 else 0 * top
            for i, b in zip(known, best, strict=True):
                names[i] = self.languages[b]
            scores[known], unsure[known] = top, second > AMBIGUOUS * top
        return names, scores, unsure


def learning_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> DataFrame:
    """text and lang of a bounded sample: for each language the rows whose hashed id is smallest."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).filter(
        crc_part(F.col("doc_id"), 3) != 1)
    chosen = stage(
        hashed_sample(labelled, "lang", per_language).select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(in_all), "language-sample")
    # At most `in_all` ids, so the broadcast is bounded.
    return stage(labelled.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text"),
                 "language-texts")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> Model:
    """Binary n-gram classifiers for the bits of the languages' code words.

    Each language's n-gram distribution is counted on the sample. A bit's weights are the log ratio
    of the mean distributions of its two sides; its shift, scale and trust (how much better than
    chance it is) come from its margins on the sample. The driver gets counts of `BUCKETS` per
    language and one margin per sampled row and bit.
    """
    rows = learning_rows(docs, per_language, in_all)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held += np.bincount(grams([text.encode()])[0], minlength=BUCKETS)
        for lang, held in total.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(held[at])],
                ["lang", "bucket", "n"])

    counts = rows.mapInArrow(trimmed(count), "lang string, bucket int, n long")
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    code = code_words(len(languages))
    share = np.full((len(languages), BUCKETS), 0.5)
    np.add.at(share, (table["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int),
                      table["bucket"].to_numpy(int)), table["n"].to_numpy(float))
    share /= share.sum(axis=1, keepdims=True)
    bits = code.shape[1]
    weights = np.zeros((BUCKETS, bits))
    for b in range(bits):
        weights[:, b] = np.log(share[code[:, b] > 0].mean(0) / share[code[:, b] < 0].mean(0))
    model = Model(languages, code, weights.astype(np.float32), np.zeros(bits), np.ones(bits), np.ones(bits))
    if bits:
        margins, own = _sample_margins(rows, model)
        sides = code[own]
        up = np.array([margins[sides[:, b] > 0, b].mean() for b in range(bits)])
        down = np.array([margins[sides[:, b] < 0, b].mean() for b in range(bits)])
        model.shift, model.scale = (up + down) / 2, np.maximum(np.abs(up - down) / 2, 1e-9)
        right = (np.sign(margins - model.shift) == sides).mean(axis=0)
        model.trust = np.maximum(2 * right - 1, 0.01)
    return model


def _sample_margins(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    place = {x: i for i, x in enumerate(model.languages)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [place[x] for x in batch.column("lang").to_pylist()]
            margins = model.margins(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), pa.array(list(margins))], ["own", "margins"])

    found = rows.mapInArrow(trimmed(measure), "own int, margins array<double>").toPandas()
    return np.stack(found["margins"].to_list()), found["own"].to_numpy()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` with lang_pred, lang_score, lang_ambiguous; nothing is shuffled.

    A text that is null, empty or without a letter is `und`, score 0, ambiguous; so is every text
    if nothing was learned. Columns of these names in `docs` are replaced.
    """
    added = ["lang_pred", "lang_score", "lang_ambiguous"]
    docs = docs.drop(*added)
    names = docs.columns
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*docs.schema, *map(T.StructField, added, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, unsure = model.predict(batch.column(names.index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(unsure)],
                [*names, *added])

    return docs.mapInArrow(trimmed(run), schema)


def keep_identified(docs: DataFrame) -> DataFrame:
    """`docs` without those whose language is unknown or ambiguous; columns as before."""
    found = predict(docs, fit(docs))
    sure = (F.col("lang_pred") != UNKNOWN) & ~F.col("lang_ambiguous")
    return found.filter(sure).select(*docs.columns)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    held_out = F.coalesce(crc_part(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred",
                        F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
