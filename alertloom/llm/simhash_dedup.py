"""Near-duplicates by fingerprints of three-word shingles, matched through nearby Golay code words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from alertloom.llm.common import bound_batches
from alertloom.llm.components import components
from alertloom.llm.golay import near_codewords
from alertloom.session import stage

WORDS = 3
SEED = 42
#: Fingerprints link at so many differing bits or fewer; the keys below hold for 2.
DIFFERENT = 2
#: Lowest bit and length of each segment of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of a key are compared with each other up to so many; a fuller key's fingerprints go
#: on to keys that hold linked ones only.
COMPARED = 64
#: Shingle hashes whose bits are counted at a time.
SLICE = 1 << 16
FINGERPRINT_BITS = 64


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text as a signed number; zero without words.

    A-Z in lower case; words end at ASCII blanks; with fewer than three, all of them are the one
    shingle. A bit is set if more than half of all shingles, repeats included, have it in their XXH64.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(WORDS, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    bits = np.zeros(FINGERPRINT_BITS, np.int64)
    for low in range(0, len(last), SLICE):
        part = zip(starts[low:low + SLICE].tolist(), last[low:low + SLICE], strict=False)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], "<u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(last), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())],
                                             ["doc_id", "print"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, print long")


def segment_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """at, key: the keys of each fingerprint, at most 18.

    With two differing bits in three segments, one segment agrees. The others differ in at most two
    bits each, so the next one shares a near code word. A key is a segment's number, its bits,
    and a code word's index of the segment after it.
    """
    parts = [(prints.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << size) - 1)
             for low, size in SEGMENTS]
    places, keys = [], []
    for number, exact in enumerate(parts):
        at, index = near_codewords(parts[(number + 1) % len(parts)])
        places.append(at)
        keys.append((number << 34) | (exact[at] << 12) | index)
    return np.concatenate(places), np.concatenate(keys)


def keyed_prints(prints: DataFrame) -> DataFrame:
    """key, print, size: the fingerprints of keys that `size` > 1 of them share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("print").to_numpy(zero_copy_only=False).astype(np.int64)
            at, keys = segment_keys(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[at])], ["key", "print"])

    rows = prints.select("print").mapInArrow(run, "key long, print long")
    sized = rows.withColumn("size", F.count("*").over(Window.partitionBy("key")))
    return stage(sized.filter("size > 1"), "shared-keys")


def compared_links(keyed: DataFrame, most: int) -> DataFrame:
    """a, b: linked fingerprints of keys that few share; each meets less than `most` others."""
    few = keyed.filter(F.col("size") <= most)
    near = (
        (F.col("l.key") == F.col("r.key")) & (F.col("l.print") < F.col("r.print"))
        & (F.bit_count(F.col("l.print").bitwiseXOR(F.col("r.print"))) <= DIFFERENT)
    )
    return few.alias("l").join(few.alias("r"), near).select(F.col("l.print").alias("a"), F.col("r.print").alias("b"))


def between_links(keyed: DataFrame, most: int) -> DataFrame:
    """a, b: enough links to connect all linked fingerprints of the keys that many share.

    Fingerprints are linked if, and only if, some word is at most one bit from both. So each fingerprint stands
    under itself and the 64 words one bit away, and is linked with the smallest under the same word.
    A word holds 65 fingerprints at most, all of them linked, and no pair is formed in vain.
    """
    many = keyed.filter(F.col("size") > most).select("print").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(FINGERPRINT_BITS - 1)),
                        lambda b: F.col("print").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    rows = many.select("print", F.explode(F.concat(F.array("print"), flips)).alias("word"))
    least = F.min("print").over(Window.partitionBy("word"))
    return rows.select(least.alias("a"), F.col("print").alias("b")).filter("a <> b").distinct()


def simhash_groups(docs: DataFrame, compared: int = COMPARED) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (hex), component_id.

    Equal fingerprints form a class first, and links are between classes. A text without words,
    null included, has fingerprint zero and is linked like any other. A row without an id belongs to
    its class, through which others are linked, and names no component; where no row of a component
    has an id, component_id is null. Rows that share an id are told apart by their texts. Other
    columns are not looked at; texts may be of any length; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    known = stage(fingerprints(docs), "fingerprints")
    classes = stage(known.groupBy("print").agg(F.min("doc_id").alias("rep")), "fingerprint-classes")
    keyed = keyed_prints(classes)
    links = stage(compared_links(keyed, compared).unionAll(between_links(keyed, compared)).distinct(), "links")
    parts = components(links).withColumnRenamed("node", "print")
    placed = stage(
        classes.join(parts, "print", "left").withColumn("component", F.coalesce("component", "print")), "placed")
    named = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = stage(placed.join(named, "component").select("print", "component_id"), "component-ids")
    as_hex = F.lpad(F.lower(F.hex("print")), FINGERPRINT_BITS // 4, "0")
    return known.join(ids, "print").select("doc_id", as_hex.alias("fingerprint"), "component_id")


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each row of `documents`."""
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
