"""Removal of repeated passages: strings of 400 bytes that also start anywhere else."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom.llm.bwt_repeats import repeated_starts
from alertloom.llm.common import bound_batches, key_filter, mark_keys
from alertloom.llm.window_anchors import LENGTH, anchored, context_slices, placed_anchors
from alertloom.session import stage

#: Different strings of one anchor that a transform takes together; larger groups go by window digests.
GROUP = 4096
#: Bytes of strings that one transform holds, but for the last group that is added.
BLOCK = 1 << 20


def _digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))


def anchor_counts(docs: DataFrame) -> DataFrame:
    """anchor: hashes that stand at two places or more, in whatever documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchored(t.encode())[0] for t in batch.column("text").to_pylist()]
            names, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], ["anchor", "n"])

    counts = _text(docs).mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return stage(counts.filter("n > 1").select("anchor"), "anchors")


def anchored_strings(docs: DataFrame, common: DataFrame) -> DataFrame:
    """anchor, string, key, place (of the anchor in it), n: different strings around repeated anchors and how often they stand.

    A string holds all windows of one anchor, so equal windows stand in strings of one anchor.
    Equal strings, as copies of documents have them, are counted and sent once per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, list] = {}
            for text in batch.column("text").to_pylist():
                data = text.encode()
                for anchor, at, a, b in zip(*(x.tolist() for x in placed_anchors(data)), strict=True):
                    string = data[a:b + LENGTH]
                    entry = held.setdefault(_digest(string), [anchor, string, 0, at - a])
                    entry[2] += 1
            keys, rows = list(held), list(held.values())
            for i in range(0, len(rows), 20_000):
                part = rows[i:i + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary()),
                     pa.array(keys[i:i + 20_000], pa.binary()), pa.array([r[2] for r in part], pa.int64()),
                     pa.array([r[3] for r in part], pa.int32())],
                    ["anchor", "string", "key", "n", "place"])

    found = _text(docs).mapInArrow(run, "anchor long, string binary, key binary, n long, place int")
    marked = mark_keys(found, key_filter(common, ["anchor"]), ["anchor"], "_common").filter("_common")
    grouped = marked.groupBy("anchor", "key").agg(
        F.sum("n").alias("n"), F.first("string").alias("string"), F.first("place").alias("place"))
    return stage(grouped, "strings")


def _starts(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges[::2].tolist(), (edges[1::2] - 1).tolist()


MARKS = "key binary, first array<int>, last array<int>"


def may_repeat(strings: list[bytes], places: list[int]) -> list[bool]:
    """For each string of one anchor, whether another one has a slice in common with it.

    If none has, no window of the string stands in another; and none stands in it twice, since
    it would have its anchor at two places.
    """
    slices = [[(k, xxhash.xxh3_64_intdigest(x)) for k, x in context_slices(*s)] for s in zip(strings, places, strict=True)]
    count = Counter(x for own in slices for x in own)
    return [any(count[x] > 1 for x in own) for own in slices]


def marks_by_transform(strings: DataFrame) -> DataFrame:
    """Repeated windows of the strings of groups of bounded size, from one transform per block.

    Rows come sorted by anchor. Of each group, the strings that may share a window with another one are
    gathered, until a block is full. The others need no transform: all their windows are
    repeated if the string stands at two places, else none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, bytes, int]] = []
        group: list[tuple[bytes, bytes, int]] = []
        places: list[int] = []
        alone: list[tuple[bytes, int]] = []
        size, last = 0, None

        def marked() -> pa.RecordBatch:
            flags = repeated_starts([r[1] for r in rows], LENGTH) if rows else []
            spans = [_starts(np.ones_like(f) if r[2] > 1 else f) for f, r in zip(flags, rows, strict=True)]
            kept = [(r[0], *s) for r, s in zip(rows, spans, strict=True) if s[0]]
            kept += [(key, [0], [end]) for key, end in alone]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in kept], pa.binary()), pa.array([x[1] for x in kept], pa.list_(pa.int32())),
                 pa.array([x[2] for x in kept], pa.list_(pa.int32()))], ["key", "first", "last"])

        def close_group() -> int:
            near = may_repeat([r[1] for r in group], places) if len(group) > 1 else [False] * len(group)
            rows.extend(r for r, is_near in zip(group, near, strict=True) if is_near)
            alone.extend((r[0], len(r[1]) - LENGTH) for r, is_near in zip(group, near, strict=True)
                         if not is_near and r[2] > 1)
            added = sum(len(r[1]) for r, is_near in zip(group, near, strict=True) if is_near)
            group.clear()
            places.clear()
            return added

        for batch in batches:
            for anchor, string, key, n, place in zip(*(batch.column(c).to_pylist() for c in (
                    "anchor", "string", "key", "n", "place")), strict=True):
                if anchor != last:
                    size += close_group()
                    if size >= BLOCK or len(alone) >= 20_000:
                        yield marked()
                        rows.clear()
                        alone.clear()
                        size = 0
                group.append((key, string, n))
                places.append(place)
                last = anchor
        close_group()
        if rows or alone:
            yield marked()

    dealt = strings.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.select("anchor", "string", "key", "n", "place").mapInArrow(run, MARKS)


def marks_by_digest(strings: DataFrame) -> DataFrame:
    """The same for groups that are too large for one task: windows are counted by a 128-bit digest.

    Exact but for digests that collide; every window is a row of its own, so no task holds a group.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, string, n in zip(*(batch.column(c).to_pylist() for c in ("key", "string", "n")), strict=True):
                places = range(len(string) - LENGTH + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(places), pa.binary()), pa.array(places, pa.int32()),
                     pa.array([n] * len(places), pa.int64()),
                     pa.array([_digest(string[i:i + LENGTH]) for i in places], pa.binary())],
                    ["key", "place", "n", "window"])

    rows = stage(strings.mapInArrow(windows, "key binary, place int, n long, window binary"), "windows")
    twice = stage(rows.groupBy("window").agg(F.sum("n").alias("n")).filter("n > 1").select("window"), "repeated-windows")
    places = rows.join(twice, "window").groupBy("key").agg(F.sort_array(F.collect_list("place")).alias("at"))
    return places.select("key", F.col("at").alias("first"), F.col("at").alias("last"))


def covered(docs: DataFrame, common: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_key (digest of the text), spans: which bytes of a text repeated strings cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            doc_keys, keys, begins, names = [], [], [], []
            for text in batch.column("text").to_pylist():
                data = text.encode()
                own = _digest(data)
                if own in seen or len(data) < LENGTH:
                    continue
                seen.add(own)
                for anchor, a, b in zip(*(x.tolist() for x in anchored(data)), strict=True):
                    doc_keys.append(own)
                    keys.append(_digest(data[a:b + LENGTH]))
                    begins.append(a)
                    names.append(anchor)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_keys, pa.binary()), pa.array(keys, pa.binary()), pa.array(begins, pa.int64()),
                 pa.array(names, pa.int64())], ["doc_key", "key", "begin", "anchor"])

    found = _text(docs).mapInArrow(run, "doc_key binary, key binary, begin long, anchor long")
    near = mark_keys(found, key_filter(common, ["anchor"]), ["anchor"], "_common").filter("_common")
    near = near.select("doc_key", "key", "begin").distinct()
    spans = F.transform(F.arrays_zip("first", "last"), lambda x: F.struct(
        (F.col("begin") + x["first"]).alias("a"), (F.col("begin") + x["last"] + LENGTH).alias("b")))
    hit = near.join(marks, "key").select("doc_key", F.explode(spans).alias("span"))
    return stage(hit.groupBy("doc_key").agg(F.collect_list("span").alias("spans")), "covered")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_key, spans (a, b in bytes, possibly overlapping) of every text with a repeated string."""
    common = anchor_counts(docs)
    strings = anchored_strings(docs, common)
    sizes = stage(strings.groupBy("anchor").agg(F.count("*").alias("different")).filter(F.col("different") > GROUP)
                  .select("anchor"), "large-anchors")
    large = stage(strings.join(sizes, "anchor", "left_semi"), "large-strings")
    usual = strings.join(sizes, "anchor", "left_anti")
    marks = stage(marks_by_transform(usual).unionAll(marks_by_digest(large)), "marks")
    return covered(docs, common, marks)


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that remain).

    Each byte goes that a string of 400 bytes covers which also starts at another place, in the same
    or any other document, judged on the input. What is cut may split a character, so `kept` is
    binary. Equal windows have their anchor at the same place, so they meet in strings of one
    anchor; these strings, different ones only, are indexed by Burrows-Wheeler transforms of bounded
    blocks. A text is known by the digest of its bytes, so null ids, repeated ids and repeated rows
    need no care: every row is answered. Null texts count as empty. Other columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    spans = repeated_spans(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_digest(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], ["doc_id", "text", "doc_key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                data = text.encode()
                kept, at, removed, runs = [], 0, 0, 0
                for a, b in _merged(own or []):
                    kept.append(data[at:a])
                    removed, runs, at = removed + b - a, runs + 1, b
                out.append((doc_id, len(data), removed, runs, b"".join([*kept, data[at:]])))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    keyed = rows.mapInArrow(digest, "doc_id long, text string, doc_key binary")
    marked = mark_keys(keyed, key_filter(spans, ["doc_key"]), ["doc_key"], "_hit")
    # Built-in functions answer what stays whole: `cut` behind `digest` would give each task a second Python process.
    untouched = marked.filter("NOT _hit").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    touched = marked.filter("_hit").join(spans, "doc_key", "left").select("doc_id", "text", "spans")
    return touched.mapInArrow(cut, REMOVED).unionAll(untouched)


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover; spans that touch are one run."""
    runs: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
