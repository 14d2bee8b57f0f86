"""How the sources of a language differ in their terms, from bitmaps of terms by count."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from alertloom.llm.common import bound_batches
from alertloom.operators.numbering import number_rows
from alertloom.session import stage

#: Documents of its language that a kept term stands in.
MIN_DOCS = 10
#: Shares are whole numbers of this unit, of counts with so much added.
UNIT, ADDED = 1_000_000_000, 2
#: Terms that are reported for each source.
TOP_TERMS = 10
#: Terms of groups whose counts a task holds before it hands them on, but for those of one more batch.
HELD_TERMS = 1 << 18
#: Term numbers that a bitmap covers.
CHUNK = 1024
#: Sources whose bitmaps one task holds at a time, twice.
BLOCK = 32

#: ASCII letters in lower case and bytes of other characters as they are; all else ends a term.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and documents that hold the term; null term: none in the group.

    Null text, lang and source are read as empty. Every group has a row with a null term, so that it
    is known even without terms. Each task counts before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
        for batch in batches:
            for lang, source, text in zip(
                    batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                terms = text.as_py().encode().translate(_TERMS).split()
                counts, held = found.setdefault((lang, source), (Counter(), Counter()))
                counts.update(terms)
                held.update(set(terms))
            if sum(len(counts) for counts, _ in found.values()) >= HELD_TERMS:
                yield from _count_rows(found)
                found = {}
        yield from _count_rows(found)

    empty = F.lit("")
    narrow = docs.select(*(F.coalesce(c, empty).alias(c) for c in ("lang", "source", "text")))
    counted = narrow.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    named = counted.withColumn("term", F.col("term").cast("string"))
    return named.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _count_rows(found: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]]) -> Iterator[pa.RecordBatch]:
    """A batch for each group: the null term, and each term with its counts."""
    for group, (counts, held) in found.items():
        columns = [pa.repeat(name, len(counts) + 1) for name in group]
        columns += [pa.array([None, *counts], pa.binary()), pa.array([0, *counts.values()], pa.int64()),
                    pa.array([0, *map(held.__getitem__, counts)], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a count in UNITs, exact for counts of any size."""
    whole = lambda c: c.cast("decimal(20,0)")
    top = whole(count + ADDED) * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", top, whole(total + terms * 2)) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are below 2^30, so no step exceeds a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _share(count: int, total: int, terms: int) -> int:
    return 1 + UNIT * (count + ADDED) // (total + 2 * terms)


class Levels:
    """The bitmaps of one source in one chunk: which terms have each count."""

    def __init__(self, at: np.ndarray, n: np.ndarray, total: int, terms: int) -> None:
        self.counts, level = np.unique(n, return_inverse=True)
        flags = np.zeros((len(self.counts), CHUNK), np.uint8)
        flags[level, at] = 1
        self.bits = np.packbits(flags, axis=1).view(np.uint64)
        self.total, self.terms = total, terms
        self.shares = np.array([_share(int(c), total, terms) for c in self.counts], np.int64)
        self.zero = _share(0, total, terms)


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def joint_value(a: Levels, b: Levels) -> int:
    """What terms that both sources hold add, beyond what each count adds beside a zero.

    A joint cell is the popcount of two bitmaps' AND. The zeros are the complement, so they are
    counted from the margins (`margins`), and each cell carries the difference.
    """
    cells = np.bitwise_count(a.bits[:, None] & b.bits[None]).sum(axis=2, dtype=np.int64)
    p, q = a.shares[:, None], b.shares[None]
    none = _distances(np.int64(a.zero), np.int64(b.zero))
    apart = _distances(p, np.int64(b.zero)) + _distances(np.int64(a.zero), q)
    return int((cells * (_distances(p, q) - apart + none)).sum())


def joint_values(counts: DataFrame) -> DataFrame:
    """lang, a, b, value: the joint cells' part of each pair of sources, a < b.

    `counts` has lang, source, id (term number), n, total, terms. Sources of a chunk are dealt to
    blocks of bounded size by their number, and each pair of blocks is a group of its own, so a
    group holds at most 2 * BLOCK sources times CHUNK terms however many sources there are.
    """
    sources = number_rows(counts.select("lang", "source").distinct(), [F.col("lang"), F.col("source")], name="no")
    blocks = sources.select("lang", "source", (F.col("no") / BLOCK).cast("long").alias("block"))
    span = blocks.groupBy("lang").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    dealt = stage(blocks.join(span, "lang"), "source-blocks")
    placed = counts.join(dealt, ["lang", "source"]).withColumn("chunk", (F.col("id") / CHUNK).cast("long"))
    other = F.explode(F.sequence("low", "high"))
    paired = placed.select("*", other.alias("other")).select(
        "lang", "chunk", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
        "block", "source", (F.col("id") % CHUNK).cast("int").alias("at"), "n", "total", "terms")

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by([("source", "ascending")])
        names = order.column("source").to_pylist()
        edges = [i for i, s in enumerate(names) if i == 0 or s != names[i - 1]] + [len(names)]
        at, n, total, terms, block = (
            order.column(c).to_numpy() for c in ("at", "n", "total", "terms", "block"))
        levels = [(names[i], block[i], Levels(at[i:j], n[i:j], int(total[i]), int(terms[i])))
                  for i, j in zip(edges, edges[1:], strict=False)]
        crossing = order.column("first")[0].as_py() != order.column("second")[0].as_py()
        rows = [(x, y, joint_value(a, b)) for i, (x, u, a) in enumerate(levels)
                for y, v, b in levels[i + 1:] if not crossing or u != v]
        lang = order.column("lang")[0].as_py()
        return pa.Table.from_arrays(
            [pa.array([lang] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()),
             pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
            ["lang", "a", "b", "value"])

    parts = paired.groupBy("lang", "chunk", "first", "second").applyInArrow(
        run, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def margins(pairs: DataFrame, levels: DataFrame) -> DataFrame:
    """lang, a, b, value: what each count of `a` adds beside a zero of `b`, less what two zeros add."""
    none = distance(F.col("zero_a"), F.col("zero_b"))
    own = share(F.col("n"), F.col("total_a"), F.col("terms"))
    met = pairs.join(levels.withColumnRenamed("source", "a"), ["lang", "a"])
    return met.groupBy("lang", "a", "b").agg(
        F.sum(F.col("held") * (distance(own, F.col("zero_b")) - none)).alias("value"))


def pair_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value for every ordered pair of sources of a language."""
    sided = lambda s: groups.select(
        "lang", F.col("source").alias(s), F.col("total").alias(f"total_{s}"),
        F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).alias(f"zero_{s}"),
        *(["terms"] if s == "a" else []))
    pairs = stage(sided("a").join(sided("b"), "lang").filter("a <> b"), "source-pairs")
    levels = stage(counts.groupBy("lang", "source", "n").agg(F.count("*").alias("held")), "count-levels")
    joint = joint_values(counts)
    base = pairs.select("lang", "a", "b", F.coalesce(
        F.col("terms") * distance(F.col("zero_a"), F.col("zero_b")), F.lit(0)).alias("value"))
    own = margins(pairs, levels)
    turned = [t.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value") for t in (own, joint)]
    every = base
    for more in (own, joint, *turned):
        every = every.unionByName(more)
    return every.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far sources of a language are apart, and by which terms.

    Part `pair` has the other sources of the language, part `term` the `top` terms that a source
    uses more than its language does. Null text, lang and source are read as empty; a group
    without terms has its pairs, of value 0 where the language keeps no term. Repeated rows
    count as often as they stand there, ties rank by the item's UTF-8 bytes, texts may be of any length, other
    columns are not looked at, and an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    found = stage(term_counts(docs), "term-counts")
    kept = (
        found.filter("term IS NOT NULL").groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= min_docs)
    )
    numbered = stage(number_rows(kept, [F.col("lang"), F.col("lang_n"), F.col("term")], name="id"), "kept-terms")
    counted = stage(found.join(numbered.drop("docs"), ["lang", "term"]).drop("docs"), "kept-counts")

    vocabulary = numbered.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = stage(
        found.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
        .select("lang", "source", zero("total"), zero("terms"), zero("lang_total")),
        "groups")
    told = stage(counted.join(groups, ["lang", "source"]), "told-counts")

    pairs = pair_values(told, groups).select("lang", F.col("a").alias("source"),
                                             F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    terms = told.filter(p > q).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                      distance(p, q).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources, and the terms that set a source apart, of `documents`."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), vocabulary AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0)::HUGEINT AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), shares AS (
  SELECT lang, source, term, n,
         1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p,
         1 + (1000000000 * (lang_n + 2)) // (lang_total + 2 * v) AS q
  FROM cells JOIN vocabulary USING (lang)
), pairs AS (
  SELECT x.lang, x.source, y.source AS item FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
), apart AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), items AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value
  FROM pairs LEFT JOIN apart USING (lang, source, item)
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM items
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
