"""Near-duplicates by bottom-k sketches from one hash function, verified on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from alertloom.llm.common import key_filter, mark_keys, trimmed, without_rows
from alertloom.llm.components import components
from alertloom.session import stage

WORDS = 5
#: Links need 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: Retained values of a set: its smallest hashes.
SKETCH = 48
#: Of the retained values two linked sets share at least so many, or three quarters of a smaller
#: set: among the 48 smallest hashes of a union each is shared with a chance of 0.75 or more, so
#: fewer than 18 has a chance below 1e-8.
SHARED = 18
#: Pairs whose estimated similarity is lower are not verified; 0.75 is 5 standard errors above.
ESTIMATE = 0.42
#: A set's difference from a leader is taken along up to this size; pairs of sets without one keep the other bounds.
APART = 512


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text.

    A-Z in lower case; words end at ASCII blanks; with fewer words than five, all of them are the
    one shingle; without a word there is none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    digest = xxhash.xxh3_64_intdigest
    last = ends[min(WORDS, len(words)) - 1:].tolist()
    hashes = [digest(joined[a:b]) for a, b in zip(starts, last, strict=False)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_shingles, key (identifies the set; null if empty), sketch of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(keys, pa.binary()), pa.array([s[:SKETCH] for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "digest", "n_shingles", "key", "sketch"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", nameless_digest().alias("digest"))
    return narrow.mapInArrow(trimmed(run), "doc_id long, digest string, n_shingles long, key binary, sketch array<long>")


def nameless_digest() -> Column:
    """What tells documents without an id apart: a digest of the text, null for all others."""
    return F.when(F.col("doc_id").cast("long").isNull(), F.sha2(F.coalesce("text", F.lit("")), 256))


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def postings(classes: DataFrame) -> DataFrame:
    """Inverted lists of retained values: value, df, rep, n, weight.

    Two sets that share `SHARED` of their retained values also share one of the rarest
    `size - SHARED + 1` of each, whatever order of rarity is used. So a set is listed under its
    rarest values only, and values that stand in no other sketch are listed nowhere; lists of
    passages that very many documents hold stay short. `weight` is high for sets whose values are common.
    """
    rows = classes.select("rep", F.col("n_shingles").alias("n"), F.size("sketch").alias("k"),
                          F.explode("sketch").alias("value"))
    common = stage(rows.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "common-values")
    marked = mark_keys(rows, key_filter(common, ["value"]), ["value"], "_common").filter("_common")
    found = marked.select("value", "rep", "n", "k").join(common, "value")
    own = Window.partitionBy("rep")
    need = F.least(F.lit(SHARED), F.ceil(F.col("n") * SIMILAR / 100).cast("int"))
    ranked = (
        found.withColumn("_common", F.count("*").over(own))
        .withColumn("weight", F.sum(F.log("df")).over(own))
        .withColumn("_rank", F.row_number().over(own.orderBy("df", "value")))
    )
    within = F.col("_rank") + F.col("k") - F.col("_common") <= F.col("k") - need + 1
    return stage(ranked.filter(within).select("value", "df", "rep", "n", "weight"), "postings")


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * SIMILAR


def list_leaders(lists: DataFrame) -> DataFrame:
    """value, pivot, pivot_n, central: two sets of each list, the most central and a random one."""
    pick = lambda by: F.max(F.struct(by, "rep", "n"))
    both = lists.groupBy("value").agg(
        pick(F.col("weight")).alias("c"), pick(F.xxhash64("rep").alias("weight")).alias("r"))
    as_row = lambda c, central: F.struct(
        F.col(f"{c}.rep").alias("pivot"), F.col(f"{c}.n").alias("pivot_n"), F.lit(central).alias("central"))
    return stage(both.select("value", F.inline(F.array(as_row("c", True), as_row("r", False)))), "leaders")


def leader_pairs(lists: DataFrame, leaders: DataFrame) -> DataFrame:
    """a, b: every set with the leaders of each of its lists."""
    met = lists.join(leaders, "value").filter(_sizes_fit(F.col("n"), F.col("pivot_n")))
    return met.filter("rep <> pivot").select(
        F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()


def open_lists(lists: DataFrame, reach: Column) -> DataFrame:
    """The lists that hold sets of several components, without sets that fit no size in them.

    `reach` is the largest partner size that a set can be linked with.
    """
    sizes = lists.groupBy("value").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least_n"))
    sizes = stage(sizes.filter("lo <> hi").select("value", "least_n"), "mixed-lists")
    return lists.join(sizes, "value").filter(reach >= F.col("least_n")).drop("least_n")


def shared_sizes(sets: DataFrame) -> DataFrame:
    """rep, s: how many shingles of each full set stand in another one too."""
    rows = sets.select("rep", F.explode("shingles").alias("value"))
    common = stage(rows.groupBy("value").count().filter("count > 1").select("value"), "common-shingles")
    marked = mark_keys(rows, key_filter(common, ["value"]), ["value"], "_common").filter("_common")
    return marked.select("rep", "value").join(common, "value").groupBy("rep").agg(F.count("*").alias("s"))


def differences(rows: DataFrame, full: DataFrame) -> DataFrame:
    """rep, pivot, n, component, pivot_size, missing, apart: what tells a set from a leader it was compared with.

    `missing` counts the leader's shingles that the set lacks; `apart` holds these and the set's own ones that
    the leader lacks. Two sets share as many shingles as the leader has, less what each misses, plus what
    they have in common in `apart`, so their intersection is known without looking at the full sets.
    """
    named = rows.select("rep", "pivot", "n", "component").distinct()
    both = named.join(full.toDF("rep", "_own"), "rep").join(full.toDF("pivot", "_lead"), "pivot")
    lacks, adds = F.array_except("_lead", "_own"), F.array_except("_own", "_lead")
    found = both.select("rep", "pivot", "n", "component", F.size("_lead").alias("pivot_size"),
                        F.size(lacks).alias("missing"), F.concat(lacks, adds).alias("apart"))
    return stage(found.filter(F.size("apart") <= APART), "differences")


def difference_prefixes(told: DataFrame) -> DataFrame:
    """The rarest elements of each set's difference: pivot, element, rep, n, component, d, near, rest, need.

    Sets are linked if (100 + SIMILAR) times their distance, the size of their symmetric difference, is at
    most (100 - SIMILAR) times both sizes together. The distance is both distances `d` from the leader
    less twice what the differences share. So if a set is not linked with the leader (not `near`), any partner
    shares at least `need` elements of its own difference with it, by the triangle inequality at least one;
    and of its rarest ones, all but the last `need - 1`, one is shared. `rest` counts the elements that come
    after this one. With a near partner, a set that is not near may share fewer, so more of its elements are listed.
    """
    far, close = 100 + SIMILAR, 100 - SIMILAR
    sized = told.select("rep", "pivot", "n", "component", "pivot_size", F.size("apart").alias("d"), "apart")
    sized = sized.withColumn("near", F.col("d") * far <= (F.col("n") + F.col("pivot_size")) * close)
    rows = sized.withColumn("element", F.explode("apart")).drop("apart")
    held = rows.groupBy("pivot", "element").agg(
        F.count("*").alias("df"), F.count_if(~F.col("near")).alias("_far")).filter("df > 1 AND _far > 0")
    own = Window.partitionBy("rep", "pivot")
    ranked = rows.join(held, ["pivot", "element"]).withColumn(
        "rest", F.count("*").over(own) - F.row_number().over(own.orderBy("df", "element")))
    need = F.floor((F.col("d") * far + (F.col("pivot_size") - F.col("n")) * close) / (2 * far)) + 1
    of_near = F.ceil((F.col("d") * far - (F.col("pivot_size") + F.col("n")) * close) / (far + close))
    within = F.col("rest") + 1 >= F.when(F.col("near"), need).otherwise(of_near)
    return stage(ranked.filter(within).select(
        "pivot", "element", "rep", "n", "component", "d", "near", "rest", need.alias("need")), "prefixes")


def told_links(told: DataFrame) -> DataFrame:
    """a, b: linked sets of different components whose differences from one leader are known.

    Sets that are both linked with the leader are in one component already. All others share one of the
    rarest elements of their differences, and that element's place bounds how many more they share; the
    pairs that are left are decided by their whole differences.
    """
    far, close = 100 + SIMILAR, 100 - SIMILAR
    rows = difference_prefixes(told)
    side = lambda name: rows.select(
        "pivot", "element", *(F.col(c).alias(f"{c}_{name}") for c in ("rep", "n", "component", "d", "near", "rest", "need")))
    strong = lambda name: F.col(f"rest_{name}") + 1 >= F.col(f"need_{name}")
    lacking = (F.col("d_a") + F.col("d_b")) * far - (F.col("n_a") + F.col("n_b")) * close
    meets = (
        (F.col("l.pivot") == F.col("r.pivot")) & (F.col("l.element") == F.col("r.element"))
        & (F.col("near_b") | ((F.col("rep_a") < F.col("rep_b")) & strong("a"))) & strong("b")
        & (F.col("component_a") != F.col("component_b")) & _sizes_fit(F.col("n_a"), F.col("n_b"))
        & (lacking <= (F.least("rest_a", "rest_b") + 1) * 2 * far)
    )
    met = side("a").filter("NOT near_a").alias("l").join(side("b").alias("r"), meets)
    pairs = stage(met.select(F.col("l.pivot").alias("pivot"), "rep_a", "rep_b", "n_a", "n_b").distinct(), "told-pairs")
    known = lambda name: told.select(
        "pivot", "pivot_size", *(F.col(c).alias(f"{c}_{name}") for c in ("rep", "missing", "apart")))
    both = pairs.join(known("a"), ["pivot", "rep_a"]).join(known("b").drop("pivot_size"), ["pivot", "rep_b"])
    shared = F.col("pivot_size") - F.col("missing_a") - F.col("missing_b") + F.size(F.array_intersect("apart_a", "apart_b"))
    linked = shared * far >= (F.col("n_a") + F.col("n_b")) * SIMILAR
    return both.filter(linked).select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))


def remaining_pairs(lists: DataFrame, parts: DataFrame, full: DataFrame, leaders: DataFrame,
                    met: DataFrame) -> DataFrame:
    """a, b: sets that share a list, may still be linked, and are in different components; once each.

    A link needs an intersection of `SIMILAR / (100 + SIMILAR)` of both sizes together, and a set
    cannot share more than the shingles that it has in common with any other listed set. That bound
    is exact and linear to compute. It leaves out the sets of a large group that were changed
    so much that they are linked with nothing, before anything is paired. Of the others, those whose `differences`
    from a list's leader are known are paired by these; only sets without one meet whole lists.
    """
    named = lists.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        "value", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mixed = stage(open_lists(stage(named, "named-postings"), F.col("n")), "open-postings")
    reach = F.floor(F.col("s") * (100 + SIMILAR) / SIMILAR) - F.col("n")
    names = stage(mixed.select("rep").distinct(), "open-sets")
    shared = shared_sizes(full.join(names, "rep", "left_semi"))
    left = mixed.join(shared, "rep").filter(F.col("s") * 100 >= F.col("n") * SIMILAR)
    left = open_lists(stage(left, "open-postings"), reach)
    pivots = leaders.filter("central").select("value", "pivot")
    left = left.join(pivots, "value").withColumns(
        {"a": F.least("rep", "pivot"), "b": F.greatest("rep", "pivot")}).join(met, ["a", "b"], "left")
    left = left.withColumn("i", F.when(F.col("rep") == F.col("pivot"), F.col("n")).otherwise(F.col("common")))
    # The values of a set's open lists tell in which list a pair meets first; at most SKETCH of them.
    left = stage(left.withColumn("own", F.sort_array(F.collect_list("value").over(
        Window.partitionBy("rep")))).filter("rep <> pivot"), "open-postings")  # leaders have met their lists
    told = differences(left.filter("common IS NOT NULL"), full)
    marked = left.join(told.select("rep", "pivot", F.lit(True).alias("told")), ["rep", "pivot"], "left").withColumn(
        "told", F.col("told").isNotNull())
    untold = stage(marked.filter("NOT told"), "untold-postings")
    beside = marked.join(untold.select("value").distinct(), "value", "left_semi")
    side = lambda rows, name: rows.select(
        "value", *(F.col(c).alias(f"{c}_{name}") for c in ("rep", "n", "s", "i", "component", "own", "told")))
    need = (F.col("n_a") + F.col("n_b")) * SIMILAR / (100 + SIMILAR)
    over_pivot = F.least("i_a", "i_b") + F.least(F.col("s_a") - F.col("i_a"), F.col("s_b") - F.col("i_b"))
    unknown = F.col("i_a").isNull() | F.col("i_b").isNull()
    enough = (F.least("s_a", "s_b") >= need) & (unknown | (over_pivot >= need))
    meets = (
        (F.col("l.value") == F.col("r.value")) & (F.col("told_b") | (F.col("rep_a") < F.col("rep_b")))
        & (F.col("component_a") != F.col("component_b"))
        & enough & _sizes_fit(F.col("n_a"), F.col("n_b"))
        & (F.array_min(F.array_intersect("own_a", "own_b")) == F.col("l.value"))
    )
    pairs = side(untold, "a").alias("l").join(side(beside, "b").alias("r"), meets)
    pairs = pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
    return pairs.union(told_links(told)).distinct()


def likely_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose similarity, estimated from the sketch of their union, may reach the limit."""
    own = classes.select("rep", "sketch")
    both = (
        pairs.join(own.toDF("a", "_sa"), "a").join(own.toDF("b", "_sb"), "b")
        .withColumn("_union", F.slice(F.array_sort(F.array_union("_sa", "_sb")), 1, SKETCH))
    )
    shared = F.size(F.array_intersect(F.array_intersect("_union", "_sa"), "_sb"))
    return both.filter(shared >= F.size("_union") * ESTIMATE).select("a", "b")


def full_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, shingles of the documents that stand for their class in some list."""
    bitmap = key_filter(reps, ["rep"])
    marked = mark_keys(_narrow(docs), bitmap, ["doc_id"], "_listed").filter("_listed").drop("_listed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"])

    found = marked.mapInArrow(trimmed(run), "rep long, shingles array<long>")
    return stage(found.join(reps, "rep", "left_semi"), "full-sets")


def intersections(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, common, linked: sizes of the intersections of the full sets, and whether they suffice."""
    both = pairs.join(sets.toDF("a", "_a"), "a").join(sets.toDF("b", "_b"), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("_a", "_b")).alias("common"),
                          (F.size("_a") + F.size("_b")).alias("_sizes"))
    linked = F.col("common") * 100 >= (F.col("_sizes") - F.col("common")) * SIMILAR
    return stage(counted.select("a", "b", "common", linked.alias("linked")), "intersections")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, as `told_groups` finds them."""
    return told_groups(docs).drop("digest")


def told_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, digest (of documents without an id), n_shingles, component_id, kept.

    Documents with equal sets form a class first, and one of each class stands for it. Candidates
    come from the inverted lists in two rounds: each set meets leaders of its lists, verified
    links make components, and then sets of one list that are still in different components and
    may be linked at all meet. So a large group of near copies costs a few comparisons per member, no
    link between components is missed, and pairs within one, which change nothing, are not formed.

    Documents without a word, null texts included, link with nothing. A row without an id belongs
    to its class but names none; it stays only if no row of its class has an id. Rows that share an
    id are one document, linked with whatever one of them links with. Other columns are not looked
    at; an empty table gives an empty result.
    """
    known = stage(sketches(docs), "sketches")
    sets = known.filter("key IS NOT NULL")
    classes = stage(
        sets.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
                                F.first("sketch").alias("sketch")),
        "classes")
    named = classes.filter("rep IS NOT NULL")
    lists = postings(named)
    full = full_sets(docs, stage(lists.select("rep").distinct(), "listed"))

    leaders = list_leaders(lists)
    likely = stage(likely_pairs(stage(leader_pairs(lists, leaders), "leader-pairs"), named), "likely-pairs")
    met = intersections(likely, full)
    links = met.filter("linked").select("a", "b")
    rest = stage(remaining_pairs(lists, components(links), full, leaders, met.drop("linked")), "remaining-pairs")
    more = intersections(stage(likely_pairs(rest, named), "likely-pairs"), full)
    parts = components(links.union(more.filter("linked").select("a", "b")))

    placed = stage(
        classes.select("key", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", F.coalesce("component", "rep").alias("component_id")),
        "placed-classes")
    grouped = sets.join(placed, "key").select("doc_id", "digest", "n_shingles", "component_id")
    alone = known.filter("key IS NULL").select(
        "doc_id", "digest", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each group of near-duplicates, all columns kept.

    Documents without an id are told apart by their texts, so one that goes takes no other along.
    """
    dropped = told_groups(docs).filter(~F.col("kept")).select("doc_id", "digest")
    return without_rows(docs, dropped, {"doc_id": F.col("doc_id").cast("long"), "digest": nameless_digest()})


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
