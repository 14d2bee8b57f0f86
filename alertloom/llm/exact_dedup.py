"""Exact deduplication by progressive refinement, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertloom.llm.common import ascii_lower, key_filter, mark_keys, without_rows
from alertloom.session import stage

#: Characters of a text that its prefix hash covers.
PREFIX_CHARS = 64


def normal_text(text: Column) -> Column:
    """The text that is compared: null as empty, A-Z in lower case."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def text_digest(text: Column) -> Column:
    return F.sha2(normal_text(text), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 digest_all: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Three levels refine the groups. (1) Lengths are counted. (2) Documents whose length is shared
    get a hash of their first characters, and length plus prefix hash are counted. (3) Documents
    whose pair is shared have their whole text hashed. A level hands on a bitmap of the
    shared keys, of bounded size, which is tested within the next scan: no text is ever shuffled,
    and a hot group is counted before it moves. A false hit only means one more hashed text.
    `text_sha256` is null where no level needed the whole text, unless `digest_all` asks for it.

    Of equal texts the largest id stays. Null texts equal empty ones. A null id counts as lower
    than any other; rows with one id and one text are one document, so they stay or go together.
    An empty table gives an empty result. Other columns of `docs` are not looked at.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    sized = base.withColumn("_len", F.octet_length(F.coalesce("_text", F.lit(""))))
    shared = F.col("count") > 1

    lengths = key_filter(sized.groupBy("_len").count().filter(shared), ["_len"])
    first = mark_keys(sized, lengths, ["_len"], "_same_length")
    head = normal_text(F.substring("_text", 1, PREFIX_CHARS))
    prefixed = first.withColumn("_head", F.when(F.col("_same_length"), F.xxhash64(head)))

    pairs = prefixed.filter("_same_length").groupBy("_len", "_head").count().filter(shared)
    second = mark_keys(prefixed, key_filter(pairs, ["_len", "_head"]), ["_len", "_head"], "_same_head")
    survives = F.col("_same_length") & F.col("_same_head")
    digest = text_digest(F.col("_text"))
    hashed = stage(
        second.select(
            "doc_id", "_len", survives.alias("_survives"),
            (digest if digest_all else F.when(survives, digest)).alias("text_sha256"),
        ),
        "exact-hashes",
    )

    groups = stage(
        hashed.filter("_survives").groupBy("_len", "text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1"),
        "exact-groups",
    )
    # Both sides are plain scans, so adaptive execution can split the key of a hot group.
    joined = hashed.join(groups, ["_len", "text_sha256"], "left")
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep = F.when(size > 1, F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), size.alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each group of equal texts, all columns kept."""
    dropped = exact_groups(docs).filter(~F.col("kept"))
    key = {"doc_id": F.col("doc_id"), "text_sha256": text_digest(F.col("text"))}
    return without_rows(docs, dropped, key)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest_all=True)


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id,
       count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""
