"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import reduce, wraps
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from alertloom.session import stage

#: Bytes of rows that a Python task holds at a time, but for a single longer row.
BATCH_BYTES = 4 << 20
#: A key filter has this many bitmaps of 4 KB, so its broadcast is 1 MB at the very most.
FILTER_BITMAPS = 256
_BITS = 32_768

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bound_batches(spark: SparkSession) -> None:
    """Cuts Arrow batches of this session by bytes, so that rows of any length need the same memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Returns what this process has freed to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The function of a `mapInArrow`, giving back its memory when its input ends.

    Spark keeps a Python worker for the stages to come, and its memory counts beside theirs.
    """
    @wraps(run)
    def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return with_end


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def crc_part(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def hashed_sample(rows: DataFrame, group: str, per_group: int, groups: int = 512) -> DataFrame:
    """`doc_id` and `group` of the `per_group` rows of each group whose hashed id is smallest.

    The groups' sizes give a hash limit that leaves little more than that many rows, so no task
    ranks a whole group. Only the `groups` largest groups are sampled, so their sizes can be broadcast.
    """
    sizes = rows.groupBy(group).count().orderBy(F.desc("count"), group).limit(groups)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / (1 << 40)
    near = (
        rows.select("doc_id", group).join(F.broadcast(sizes), group)
        .filter(draw * F.col("count") <= 1.5 * per_group + 20)
    )
    order = Window.partitionBy(group).orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = near.withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") <= per_group).select("doc_id", group)


def key_filter(keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A bitmap of the given keys, `_bucket, _bits`, of a size that does not depend on their number.

    With more keys than bits it lets nearly every row pass: work grows, results do not change.
    """
    slot = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITMAPS * _BITS))
    return (
        keys.select(slot.alias("_slot"))
        .groupBy((F.col("_slot") / _BITS).cast("int").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.col("_slot") % _BITS).alias("_bits"))
    )


def mark_keys(rows: DataFrame, bitmap: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Adds `name`: false if the row's key is certainly not among those of `bitmap`.

    The bitmap has at most FILTER_BITMAPS rows of 4 KB, so its broadcast is bounded.
    """
    slot = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITMAPS * _BITS))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_at") / 8).cast("int") + 1, 1)), 16, 10)
    hit = F.getbit(byte.cast("int"), (F.col("_at") % 8).cast("int")) == 1
    return (
        rows.withColumn("_slot", slot)
        .withColumn("_bucket", (F.col("_slot") / _BITS).cast("int"))
        .withColumn("_at", (F.col("_slot") % _BITS).cast("int"))
        .join(F.broadcast(bitmap), "_bucket", "left")
        .withColumn(name, F.col("_bits").isNotNull() & hit)
        .drop("_slot", "_bucket", "_at", "_bits")
    )


def without_rows(docs: DataFrame, dropped: DataFrame, key: dict[str, Column]) -> DataFrame:
    """`docs` without the rows whose key is in `dropped`; nulls equal nulls.

    `key` maps the columns of `dropped` to expressions over `docs`, the first of them cheap. Rows
    that the key filter clears by the first pass in the scan; only the others, the dropped rows and a few
    more, have the rest of their key computed and are shuffled. They meet the dropped keys in a left
    join, since a semi or anti join would be pushed below the filter, to all rows.
    """
    first, *rest = key
    gone = stage(dropped.select(*(F.col(k).alias(f"__gone_{k}") for k in key), F.lit(True).alias("__gone")).distinct(),
                 "dropped-keys")
    bitmap = key_filter(gone, [f"__gone_{first}"])
    packed = docs.select(F.struct("*").alias("row"), key[first].alias(f"__{first}"))  # no name can clash
    marked = mark_keys(packed, bitmap, [f"__{first}"], "__seen")
    suspects = marked.filter("__seen").select("row.*", F.col("row").alias("__row"), f"__{first}")
    suspects = suspects.select("__row", f"__{first}", *(key[k].alias(f"__{k}") for k in rest))
    same = reduce(and_, (F.col(f"__{k}").eqNullSafe(F.col(f"__gone_{k}")) for k in key))
    left = suspects.join(gone, same, "left").filter("__gone IS NULL").select(F.col("__row").alias("row"))
    return marked.filter(~F.col("__seen")).select("row").unionByName(left).select("row.*")
