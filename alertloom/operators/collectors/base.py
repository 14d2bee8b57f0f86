"""What a collector is: one summary row per session, and a long table of its evidence.

A session is every log row of one connection uid. Summaries hold only values of bounded size
and are built from partial aggregates. Everything that grows with a session (findings, names,
hashes) is a row of the evidence table, so no session is ever gathered whole.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

# One row type for all kinds of evidence; fields a kind does not use stay null.
ITEM_FIELDS = {
    "value": "string",
    "type": "string",
    "direction": "string",
    "count": "bigint",
    "source": "string",
    "content": "string",
    "examples": "array<string>",
    "reasons": "array<string>",
    "filenames": "array<string>",
    "mime_types": "array<string>",
    "severity": "string",
    "avg_risk_score": "int",
    "directions": "array<string>",
    "total_size_bytes": "bigint",
    "example_filenames": "array<string>",
    "threat_name": "string",
}
LAST = 2**63 - 1


class Collector(Protocol):
    """A user-defined summary of sessions; register one under its log's name."""

    name: str

    def prepare(self, rows: DataFrame) -> DataFrame:
        """Row-wise work to be done once, before the rows are staged."""

    def totals(self, rows: DataFrame) -> DataFrame:
        """Aggregates of each session (uid, ...), from which the other two are derived."""

    def summary(self, totals: DataFrame) -> DataFrame:
        """uid, analysis, statistics and context structs, one row per reported session."""

    def evidence(self, rows: DataFrame, totals: DataFrame) -> DataFrame:
        """uid, collector, kind, ord, item: any number of rows per session."""


def arrival() -> Column:
    """Order of the rows of a session."""
    return F.struct("ts_us", "row_id")


def first_value(value: Column) -> Column:
    """First non-empty text of a session."""
    return F.min_by(F.when(value != "", value), F.when(value != "", arrival()))


def item(**fields: Column) -> Column:
    return F.struct(*[
        fields[name].cast(kind).alias(name) if name in fields
        else F.expr(f"cast(null as {kind}) as `{name}`")
        for name, kind in ITEM_FIELDS.items()
    ])


def position(*keys: Column | int) -> Column:
    """Sort position of an evidence row within its session."""
    padded = [*keys, *[0] * (4 - len(keys))]
    return F.struct(*[
        (k if isinstance(k, Column) else F.lit(k)).cast("long").alias(f"o{i}")
        for i, k in enumerate(padded)
    ])


def evidence_rows(df: DataFrame, collector: str, kind: str | Column, ord: Column,
                  item: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(
        "uid", F.lit(collector).alias("collector"), kind.alias("kind"),
        ord.alias("ord"), item.alias("item"),
    )


def first_n(df: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first n rows per key. Spark cuts to n per key before it shuffles."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rn", rn).where(F.col("rn") <= n)
