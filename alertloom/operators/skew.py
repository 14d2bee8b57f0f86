"""Semi joins that a hot key cannot pin to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 8


def salted_semi(rows: DataFrame, wanted: DataFrame, keys: list[str],
                salts: int = SALTS) -> DataFrame:
    """Rows whose keys occur in `wanted`; rows need a `row_id`.

    The distinct keys are repeated once per salt, so a key with a large share of the rows is
    spread over `salts` join partitions, and a later grouping by the keys combines on each of
    them before it shuffles. Where Spark finds the key side small it broadcasts it, by size.
    """
    every = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    repeated = wanted.select(*keys).distinct().withColumn("_salt", F.explode(every))
    salt = F.pmod(F.xxhash64("row_id"), F.lit(salts))
    return (
        rows.withColumn("_salt", salt).join(repeated, [*keys, "_salt"], "left_semi").drop("_salt")
    )
