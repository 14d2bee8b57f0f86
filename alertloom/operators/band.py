"""Best row in an open time band around each probe, without forming probe-row pairs.

For a band of fixed width the time line is cut into blocks exactly as long as a band, so a band
is always the end of one block plus the start of the next. Running maxima inside blocks then
answer every probe in one sorted pass, however many rows share its key. Blocks are cut again
into one-second cells, so that a hot key or a hot block is spread over many window groups:
a cell holds at most one row per microsecond, a block at most one row per cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MICROS = 1_000_000


def _block(t: Column, width: int) -> Column:
    return ((t - F.pmod(t, F.lit(width))) / width).cast("long")


def _cell(t: Column, width: int) -> Column:
    return F.floor(F.pmod(t, F.lit(width)) / MICROS).cast("int")


def near_rows(probes: DataFrame, rows: DataFrame, keys: list[str], half_us: int) -> DataFrame:
    """Rows whose key some probe has within reach: a semi join on key and coarse time slot.

    A superset of the rows in the bands, cut before anything is shuffled by time. The result is
    meant to be staged as it is, so adaptive execution may split the join on a hot key.
    """
    slot = F.floor(F.col("at_us") / half_us)
    wanted = probes.select(
        *keys, F.explode(F.sequence(slot - 1, slot + 1)).alias("_slot")
    ).distinct()
    return (
        rows.withColumn("_slot", F.floor(F.col("ts_us") / half_us))
        .join(wanted, [*keys, "_slot"], "left_semi")
        .drop("_slot")
    )


def band_best(probes: DataFrame, rows: DataFrame, keys: list[str], half_us: int) -> DataFrame:
    """The greatest candidate within `at_us - half_us < ts_us < at_us + half_us`, per probe.

    probes: distinct keys, at_us. rows: keys, ts_us, cand (a struct, compared by its leading
    fields). Both are read twice, so they should be staged or cheap. Returns keys, at_us, best;
    probes with an empty band are left out.
    """
    width = 2 * half_us - 1
    none = F.lit(None).cast(rows.schema["cand"].dataType)
    cell_keys = [*keys, "block", "cell"]

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {"block": _block(F.col("t"), width), "cell": _cell(F.col("t"), width)}
        )

    # Copies of one key and instant collapse before any window or join sees them.
    instants = (
        placed(rows.select(*keys, F.col("ts_us").alias("t"), "cand"))
        .groupBy(*cell_keys, "t").agg(F.max("cand").alias("cand"))
    )
    edges = placed(
        probes.select(
            *keys, "at_us",
            F.explode(F.array(
                F.struct((F.col("at_us") - half_us + 1).alias("t"), F.lit(False).alias("is_end")),
                F.struct((F.col("at_us") + half_us - 1).alias("t"), F.lit(True).alias("is_end")),
            )).alias("edge"),
        ).select(*keys, "at_us", "edge.*")
    )

    # Within the cells that hold an edge: rows up to the end, or from the start on.
    edge_cells = edges.select(*cell_keys).distinct()
    close = instants.join(edge_cells, cell_keys, "left_semi").select(
        *cell_keys, "t", "cand", F.lit(None).cast("long").alias("at_us"),
        F.lit(None).cast("boolean").alias("is_end"),
    )
    in_cell = Window.partitionBy(*cell_keys)
    up_to = in_cell.orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    from_on = in_cell.orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, 0)
    within = (
        close.unionByName(edges.withColumn("cand", none))
        .withColumn("head", F.max("cand").over(up_to))
        .withColumn("rest", F.max("cand").over(from_on))
        .where(F.col("at_us").isNotNull())
        .select(*cell_keys, "at_us", "is_end",
                F.when(F.col("is_end"), F.col("head")).otherwise(F.col("rest")).alias("inner"))
    )

    # Whole cells before the end, or after the start, in the block of the edge.
    in_block = Window.partitionBy(*keys, "block")
    before = in_block.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    after = in_block.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        instants.select(*cell_keys, "cand")
        .unionByName(edges.select(*cell_keys, none.alias("cand")))
        .groupBy(*cell_keys).agg(F.max("cand").alias("top"))
        .withColumn("before", F.max("top").over(before))
        .withColumn("after", F.max("top").over(after))
        .drop("top")
    )
    outer = F.when(F.col("is_end"), F.col("before")).otherwise(F.col("after"))
    return (
        within.join(cells, cell_keys)
        .groupBy(*keys, "at_us")
        .agg(F.max(F.greatest("inner", outer)).alias("best"))
        .where(F.col("best").isNotNull())
    )
