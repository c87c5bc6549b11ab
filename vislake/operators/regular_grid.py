"""Irregular readings onto a regular grid of periods, empty periods filled or marked (problem 1).

Readings are first reduced to one row per (series, period) before any shuffle of raw rows. Consecutive occupied
periods are then paired with lead, and only the grid times between the two are exploded. The series are cut into
blocks of BLOCK periods, so that no task ever holds more than one block of one series: the head of the next
occupied block is handed to a block as one extra row, and the two ends of the grid are extra rows as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Periods of one series that a task sorts at once.
BLOCK = 4096
#: Gaps of at most this many periods are interpolated; longer ones are marked and stay NULL.
MAX_GAP = 5

MEASURED, INTERPOLATED, HELD, GAP, BEFORE, AFTER = "measured", "interpolated", "held", "gap", "before_first", "after_last"


def to_grid(rows: DataFrame, keys: list[str], t_us: str, value: str, t0_us: str, stop_us: str, grid_us: str, block: int = BLOCK, max_gap: int = MAX_GAP) -> DataFrame:
    """One row per key and grid period [t0 + k*grid, t0 + (k+1)*grid) with t0 <= start < stop.

    rows holds the usable readings; t0_us, stop_us and grid_us are BIGINT columns, equal within a key.
    Returned: keys, period_start_us, value (mean of the period's readings), n_readings, gap_periods (length of the
    run of empty periods), mark: measured | interpolated (inner gap of up to max_gap periods, linear in time) |
    gap (longer inner gap, NULL) | held (up to max_gap periods before the first or after the last reading, nearest
    value) | before_first / after_last (farther out, NULL).

    Readings outside [t0, stop), with a NULL or non-finite value or a NULL time, or with grid <= 0 or NULL terms are
    left out; a key without any other reading gives no row. NULL keys form series of their own. Ties and repeated
    rows fall into one period and are averaged. An empty input gives an empty result. Extra columns are ignored.
    """
    k = F.floor((F.col(t_us) - F.col(t0_us)) / F.col(grid_us)).cast("bigint")
    inside = (F.col(grid_us) > 0) & (F.col(t_us) >= F.col(t0_us)) & (F.col(t_us) < F.col(stop_us)) & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf"))
    named = [F.col(c).alias(f"key{i}") for i, c in enumerate(keys)]
    held = [f"key{i}" for i in range(len(keys))]
    periods = (
        rows.where(inside)
        .select(*named, k.alias("k"), F.col(value).cast("double").alias("v"), F.col(t0_us).alias("t0"), F.col(grid_us).alias("grid"), F.ceil((F.col(stop_us) - F.col(t0_us)) / F.col(grid_us)).cast("bigint").alias("n"))
        .groupBy(*held, "k", "t0", "grid", "n")
        .agg(F.avg("v").alias("v"), F.count("*").alias("cnt"))
        .withColumn("block", F.floor(F.col("k") / block).cast("bigint"))
    )
    # What a block must know of its neighbours: one small row per occupied block. It takes the same columns of `periods` as
    # the rows themselves do, so that both share one exchange and the readings are scanned once.
    across = Window.partitionBy(*held).orderBy("block")
    heads = periods.groupBy(*held, "block", "t0", "grid", "n").agg(F.min("k").alias("head_k"), F.min_by(F.struct("v", "cnt"), "k").alias("head"))
    heads = heads.select(*held, "block", "t0", "grid", "n", F.lead("head_k").over(across).alias("next_k"), F.lead("head").over(across).alias("next"), F.lag("block").over(across).isNull().alias("first"))
    # what: 1 a period with readings, 0 an end of the grid, -1 the next block's head, which only closes the last gap.
    row = lambda k, v, what: F.struct(k.alias("k"), v.cast("double").alias("v"), what.alias("what"))
    begin = row(F.lit(-1).cast("bigint"), F.lit(None), F.lit(0))
    close = row(F.coalesce("next_k", "n"), F.col("next.v"), F.when(F.col("next_k").isNull(), 0).otherwise(-1))
    borders = heads.select(*held, "block", "t0", "grid", F.explode(F.when(F.col("first"), F.array(begin, close)).otherwise(F.array(close))).alias("b"))
    typed = [*held, "block", "t0", "grid", "k", "v", "cnt", "what"]
    marked = periods.withColumn("what", F.lit(1)).select(*typed).unionByName(borders.select(*held, "block", "t0", "grid", "b.k", "b.v", F.lit(0).cast("bigint").alias("cnt"), "b.what"))
    within = Window.partitionBy(*held, "block").orderBy("k")
    paired = marked.select(*held, "t0", "grid", "k", "v", "cnt", "what", F.lead("k").over(within).alias("k2"), F.lead("v").over(within).alias("v2"), F.lead("what").over(within).alias("what2")).where(F.col("k2").isNotNull())
    real = F.when(F.col("what") > 0, F.array(F.struct(F.col("k").alias("k"), F.col("v").alias("v"), F.col("cnt").alias("c"), F.lit(0).cast("bigint").alias("g"), F.lit(MEASURED).alias("m")))).otherwise(F.array())
    gap = F.col("k2") - F.col("k") - 1

    def filled(j: Column) -> Column:
        """The struct of empty period j between k and k2."""
        value_at = (
            F.when(F.col("what") == 0, F.when((F.col("k2") - j) <= max_gap, F.col("v2")))
            .when(F.col("what2") == 0, F.when((j - F.col("k")) <= max_gap, F.col("v")))
            .when(gap <= max_gap, F.col("v") + (F.col("v2") - F.col("v")) * (j - F.col("k")) / (F.col("k2") - F.col("k")))
        )
        mark = (
            F.when(F.col("what") == 0, F.when((F.col("k2") - j) <= max_gap, F.lit(HELD)).otherwise(F.lit(BEFORE)))
            .when(F.col("what2") == 0, F.when((j - F.col("k")) <= max_gap, F.lit(HELD)).otherwise(F.lit(AFTER)))
            .when(gap <= max_gap, F.lit(INTERPOLATED))
            .otherwise(F.lit(GAP))
        )
        return F.struct(j.alias("k"), value_at.alias("v"), F.lit(0).cast("bigint").alias("c"), gap.alias("g"), mark.alias("m"))

    # A gap is cut into stretches of a block first, so that no row ever holds more than one of them.
    starts = F.when(gap > 0, F.sequence(F.col("k") + 1, F.col("k2") - 1, F.lit(block).cast("bigint"))).otherwise(F.array(F.col("k") + 1))
    pieces = paired.select(*paired.columns, F.explode(starts).alias("from"))
    until = F.least(F.col("from") + block - 1, F.col("k2") - 1)
    between = F.when(gap > 0, F.transform(F.sequence(F.col("from"), until), filled)).otherwise(F.array())
    measured = F.when(F.col("from") == F.col("k") + 1, real).otherwise(F.array())
    out = pieces.select(*held, "t0", "grid", F.explode(F.concat(measured, between)).alias("p"))
    return out.select(*[F.col(f"key{i}").alias(c) for i, c in enumerate(keys)], (F.col("t0") + F.col("p.k") * F.col("grid")).alias("period_start_us"), F.col("p.v").alias("value"), F.col("p.c").alias("n_readings"), F.col("p.g").alias("gap_periods"), F.col("p.m").alias("mark"))
