"""Weighted averages of visibilities over cells (A1-A6) and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vislake.functions.complexmath import Complex, present
from vislake.session import bounded

#: Speed of light in m/s, milliarcsecond in rad.
C_LIGHT = 299_792_458.0
MAS = 4.84813681109536e-09


def average(vis: DataFrame) -> DataFrame:
    """Weighted mean per (source, p, q, tcell, fcell, i, j): re, im, w, n (A1).

    Values of weight 0 do not count; a cell without weight has NaN and w 0. NaN weights are taken as 0. Two-phase hash
    aggregation on the cell key: the raw rows never leave their executor.
    """
    w = F.when(present(F.col("w")), F.col("w")).otherwise(0.0)
    on = lambda c: F.sum(F.when(present(F.col("w")), F.col("w") * F.col(c)).otherwise(0.0))
    sums = vis.groupBy("source", "p", "q", "tcell", "fcell", "i", "j").agg(on("re").alias("sre"), on("im").alias("sim"), F.sum(w).alias("w"), F.count("*").alias("n"))
    mean = lambda c: F.when(F.col("w") > 0, F.try_divide(F.col(c), F.col("w"))).otherwise(F.lit(float("nan")))
    return sums.select("source", "p", "q", "tcell", "fcell", "i", "j", mean("sre").alias("re"), mean("sim").alias("im"), "w", "n")


def average_rows(rows: DataFrame) -> DataFrame:
    """Row-level averages per (source, p, q, tcell) (A1): u, v weighted by the rows' total weight (plain mean if all is
    flagged), summed int_time, the common scan or 0. rows: one per row_id with w_row, u, v, int_time, scan, tcell."""
    w = F.when(present(F.col("w_row")), F.col("w_row")).otherwise(0.0)
    g = rows.groupBy("source", "p", "q", "tcell").agg(F.sum(w).alias("w"), F.sum(w * F.col("u")).alias("wu"), F.sum(w * F.col("v")).alias("wv"), F.avg("u").alias("mu"), F.avg("v").alias("mv"), F.sum("int_time").alias("int_time"), F.min("scan").alias("s0"), F.max("scan").alias("s1"), F.count("*").alias("n_rows"))
    pick = lambda a, b: F.when(F.col("w") > 0, F.try_divide(F.col(a), F.col("w"))).otherwise(F.col(b))
    return g.select("source", "p", "q", "tcell", pick("wu", "mu").alias("u"), pick("wv", "mv").alias("v"), "int_time", F.when(F.col("s0") == F.col("s1"), F.col("s0")).otherwise(0).alias("scan"), "n_rows")


def phase_by_baseline(averaged: DataFrame) -> DataFrame:
    """Coherent phase and amplitude per (p, q, fcell, i, j) over sources and times (A2)."""
    on = lambda c: F.sum(F.col("w") * F.col(c))
    g = averaged.where(present(F.col("w"))).groupBy("p", "q", "fcell", "i", "j").agg(on("re").alias("re"), on("im").alias("im"), F.sum("w").alias("w"))
    z = Complex(F.col("re"), F.col("im"))
    return g.select("p", "q", "fcell", "i", "j", z.angle().alias("phase"), (z.abs() / F.col("w")).alias("amp"), "w")


def uv_amplitude(averaged: DataFrame, rows: DataFrame, fcells: DataFrame) -> DataFrame:
    """(source, p, q, tcell, fcell, i, j, uv_wavelengths, amp) of averaged products with weight (A4)."""
    both = averaged.where(present(F.col("w"))).join(rows.select("source", "p", "q", "tcell", "u", "v"), ["source", "p", "q", "tcell"]).join(bounded(fcells.select(F.col("cell").alias("fcell"), F.col("ref").alias("nu"))), "fcell")
    return both.select("source", "p", "q", "tcell", "fcell", "i", "j", (F.hypot("u", "v") * F.col("nu") / C_LIGHT).alias("uv_wavelengths"), Complex(F.col("re"), F.col("im")).abs().alias("amp"))


def occupancy(vis: DataFrame) -> DataFrame:
    """(antenna, slot, tcell, fcell) that carry a present datum at either end (A5)."""
    good = vis.where(present(F.col("w")))
    ends = F.explode(F.array(F.struct(F.col("p").alias("antenna"), F.col("i").alias("slot")), F.struct(F.col("q").alias("antenna"), F.col("j").alias("slot")))).alias("e")
    return good.select("tcell", "fcell", ends).select("e.antenna", "e.slot", "tcell", "fcell").distinct()


def presence(rows: DataFrame) -> DataFrame:
    """(t, kind, who): the source and both antennas of every row."""
    who = F.explode(F.array(F.struct(F.lit("source").alias("kind"), F.col("source").cast("string").alias("who")), F.struct(F.lit("antenna").alias("kind"), F.col("p").cast("string").alias("who")), F.struct(F.lit("antenna").alias("kind"), F.col("q").cast("string").alias("who")))).alias("x")
    return rows.select("t", who).select("t", "x.kind", "x.who")
