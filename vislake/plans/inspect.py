"""Queries behind an interactive view (U1-U8, A3, A6, A7, J15): windows, grids, traces, point look-ups, memo."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vislake.functions.complexmath import TWO_PI
from vislake.operators.average import average, phase_by_baseline
from vislake.operators.gains import Solution, calibrate

#: Display unit and factor of a kind's values.
UNITS = {"PhaseOffset": ("deg", 57.29577951308232), "Delay": ("ns", 1e9), "Rate": ("mHz", 1e3), "PhaseBandpass": ("deg", 57.29577951308232), "LogAmplitudeBandpass": ("", 1.0)}


@dataclass
class Memo:
    """Results by signature; a new signature of a slot replaces the old one, which is unpersisted."""

    held: dict[str, tuple[object, DataFrame]] = field(default_factory=dict)

    def get(self, slot: str, signature: object, make: Callable[[], DataFrame]) -> DataFrame:
        if slot in self.held and self.held[slot][0] == signature:
            return self.held[slot][1]
        if slot in self.held:
            self.held[slot][1].unpersist()
        df = make().cache()
        self.held[slot] = (signature, df)
        return df


def grid_data(vis: DataFrame, solution: Solution | None, t_low: float, t_high: float) -> DataFrame:
    """Coherent phase per (p, q, chan, i, j) of a window, calibrated if a solution is given (A3)."""
    w = vis.where(F.col("t").between(t_low, t_high))
    w = w if solution is None else calibrate(w, solution, solution.kinds())
    return phase_by_baseline(average(w.withColumn("tcell", F.lit(1)).withColumn("fcell", F.col("chan")))).withColumnRenamed("fcell", "chan")


def grid_model(vis: DataFrame, solution: Solution, t_low: float, t_high: float) -> DataFrame:
    """The model's phase on the same grid: minus that of calibrated unit visibilities (A3)."""
    unit = vis.withColumn("re", F.lit(1.0)).withColumn("im", F.lit(0.0))
    return grid_data(unit, solution, t_low, t_high).withColumn("phase", -F.col("phase"))


def traces(solution: Solution, occupied: DataFrame, kind: str, axis: str) -> DataFrame:
    """(p, i, other, points array<struct<x, y>>): values of occupied cells along tcell or fcell, in order."""
    other = "fcell" if axis == "tcell" else "tcell"
    o = occupied.select(F.col("antenna").alias("p"), F.col("slot").alias("i"), "tcell", "fcell")
    c = solution.of(kind).join(o, ["p", "i", "tcell", "fcell"], "left_semi")
    return c.groupBy("p", "i", F.col(other).alias("other")).agg(F.array_sort(F.collect_list(F.struct(F.col(axis).alias("x"), F.col("value").alias("y")))).alias("points"))


def varying_axis(solution: Solution, kind: str) -> str:
    """tcell if the kind has more time than frequency cells."""
    n = solution.of(kind).agg(F.countDistinct("tcell").alias("t"), F.countDistinct("fcell").alias("f")).first()
    return "tcell" if n["t"] >= n["f"] else "fcell"


def timelines(cells: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(names, cells array<struct<lo, hi>>): names with equal cell lists (to a tolerance) share one line (A7). cells: name, lo,
    hi; one row per line, so what a view draws is as long as its distinct lists."""
    step = lambda c: (F.rint(F.col(c) / tolerance) * tolerance).alias(c)
    lists = cells.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(step("lo"), step("hi")))).alias("cells"))
    return lists.groupBy("cells").agg(F.array_sort(F.collect_list("name")).alias("names")).select("names", "cells")


def node_value(solution: Solution, kind: str, p: int, i: int, tcell: int, fcell: int) -> float:
    """One stored value; 0 where there is none."""
    r = solution.of(kind).where((F.col("p") == p) & (F.col("i") == i) & (F.col("tcell") == tcell) & (F.col("fcell") == fcell)).select("value").first()
    return r[0] if r else 0.0


def pair_delay_rate(solution: Solution, p: int, q: int, i: int, j: int, tcell: int, fcell: int) -> tuple[float, float]:
    """Solved delay and rate of a pair at a window's middle."""
    d = lambda kind: node_value(solution, kind, p, i, tcell, fcell) - node_value(solution, kind, q, j, tcell, fcell)
    return d("Delay"), d("Rate")


def uv_snr(fringes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined, unmatched): SNR of peaks against the averaged uv of their tile."""
    key = ["source", "p", "q", "tcell"]
    j = fringes.select(*key, "fcell", "i", "j", "snr", "nu").join(rows.select(*key, "u", "v"), key)
    return j.select(*key, "fcell", "i", "j", "snr", (F.hypot("u", "v") * F.col("nu") / 299_792_458.0).alias("uv_wavelengths")), fringes.join(rows.select(*key), key, "left_anti")


def channel_order(channels: DataFrame) -> DataFrame:
    """(chan, nu, if_id, rank, breaks): channels by frequency, with a mark where the window changes."""
    from pyspark.sql import Window

    o = Window.orderBy("nu", "chan")
    return channels.select("chan", "nu", "if_id", F.row_number().over(o).alias("rank"), F.coalesce(F.col("if_id") != F.lag("if_id").over(o), F.lit(False)).alias("breaks"))


def displayed(solution: Solution, kind: str) -> DataFrame:
    """Values of a kind in display units (U8)."""
    unit, factor = UNITS[kind]
    return solution.of(kind).withColumn("value", F.col("value") * factor).withColumn("unit", F.lit(unit))


def mark_phase(solution: Solution, p: int, i: int, tcell: int, fcell: int, t: float, nu: float) -> float:
    """Phase of a node at a time and frequency (U8)."""
    t0 = solution.tcells.where(F.col("cell") == tcell).first()["ref"]
    n0 = solution.fcells.where(F.col("cell") == fcell).first()["ref"]
    v = lambda k: node_value(solution, k, p, i, tcell, fcell)
    return v("PhaseOffset") + v("PhaseBandpass") + TWO_PI * (v("Delay") * (nu - n0) + v("Rate") * (t - t0))


def enabled_apply(kinds: list[str], enabled: dict[str, bool]) -> list[str]:
    """Kinds that a view applies, in their own order (U7); a kind that is not mentioned is on."""
    return [k for k in kinds if enabled.get(k, True)]


def resolve_pair(pairs: DataFrame, p: int, q: int) -> tuple[int, int, bool] | None:
    """(p, q, turned) as the data have it: a baseline asked for against its order is found with turned = True; None if the two
    antennas have no data together (U7). pairs: p, q."""
    have = {(r["p"], r["q"]) for r in pairs.where(F.col("p").isin(p, q) & F.col("q").isin(p, q)).select("p", "q").distinct().collect()}  # four rows at most
    return (p, q, False) if (p, q) in have else (q, p, True) if (q, p) in have else None


def cadence(times: DataFrame) -> DataFrame:
    """(scan, step, n): the usual distance of a scan's times, the median of its positive steps (U7). times: scan, t."""
    from pyspark.sql import Window

    o = Window.partitionBy("scan").orderBy("t")
    d = times.select("scan", "t").distinct().withColumn("d", F.col("t") - F.lag("t").over(o))
    return d.groupBy("scan").agg(F.median(F.when(F.col("d") > 0, F.col("d"))).alias("step"), F.count("*").alias("n"))


def slots_present(vis: DataFrame) -> DataFrame:
    """(p, i) that any datum with weight has, at either end."""
    good = vis.where(F.coalesce(F.col("w") > 0, F.lit(False)))
    return good.select("p", "i").union(good.select("q", "j")).distinct()


def cancel(spark, group: str) -> None:
    """Stop the jobs of a view."""
    spark.sparkContext.cancelJobGroup(group)
