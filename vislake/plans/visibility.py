"""Queries on the visibility table: selections, partitions, gains and averages (P, G, A rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vislake.dataset import Dataset, Selection, counts, diagonal_slot, select, usable, window
from vislake.functions.complexmath import present
from vislake.operators.average import average, average_rows, occupancy, phase_by_baseline, presence, uv_amplitude
from vislake.operators.gains import Solution, calibrate, corrupt, install_static
from vislake.operators.partition import by_channel, by_duration, by_edges, by_scan, by_window, coarsen, containing, fixed_cells, regroup, scans_by_gap, whole
from vislake.plans.common import CELLS_CTE, cells, channels, r, vis, with_vis
from vislake.sources.adapters import DNU, IF_STEP, NU0


def _ds(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(vis(spark, sf_dir), channels(spark))


def solution(spark: SparkSession) -> Solution:
    """A fixed solution on 8 antennas, 2 slots, 7 year cells and 2 frequency windows."""
    seq = lambda n: F.explode(F.sequence(F.lit(1), F.lit(n)))
    node = spark.range(1, 9).select(F.col("id").cast("int").alias("p")).select("p", seq(2).alias("i")).select("p", "i", seq(7).alias("tcell")).select("p", "i", "tcell", seq(2).alias("fcell"))
    value = {"PhaseOffset": F.col("p") * 0.1 + F.col("i") * 0.05 + F.col("tcell") * 0.01, "Delay": (F.col("p") - 4) * 1e-9, "Rate": (F.col("p") - 4) * 1e-10, "LogAmplitudeBandpass": (F.col("p") - 4) * 0.02 + F.col("fcell") * 0.01}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in value.items()])).alias("c")
    kinds = node.select("p", "i", "tcell", "fcell", each).select("c.kind", "p", "i", "tcell", "fcell", "c.value")
    t = spark.createDataFrame([(c, (c - 0.5) * 365.25 * 86400) for c in range(1, 8)], "cell int, ref double")
    f = spark.createDataFrame([(1, NU0 + 1.5 * DNU), (2, NU0 + 5 * DNU + IF_STEP)], "cell int, ref double")
    return Solution(kinds, t, f)


ALL = ["PhaseOffset", "Delay", "Rate", "LogAmplitudeBandpass"]


def agg_a1_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = average(cells(spark, sf_dir))
    return a.select("source", "p", "q", "tcell", "fcell", "i", "j", r("re").alias("re"), r("im").alias("im"), r("w", 3).alias("w"), "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrate, average, combine to phases: scan, filter, two gain look-ups, two aggregations."""
    calibrated = calibrate(cells(spark, sf_dir).where(present(F.col("w"))), solution(spark), ALL)
    return phase_by_baseline(average(calibrated)).select("p", "q", "fcell", "i", "j", r("phase", 5).alias("phase"), r("amp", 5).alias("amp"), r("w", 2).alias("w"))


def sel_p8_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calibrate(cells(spark, sf_dir), solution(spark), ALL)
    return c.groupBy("p", "q", "i", "j").agg(r(F.sum(F.when(present(F.col("w")), F.col("re"))), 3).alias("re"), r(F.sum(F.when(present(F.col("w")), F.col("im"))), 3).alias("im"), r(F.sum("w"), 2).alias("w"), F.count("*").alias("n"))


def src_s15_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corrupt(cells(spark, sf_dir), solution(spark), ALL)
    return c.groupBy("p", "q", "i", "j").agg(r(F.sum("re"), 3).alias("re"), r(F.sum("im"), 3).alias("im"), r(F.sum("w"), 2).alias("w"))


def agg_a1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).groupBy("row_id", "source", "p", "q", "tcell", "scan").agg(F.sum("w").alias("w_row"), F.min("u").alias("u"), F.min("v").alias("v"), F.lit(1.0).alias("int_time"))
    return average_rows(rows).select("source", "p", "q", "tcell", r("u", 3).alias("u"), r("v", 3).alias("v"), "int_time", "scan", "n_rows")


def agg_a2_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = phase_by_baseline(average(cells(spark, sf_dir)))
    return a.select("p", "q", "fcell", "i", "j", r("phase", 5).alias("phase"), r("amp", 5).alias("amp"), r("w", 2).alias("w"))


def agg_a4_uv_amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    rows = average_rows(c.groupBy("row_id", "source", "p", "q", "tcell", "scan").agg(F.sum("w").alias("w_row"), F.min("u").alias("u"), F.min("v").alias("v"), F.lit(1.0).alias("int_time")))
    a = uv_amplitude(average(c), rows, solution(spark).fcells)
    return a.select("source", "p", "q", "tcell", "fcell", "i", "j", r("uv_wavelengths", 1).alias("uv_wavelengths"), r("amp", 8).alias("amp"))


def agg_a5_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupancy(cells(spark, sf_dir))


def join_j16_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence(vis(spark, sf_dir)).groupBy("t", "kind", "who").agg(F.count("*").alias("n"))


def sel_p2_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = select(_ds(spark, sf_dir), Selection(lambda v: (v["source"] == 3) & (v["p"] < 4), [1, 2, 5]))
    return s.vis.groupBy("scan", "chan").agg(F.count("*").alias("n"), r(F.sum("w"), 2).alias("w"))


def sel_p4_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable(_ds(spark, sf_dir)).groupBy("i", "j", "chan").agg(F.count("*").alias("n"))


def sel_p5_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window(_ds(spark, sf_dir), 3.0e7, 9.0e7, 2, 5).vis.groupBy("source", "chan").agg(F.count("*").alias("n"), r(F.sum("re"), 4).alias("re"))


def sel_p12_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagonal_slot(_ds(spark, sf_dir), 2).vis.groupBy("i", "j").agg(r(F.sum("w"), 2).alias("w"), F.count("*").alias("n"))


def src_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(_ds(spark, sf_dir))


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vis(spark, sf_dir).select("scan", "t").distinct()


def part_g1_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans_by_gap(vis(spark, sf_dir).where("source = 1 AND p = 1 AND q = 2").select("t").distinct(), 6 * 86400.0)


def part_g1_gaps_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans_by_gap(vis(spark, sf_dir).where("p = 1 AND q = 2").select("t", "source").distinct(), 6 * 86400.0, ["source"])


def part_g1_gaps_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of every baseline and source; over all of them at once the day's cadence has no gaps."""
    return scans_by_gap(vis(spark, sf_dir).select("t", "source", "p", "q").distinct(), 6 * 86400.0, series=["source", "p", "q"])


def part_g1_gaps_by_source_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of every baseline that never span two sources."""
    return scans_by_gap(vis(spark, sf_dir).select("t", "source", "p", "q").distinct(), 6 * 86400.0, ["source"], series=["p", "q"])


def part_g2_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(_times(spark, sf_dir)).cells


def part_g3_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_scan(_times(spark, sf_dir)).cells


def part_g4_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_duration(_times(spark, sf_dir), 7 * 86400.0).lookup


def part_g4_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = by_duration(_times(spark, sf_dir), 7 * 86400.0).cells
    return c.select("cell", r("lo", 3).alias("lo"), r("hi", 3).alias("hi"), r("ref", 3).alias("ref"))


def part_g5_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_edges(_times(spark, sf_dir).select("t"), [0.0, 5e7, 1e8, 1.5e8, 3e8]).lookup


def part_g6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_window(channels(spark)).cells


def part_g6_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_channel(channels(spark), DNU).cells


def part_g7_coarsen(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = _times(spark, sf_dir)
    fine = by_duration(times, 7 * 86400.0)
    into = containing(fine.lookup, times.join(by_scan(times).lookup, "scan"), ["scan", "t"])
    return coarsen(fine, into, 2).select("cell", "new_cell", r("lo", 3).alias("lo"), r("hi", 3).alias("hi"))


def part_g8_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regroup(by_window(channels(spark)), [[1, 2]]).cells


def part_g9_refines(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = _times(spark, sf_dir)
    fine = by_duration(times, 7 * 86400.0)
    return containing(fine.lookup, times.join(by_scan(times).lookup, "scan"), ["scan", "t"])


def part_g13_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t0 = vis(spark, sf_dir).agg(F.min("t")).first()[0] or 0.0
    return vis(spark, sf_dir).groupBy(fixed_cells(F.col("t"), F.lit(t0), 30 * 86400.0).alias("cell")).agg(F.countDistinct("source").alias("n_sources"), F.count("*").alias("n"))


def cal_c14_install(spark: SparkSession, sf_dir: str) -> DataFrame:
    align = spark.range(1, 9).selectExpr("'Delay' kind", "CAST(id AS INT) p", "1 i", "2 fcell", "id * 1e-11D value")
    return install_static(solution(spark), align).components.groupBy("kind", "p", "i").agg(r(F.sum("value") * 1e9, 6).alias("total_e9"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        agg_a1_average, flagship, sel_p8_calibrated, src_s15_corrupt, agg_a1_rows, agg_a2_phase, agg_a4_uv_amplitude, agg_a5_occupancy, join_j16_presence, sel_p2_select, sel_p4_present, sel_p5_window, sel_p12_slot, src_counts,
        part_g1_gaps, part_g1_gaps_by_source, part_g1_gaps_whole, part_g1_gaps_by_source_whole, part_g2_whole, part_g3_scans, part_g4_duration, part_g4_cells, part_g5_edges, part_g6_windows, part_g6_channels, part_g7_coarsen, part_g8_group, part_g9_refines, part_g13_fixed, cal_c14_install,
    )
}

_AVG = """avg_ AS (
  SELECT source, p, q, tcell, fcell, i, j, CASE WHEN sum(w) > 0 THEN sum(CASE WHEN w > 0 THEN w * re ELSE 0 END) / sum(w) ELSE 'nan'::DOUBLE END re,
         CASE WHEN sum(w) > 0 THEN sum(CASE WHEN w > 0 THEN w * im ELSE 0 END) / sum(w) ELSE 'nan'::DOUBLE END im, sum(w) w, count(*) n
  FROM {src} GROUP BY ALL)"""
_ROWS = """rows_ AS (SELECT row_id, source, p, q, tcell, scan, sum(w) w_row, min(u) u, min(v) v, 1e0 int_time FROM cells GROUP BY ALL),
arows AS (SELECT source, p, q, tcell, CASE WHEN sum(w_row) > 0 THEN sum(w_row * u) / sum(w_row) ELSE avg(u) END u, CASE WHEN sum(w_row) > 0 THEN sum(w_row * v) / sum(w_row) ELSE avg(v) END v,
  sum(int_time) int_time, CASE WHEN min(scan) = max(scan) THEN min(scan) ELSE 0 END scan, count(*) n_rows FROM rows_ GROUP BY ALL)"""
_REF = f"""refs AS (SELECT *, (tcell - 0.5e0) * 365.25e0 * 86400e0 t_ref, CASE WHEN fcell = 1 THEN {NU0 + 1.5 * DNU}::DOUBLE ELSE {NU0 + 5 * DNU + IF_STEP}::DOUBLE END nu_ref FROM cells),
g AS (SELECT *, 0.1e0 * p + 0.05e0 * i + 0.01e0 * tcell + 6.283185307179586e0 * (p - 4) * 1e-9 * (nu - nu_ref) + 6.283185307179586e0 * (p - 4) * 1e-10 * (t - t_ref)
  - (0.1e0 * q + 0.05e0 * j + 0.01e0 * tcell + 6.283185307179586e0 * (q - 4) * 1e-9 * (nu - nu_ref) + 6.283185307179586e0 * (q - 4) * 1e-10 * (t - t_ref)) ph,
  exp((p - 4) * 0.02e0 + fcell * 0.01e0 + (q - 4) * 0.02e0 + fcell * 0.01e0) am FROM refs),
cal AS (SELECT * REPLACE ((re * cos(-ph) - im * sin(-ph)) / am AS re, (re * sin(-ph) + im * cos(-ph)) / am AS im, w * am * am AS w) FROM g)"""
_PHASE = """SELECT p, q, fcell, i, j, round(atan2(sum(w * im), sum(w * re)), 5) + 0 AS phase, round(sqrt(sum(w * re) ** 2 + sum(w * im) ** 2) / sum(w), 5) + 0 AS amp, round(sum(w), 2) + 0 AS w FROM avg_ WHERE w > 0 GROUP BY ALL"""
_DUR = """times AS (SELECT DISTINCT scan, t FROM vis),
spans AS (SELECT scan, min(t) lo, max(t) hi, greatest(round_even((max(t) - min(t)) / 604800e0, 0), 1) n FROM times GROUP BY scan),
based AS (SELECT *, coalesce(sum(n) OVER (ORDER BY scan ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) base, (hi - lo) / n width FROM spans),
fine AS (SELECT scan, t, CAST(base + least(greatest(CASE WHEN width > 0 THEN floor((t - lo) / width) ELSE 0 END + 1, 1), n) AS INT) cell FROM times JOIN based USING (scan)),
fcellsx AS (SELECT CAST(base + k AS INT) cell, lo + (k - 1) * width lo, lo + k * width hi FROM based, unnest(range(1, CAST(n AS INT) + 1)) r(k)),
ranked AS (SELECT scan, CAST(row_number() OVER (ORDER BY scan) AS INT) coarse FROM based),
into_ AS (SELECT cell fine, min(coarse) coarse, count(DISTINCT coarse) n_coarse FROM fine JOIN ranked USING (scan) GROUP BY cell)"""

ORACLE = {
    "agg_a1_average": with_vis("SELECT source, p, q, tcell, fcell, i, j, round(re, 6) + 0 AS re, round(im, 6) + 0 AS im, round(w, 3) + 0 AS w, n FROM avg_", CELLS_CTE, _AVG.format(src="cells")),
    "flagship": with_vis(_PHASE, CELLS_CTE, _REF, _AVG.format(src="(SELECT * FROM cal WHERE w > 0)")),
    "sel_p8_calibrated": with_vis("SELECT p, q, i, j, round(sum(CASE WHEN w > 0 THEN re END), 3) + 0 AS re, round(sum(CASE WHEN w > 0 THEN im END), 3) + 0 AS im, round(sum(w), 2) + 0 AS w, count(*) AS n FROM cal GROUP BY ALL", CELLS_CTE, _REF),
    "src_s15_corrupt": with_vis("SELECT p, q, i, j, round(sum(am * (re * cos(ph) - im * sin(ph))), 3) + 0 AS re, round(sum(am * (re * sin(ph) + im * cos(ph))), 3) + 0 AS im, round(sum(w), 2) + 0 AS w FROM g GROUP BY ALL", CELLS_CTE, _REF),
    "agg_a1_rows": with_vis("SELECT source, p, q, tcell, round(u, 3) + 0 AS u, round(v, 3) + 0 AS v, int_time, scan, n_rows FROM arows", CELLS_CTE, _ROWS),
    "agg_a2_phase": with_vis(_PHASE, CELLS_CTE, _AVG.format(src="cells")),
    "agg_a4_uv_amplitude": with_vis(f"SELECT source, p, q, tcell, fcell, i, j, round(sqrt(u * u + v * v) * CASE WHEN fcell = 1 THEN {NU0 + 1.5 * DNU}::DOUBLE ELSE {NU0 + 5 * DNU + IF_STEP}::DOUBLE END / 299792458e0, 1) + 0 AS uv_wavelengths, round(sqrt(re * re + im * im), 8) + 0 AS amp FROM avg_ JOIN arows USING (source, p, q, tcell) WHERE avg_.w > 0", CELLS_CTE, _AVG.format(src="cells"), _ROWS),
    "agg_a5_occupancy": with_vis("SELECT p AS antenna, i AS slot, tcell, fcell FROM cells WHERE w > 0 UNION SELECT q, j, tcell, fcell FROM cells WHERE w > 0", CELLS_CTE),
    "join_j16_presence": with_vis("SELECT t, kind, who, count(*) AS n FROM (SELECT t, 'source' kind, CAST(source AS VARCHAR) who FROM vis UNION ALL SELECT t, 'antenna', CAST(p AS VARCHAR) FROM vis UNION ALL SELECT t, 'antenna', CAST(q AS VARCHAR) FROM vis) GROUP BY ALL"),
    "sel_p2_select": with_vis("SELECT scan, chan, count(*) AS n, round(sum(w), 2) + 0 AS w FROM vis WHERE source = 3 AND p < 4 AND chan IN (1, 2, 5) GROUP BY ALL"),
    "sel_p4_present": with_vis("SELECT i, j, chan, count(*) AS n FROM vis WHERE w > 0 AND NOT isnan(w) GROUP BY ALL"),
    "sel_p5_window": with_vis("SELECT source, chan, count(*) AS n, round(sum(re), 4) + 0 AS re FROM vis WHERE t BETWEEN 3e7 AND 9e7 AND p = 2 AND q = 5 GROUP BY ALL"),
    "sel_p12_slot": with_vis("SELECT i, j, round(sum(CASE WHEN i = 2 AND j = 2 THEN w ELSE 0 END), 2) + 0 AS w, count(*) AS n FROM vis GROUP BY ALL"),
    "src_counts": with_vis("SELECT count(*) AS n_products, count(DISTINCT row_id) AS n_rows, count(DISTINCT chan) AS n_channels, count(DISTINCT source) AS n_sources, count(*) FILTER (w > 0) AS n_present, (SELECT CAST(count(*) AS INT) FROM (SELECT p FROM vis UNION SELECT q FROM vis)) AS n_antennas FROM vis"),
    "part_g1_gaps": with_vis("SELECT t, CAST(sum(n) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS INT) AS scan FROM (SELECT t, CASE WHEN lag(t) OVER (ORDER BY t) IS NULL OR t - lag(t) OVER (ORDER BY t) > 518400 THEN 1 ELSE 0 END n FROM (SELECT DISTINCT t FROM vis WHERE source = 1 AND p = 1 AND q = 2))"),
    "part_g1_gaps_by_source": with_vis("SELECT t, source, CAST(sum(n) OVER (ORDER BY t, source ROWS UNBOUNDED PRECEDING) AS INT) AS scan FROM (SELECT t, source, CASE WHEN lag(t) OVER o IS NULL OR t - lag(t) OVER o > 518400 OR source <> lag(source) OVER o THEN 1 ELSE 0 END n FROM (SELECT DISTINCT t, source FROM vis WHERE p = 1 AND q = 2) WINDOW o AS (ORDER BY t, source))"),
    "part_g1_gaps_whole": with_vis("SELECT t, source, p, q, CAST(sum(n) OVER (PARTITION BY source, p, q ORDER BY t ROWS UNBOUNDED PRECEDING) AS INT) AS scan FROM (SELECT t, source, p, q, CASE WHEN lag(t) OVER o IS NULL OR t - lag(t) OVER o > 518400 THEN 1 ELSE 0 END n FROM (SELECT DISTINCT t, source, p, q FROM vis) WINDOW o AS (PARTITION BY source, p, q ORDER BY t))"),
    "part_g1_gaps_by_source_whole": with_vis("SELECT t, source, p, q, CAST(sum(n) OVER (PARTITION BY p, q ORDER BY t, source ROWS UNBOUNDED PRECEDING) AS INT) AS scan FROM (SELECT t, source, p, q, CASE WHEN lag(t) OVER o IS NULL OR t - lag(t) OVER o > 518400 OR source <> lag(source) OVER o THEN 1 ELSE 0 END n FROM (SELECT DISTINCT t, source, p, q FROM vis) WINDOW o AS (PARTITION BY p, q ORDER BY t, source))"),
    "part_g2_whole": with_vis("SELECT 1 AS cell, min(t) AS lo, max(t) AS hi, (min(t) + max(t)) / 2 AS ref FROM vis"),
    "part_g3_scans": with_vis("SELECT CAST(row_number() OVER (ORDER BY scan) AS INT) AS cell, min(t) AS lo, max(t) AS hi, (min(t) + max(t)) / 2 AS ref FROM vis GROUP BY scan"),
    "part_g4_duration": with_vis("SELECT scan, t, cell FROM fine", _DUR),
    "part_g4_cells": with_vis("SELECT cell, round(lo, 3) + 0 AS lo, round(hi, 3) + 0 AS hi, round((lo + hi) / 2, 3) + 0 AS ref FROM fcellsx", _DUR),
    "part_g5_edges": with_vis("SELECT DISTINCT t, CAST(CASE WHEN t < 5e7 THEN 1 WHEN t < 1e8 THEN 2 WHEN t < 1.5e8 THEN 3 ELSE 4 END AS INT) AS cell FROM vis"),
    "part_g6_windows": with_vis("SELECT if_id AS cell, min(nu) AS lo, max(nu) AS hi, (min(nu) + max(nu)) / 2 AS ref FROM channels GROUP BY if_id"),
    "part_g6_channels": with_vis(f"SELECT chan AS cell, nu - {DNU / 2} AS lo, nu + {DNU / 2} AS hi, nu AS ref FROM channels"),
    "part_g7_coarsen": with_vis("SELECT cell, new_cell, round(min(lo) OVER (PARTITION BY new_cell), 3) + 0 AS lo, round(max(hi) OVER (PARTITION BY new_cell), 3) + 0 AS hi FROM (SELECT fine cell, CAST(dense_rank() OVER (ORDER BY coarse, (rn - 1) // 2) AS INT) new_cell, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY coarse ORDER BY fine) rn FROM into_) JOIN fcellsx ON fine = cell)", _DUR),
    "part_g8_group": with_vis("SELECT 1 AS cell, min(nu) AS lo, max(nu) AS hi, (min(nu) + max(nu)) / 2 AS ref FROM channels"),
    "part_g9_refines": with_vis("SELECT fine, coarse, n_coarse FROM into_", _DUR),
    "part_g13_fixed": with_vis("SELECT CAST(floor((t - (SELECT min(t) FROM vis)) / 2592000e0) + 1 AS INT) AS cell, count(DISTINCT source) AS n_sources, count(*) AS n FROM vis GROUP BY ALL"),
    "cal_c14_install": """
WITH n AS (SELECT p, i, tc, fc FROM range(1, 9) a(p), range(1, 3) b(i), range(1, 8) c(tc), range(1, 3) d(fc)),
v AS (SELECT 'PhaseOffset' kind, p, i, tc, fc, 0.1e0 * p + 0.05e0 * i + 0.01e0 * tc val FROM n UNION ALL SELECT 'Delay', p, i, tc, fc, (p - 4) * 1e-9 + CASE WHEN i = 1 AND fc = 2 THEN p * 1e-11 ELSE 0 END FROM n
  UNION ALL SELECT 'Rate', p, i, tc, fc, (p - 4) * 1e-10 FROM n UNION ALL SELECT 'LogAmplitudeBandpass', p, i, tc, fc, (p - 4) * 0.02e0 + fc * 0.01e0 FROM n)
SELECT kind, CAST(p AS INT) AS p, CAST(i AS INT) AS i, round(sum(val) * 1e9, 6) + 0 AS total_e9, count(*) AS n FROM v GROUP BY ALL""",
}
