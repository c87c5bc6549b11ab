"""Row by row: what other queries compare in sums, and operators on inputs of their own kind made by formulas (A22, A28, A29,
C13, C14, G8, J11, J12, P2, P4, P5, P8, P12, S15)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vislake.dataset import diagonal_slot, usable, window
from vislake.operators.astrometry import error_model
from vislake.operators.estimate import MAS, DelayFit, fit_sessions
from vislake.operators.gains import calibrate, corrupt, install_static
from vislake.operators.instrument import alignment_summary, derive_alignment
from vislake.operators.partition import by_channel, regroup
from vislake.operators.residuals import compare_positions, jet_geometry, match_rows, structure_moment, window_structure
from vislake.plans.common import CELLS_CTE, cells, channels, r, with_vis
from vislake.plans.truths import _delays, _numbers
from vislake.plans.visibility import _REF, ALL, _ds, solution
from vislake.session import ensure_utc, finite, table
from vislake.sources.adapters import DNU, NU0


def sel_p8_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every calibrated product."""
    c = calibrate(cells(spark, sf_dir), solution(spark), ALL)
    return c.select("row_id", "p", "q", "chan", "i", "j", r("re").alias("re"), r("im").alias("im"), r("w", 2).alias("w"))


def src_s15_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every corrupted product; weights stay."""
    c = corrupt(cells(spark, sf_dir), solution(spark), ALL)
    return c.select("row_id", "p", "q", "chan", "i", "j", r("re").alias("re"), r("im").alias("im"), r("w", 2).alias("w"))


def src_s15_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrupted and calibrated again: the table itself."""
    c = calibrate(corrupt(cells(spark, sf_dir), solution(spark), ALL), solution(spark), ALL)
    return c.select("row_id", "p", "q", "chan", "i", "j", r("re", 7).alias("re"), r("im", 7).alias("im"))


def sel_p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable(_ds(spark, sf_dir)).select("row_id", "p", "q", "chan", "i", "j", "w")


def sel_p5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window(_ds(spark, sf_dir), 3e7, 1.2e8, 2, 5).vis.select("row_id", "chan", "i", "j", "t", "w")


def sel_p12_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagonal_slot(_ds(spark, sf_dir), 2).vis.select("row_id", "p", "q", "chan", "i", "j", "w")


def part_g8_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven channels in three groups, and where each channel goes."""
    ensure_utc(spark)
    p = regroup(by_channel(channels(spark), DNU), [[1, 2, 7], [3, 5], [4, 6]])
    return p.lookup.join(p.cells, "cell").select("chan", "cell", "lo", "hi", "ref")


def cal_c14_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static delays in every time cell, on top of what is there."""
    ensure_utc(spark)
    align = spark.range(1, 9).selectExpr("'Delay' kind", "CAST(id AS INT) p", "CAST(1 AS INT) i", "CAST(2 AS INT) fcell", "id * 1e-11D value")
    return install_static(solution(spark), align).components.where("kind = 'Delay'").select("p", "i", "tcell", "fcell", r(F.col("value") * 1e9, 6).alias("value_ns"))


def join_j11_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two observable tables that are the same measurement (the first of each key on either side)."""
    o = table(spark, sf_dir, "observables").where(finite(F.col("tau_residual")))
    one = o.groupBy("session", "scan", "a1", "a2", F.col("receptor_slot").alias("slot")).agg(F.min_by("tau_residual", "obs_id").alias("r"))
    m = match_rows(one.where("scan % 3 <> 0"), one.where("scan % 2 = 0").withColumn("r", F.col("r") * 2))
    return m.select("session", "scan", "a1", "a2", "slot", r(F.col("r_a") * 1e12, 3).alias("r_a"), r(F.col("r_b") * 1e12, 3).alias("r_b"))


def join_j12_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted positions of sessions with even numbers against those moved by a known offset, per source of the pooled table."""
    f = fit_sessions(DelayFit("A1", reweight=False, reject=False), _delays(spark, sf_dir)).select(F.concat_ws("/", "session", "source").alias("source"), (F.col("ra") / MAS).alias("ra"), (F.col("dec") / MAS).alias("dec"))
    c = compare_positions(f, f.withColumn("ra", F.col("ra") + 0.25).withColumn("dec", F.col("dec") - 0.5))
    return c.select("n", *[r(x, 6).alias(x) for x in c.columns if x != "n"])


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays and phases of 4 windows of 5 antennas in every session: a delay of the session, static parts of the windows
    (zero mean) and the phases that go with them."""
    n = _numbers(spark, sf_dir).select(F.col("k").alias("tcell"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("p")).select("tcell", "p", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("fcell"))
    nu = NU0 + (F.col("fcell") - 1) * 1e8
    common = ((F.col("tcell") + F.col("p")) % 7 - 3) * 1e-9
    own = F.element_at(F.array(*[F.lit(x) for x in (2.0, -1.0, -3.0, 2.0)]), F.col("fcell")) * F.col("p")
    phase = 2 * math.pi * (nu - (NU0 + 1.5e8)) * common + own * 0.01 + F.col("tcell") * 0.1
    return n.select("p", F.lit(1).alias("i"), "tcell", "fcell", nu.alias("nu"), (common + own * 1e-11).alias("delay"), phase.alias("phase"), F.lit(True).alias("anchored"))


def cal_c13_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static delays and phases of windows, with the sessions' own delays on top."""
    a = derive_alignment(_nodes(spark, sf_dir))
    return a.select("p", "fcell", r(F.col("delay") * 1e12, 3).alias("delay_ps"), r("phase", 3).alias("phase"), "nruns")


def agg_a25_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = alignment_summary(derive_alignment(_nodes(spark, sf_dir)))
    return s.select("p", r("rms", 5).alias("rms"), r("peak_to_peak", 5).alias("peak_to_peak"), r("d2_rms", 5).alias("d2_rms"))


def agg_a22_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with a static pattern and none that varies."""
    n = _nodes(spark, sf_dir)
    w = window_structure(n.select(F.concat_ws("/", F.col("p").cast("string"), F.col("tcell").cast("string")).alias("row_key"), F.col("p").alias("group"), "fcell", (F.col("delay") * 1e12).alias("delay"), F.lit(99.0).alias("snr")), 10.0)
    return w.select("n_groups", r("static_rms", 4).alias("static_rms"), r("var_rms", 4).alias("var_rms"), r("var_mad", 4).alias("var_mad"))


def _jets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A core and two components of every session's source."""
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("flux"), F.lit(x).alias("x"), F.lit(y).alias("y")) for f, x, y in ((2.0, 1.0, -1.0), (0.5, 2.0, 1.0), (0.25, 1.0, 2.0))])).alias("c")
    k = F.col("source") % 5 + 1
    return _numbers(spark, sf_dir).select(F.col("k").alias("source"), parts).select("source", "c.flux", (F.col("c.x") * k).alias("x"), (F.col("c.y") * k).alias("y"))


def agg_a28_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jet_geometry(_jets(spark, sf_dir)).select("source", r("pa_deg", 6).alias("pa_deg"), r("radius").alias("radius"))


def agg_a29_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_moment(_jets(spark, sf_dir), 100.0).select("source", r("pa_deg", 6).alias("pa_deg"), r("radius").alias("radius"), "flux", "n")


SCALES, FLOORS = (1.0, 2.0, 4.0, 16.0, 64.0, 256.0), tuple(float(10**k) for k in range(8))


def est_n14_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeliest scale and floor over every finite residual, outliers included."""
    o = table(spark, sf_dir, "observables").where(finite(F.col("tau_residual")) & finite(F.col("sigma_tau")) & finite(F.col("sigma_tau_ionosphere")))
    e = error_model(o.select((F.col("tau_residual") * 1e12).alias("d"), (F.col("sigma_tau") * 1e12).alias("formal"), (F.col("sigma_tau_ionosphere") * 1e12).alias("external")), list(SCALES), list(FLOORS))
    return e.select("s", "f", r("nll", 2).alias("nll"), r("chi2", 5).alias("chi2"))


QUERIES = {f.__name__: f for f in (est_n14_whole, sel_p8_rows, src_s15_rows, src_s15_inverse, sel_p4_rows, sel_p5_rows, sel_p12_rows, part_g8_groups, cal_c14_rows, join_j11_rows, join_j12_fits, cal_c13_truth, agg_a25_truth, agg_a22_truth, agg_a28_truth, agg_a29_truth)}

_OWN = "f AS (SELECT p, f, o * p o FROM (SELECT CAST(x AS INT) p FROM range(1, 6) r(x)), (VALUES (1, 2e0), (2, -1e0), (3, -3e0), (4, 2e0)) v(f, o))"
_OBS = "o AS (SELECT session, scan, a1, a2, receptor_slot slot, arg_min(tau_residual, obs_id) r FROM observables WHERE isfinite(tau_residual) GROUP BY ALL)"
# Offsets of the two outer components from the core, weighted 2:1, in units of the source's size.
_JET = "k AS (SELECT CAST(substr(session, 3) AS INT) s FROM sessions), j AS (SELECT s source, (s % 5 + 1) * (0.5e0 * 1 + 0.25e0 * 0) / 0.75e0 dx, (s % 5 + 1) * (0.5e0 * 2 + 0.25e0 * 3) / 0.75e0 dy FROM k)"

ORACLE = {
    "est_n14_whole": f"""
WITH o AS (SELECT tau_residual * 1e12 d, sigma_tau * 1e12 f, sigma_tau_ionosphere * 1e12 e FROM observables WHERE isfinite(tau_residual) AND isfinite(sigma_tau) AND isfinite(sigma_tau_ionosphere)),
g AS (SELECT s, fl, d, (s * f) ** 2 + fl ** 2 + e ** 2 v FROM o, (SELECT unnest([{", ".join(map(str, SCALES))}])::DOUBLE s), (SELECT unnest([{", ".join(map(str, FLOORS))}])::DOUBLE fl)),
n AS (SELECT s, fl, sum(d * d / v + ln(v)) nll, sum(d * d / v) q, count(*) n FROM g GROUP BY ALL)
SELECT s, fl AS f, round(nll, 2) + 0 AS nll, round(q / greatest(n - 3, 1), 5) + 0 AS chi2 FROM n ORDER BY n.nll, s, fl LIMIT 1""",
    "sel_p8_rows": with_vis("SELECT row_id, p, q, chan, i, j, round(re, 6) + 0 AS re, round(im, 6) + 0 AS im, round(w, 2) + 0 AS w FROM cal", CELLS_CTE, _REF),
    "src_s15_rows": with_vis("SELECT row_id, p, q, chan, i, j, round(am * (re * cos(ph) - im * sin(ph)), 6) + 0 AS re, round(am * (re * sin(ph) + im * cos(ph)), 6) + 0 AS im, round(w, 2) + 0 AS w FROM g", CELLS_CTE, _REF),
    "src_s15_inverse": with_vis("SELECT row_id, p, q, chan, i, j, round(re, 7) + 0 AS re, round(im, 7) + 0 AS im FROM vis"),
    "sel_p4_rows": with_vis("SELECT row_id, p, q, chan, i, j, w FROM vis WHERE w > 0"),
    "sel_p5_rows": with_vis("SELECT row_id, chan, i, j, t, w FROM vis WHERE t BETWEEN 3e7 AND 1.2e8 AND p = 2 AND q = 5"),
    "sel_p12_rows": with_vis("SELECT row_id, p, q, chan, i, j, CASE WHEN i = 2 AND j = 2 THEN w ELSE 0 END AS w FROM vis"),
    "part_g8_groups": with_vis(f"SELECT chan, cell, min(nu) OVER c - {DNU / 2} AS lo, max(nu) OVER c + {DNU / 2} AS hi, (min(nu) OVER c + max(nu) OVER c) / 2 AS ref FROM (SELECT *, CASE WHEN chan IN (1, 2, 7) THEN 1 WHEN chan IN (3, 5) THEN 2 ELSE 3 END cell FROM channels) WINDOW c AS (PARTITION BY cell)"),
    "cal_c14_rows": "SELECT CAST(p AS INT) AS p, CAST(i AS INT) AS i, CAST(t AS INT) AS tcell, CAST(f AS INT) AS fcell, round(p - 4 + CASE WHEN i = 1 AND f = 2 THEN p * 0.01e0 ELSE 0 END, 6) + 0e0 AS value_ns FROM range(1, 9) a(p), range(1, 3) b(i), range(1, 8) c(t), range(1, 3) d(f)",
    "join_j11_rows": f"WITH {_OBS} SELECT session, scan, a1, a2, slot, round(r * 1e12, 3) + 0 AS r_a, round(2 * r * 1e12, 3) + 0 AS r_b FROM o WHERE scan % 3 <> 0 AND scan % 2 = 0",
    "join_j12_fits": "SELECT count(*) * 6 AS n, -0.25e0 AS mean_ra, 0.5e0 AS mean_dec, 0.25e0 AS rms_ra, 0.5e0 AS rms_dec, round(sqrt(0.3125e0), 6) AS worst FROM sessions",
    "cal_c13_truth": f"WITH {_OWN} SELECT p, f AS fcell, o * 10 AS delay_ps, round(o * 0.01e0, 3) + 0 AS phase, (SELECT count(*) FROM sessions) AS nruns FROM f",
    "agg_a25_truth": f"WITH {_OWN}, w AS (SELECT *, lag(o) OVER b - 2 * o + lead(o) OVER b d FROM f WINDOW b AS (PARTITION BY p ORDER BY f)) SELECT p, round(sqrt(avg(o * o)) * 0.01e0, 5) AS rms, round((max(o) - min(o)) * 0.01e0, 5) AS peak_to_peak, round(sqrt(avg(d * d)) * 0.01e0, 5) AS d2_rms FROM w GROUP BY p",
    "agg_a22_truth": f"WITH {_OWN} SELECT CASE WHEN (SELECT count(*) FROM sessions) >= 3 THEN count(*) ELSE 0 END AS n_groups, CASE WHEN (SELECT count(*) FROM sessions) >= 3 THEN round(sqrt(avg(o * o)) * 10, 4) END AS static_rms, CASE WHEN (SELECT count(*) FROM sessions) >= 3 THEN 0e0 END AS var_rms, CASE WHEN (SELECT count(*) FROM sessions) >= 3 THEN 0e0 END AS var_mad FROM f",
    "agg_a28_truth": f"WITH {_JET} SELECT source, round(degrees(atan2(dx, dy)), 6) AS pa_deg, round(sqrt(dx * dx + dy * dy), 6) AS radius FROM j",
    "agg_a29_truth": f"WITH {_JET} SELECT source, round(degrees(atan2(dx, dy)), 6) AS pa_deg, round(sqrt(dx * dx + dy * dy), 6) AS radius, 0.75e0 AS flux, 2 AS n FROM j",
}
