"""Queries of kernels and solves (C, I, N rows), on the visibility table and the observables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vislake.functions.fringemath import Search
from vislake.functions.imagemath import Grid
from vislake.operators.astrometry import error_model, rotation_sums
from vislake.operators.bandpass import condense, condense_amplitudes, normalized, solve_amplitudes, solve_bandpass
from vislake.operators.closure import model_visibility
from vislake.operators.combine import combine
from vislake.operators.estimate import DelayFit, combine_positions, fit_sessions
from vislake.operators.fringe import edges, fringe_fit, grid_sums, peak_observables, solve_nodes, statistics
from vislake.operators.imaging import dirty_maps, dirty_pixels, gridded, image_sources
from vislake.operators.references import text_key
from vislake.plans.closures import _MODEL, _ST, _models, _stokes
from vislake.plans.common import CELLS_CTE, cells, r, vis, with_vis
from vislake.session import finite, table
from vislake.sources.adapters import DNU

#: Search windows for a cadence of a day and channels of DNU.
SEARCH = Search((-5e-6, 5e-6), (-1.2e-7, 1.2e-7), (2.0, 4.0), 2)
#: Map of the reference's size.
MAP = Grid(256, 0.5)
#: Guard against a CLEAN that runs away; it stops on the noise threshold.
CLEAN_GUARD = 100_000


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visibilities on a regular cadence: the day modulo 16."""
    return cells(spark, sf_dir).withColumn("t", F.pmod(F.col("t") / 86400, F.lit(16.0)) * 86400)


def cal_c2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statistics(grid_sums(_tiles(spark, sf_dir), strict=False))
    return s.select("tcell", "fcell", "source", "p", "q", "i", "j", r("weight", 4).alias("weight"), r("bandwidth", 2).alias("bandwidth"))


def cal_c9_fringes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fringe_fit(_tiles(spark, sf_dir), DNU, SEARCH, strict=False, cadence=86400.0)


def sel_p13_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peak_observables(cal_c9_fringes(spark, sf_dir)).select("tcell", "fcell", "source", "p", "q", "i", "delay", "rate", "snr", "sigma_delay", "weight")


def cal_c11_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solve_nodes(edges(cal_c9_fringes(spark, sf_dir), 3.0), "snr", 50, 1)


def cal_c17_condense(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = condense(_bandpass_cells(spark, sf_dir))
    return c.select("source", "p", "q", "i", "j", "hcell", "acell", "tcell", "k", r("sre", 7).alias("sre"), r("sim", 7).alias("sim"), r("sw", 2).alias("sw"))


def _bandpass_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("source", "p", "q", "i", "j", "scan", "chan", "re", "im", "w", "tcell", "fcell").withColumn("hcell", F.col("scan")).withColumn("acell", F.col("fcell")).withColumn("k", F.col("chan"))


def cal_c17_bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solve_bandpass(condense(_bandpass_cells(spark, sf_dir)), 30, 1e-3, (1, 1))


def _amp_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stokes(spark, sf_dir).join(_models(spark), "source")
    m = model_visibility(F.col("components"), F.col("u"), F.col("v"))
    return s.select(F.lit(1).alias("i"), F.lit(1).alias("j"), F.col("t").cast("int").alias("tcell"), F.col("chan").alias("fcell"), "p", "q", "re", "im", "w", m.re.alias("model_re"), m.im.alias("model_im"), F.lit(1.3).alias("model_flux"))


def cal_c18_condense(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = condense_amplitudes(_amp_cells(spark, sf_dir), 1.0, 3.0, 0.1)
    return c.select("i", "tcell", "fcell", "p", "q", r("sw", 3).alias("sw"), r("sr", 3).alias("sr"), r("sq", 3).alias("sq"), "n")


def cal_c18_amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(solve_amplitudes(condense_amplitudes(_amp_cells(spark, sf_dir), 1.0, 3.0, 0.1), 1e-6), "percell")


def img_i1_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_pixels(_stokes(spark, sf_dir), 6, 2.0).select("source", "x", "y", r("value").alias("value"))


def img_i1_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of the whole map."""
    return dirty_maps(_stokes(spark, sf_dir), MAP).select("source", "x", "y", r("value").alias("value"))


def img_i5_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = image_sources(gridded(_stokes(spark, sf_dir), 1e-4), MAP, 0.1, CLEAN_GUARD, 3.0, 1.0)
    return images.select("source", "npix", "pixel", "peak", "peak_x", "peak_y", "rms", "sigma", "niter", "nvis", F.size("flux").alias("n_components"))


def join_j1_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vis(spark, sf_dir).groupBy("p", "q", "source", "t", "nu", "i", "j", "if_id").agg(F.max("re").alias("re"), F.max("im").alias("im"), F.max("w").alias("w"), F.min("u").alias("u"), F.min("v").alias("v")).withColumn("int_time", F.lit(1.0))
    rows, _ = combine({"low": v.where("if_id = 1").drop("if_id"), "high": v.where("if_id = 2").drop("if_id")}, {"low": 1, "high": 2})
    return rows.select("p", "q", "source", "t", "u", "v", "n_bands")


def _observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observables with partials and mappings made up from their own numbers: positions, elevations, scans."""
    o = table(spark, sf_dir, "observables").where(finite(F.col("tau_residual")) & (F.abs("tau_residual") < 1e-8) & F.col("source").isNotNull())
    side = lambda k: [(1 / F.sin(f"el{k}")).alias(f"wet{k}"), (1 / (F.sin(f"el{k}") * F.tan(f"el{k}") + 0.0032)).alias(f"grad{k}"), (F.col("scan") * 0.1 + k).alias(f"az{k}")]
    return o.select("obs_id", "session", "source", "a1", "a2", F.col("receptor_slot").alias("slot"), "t", "tau_residual", "sigma_tau", F.col("sigma_tau_ionosphere").alias("sigma_iono"), (F.cos("t") * 0.02).alias("dtau_dra"), (F.sin(F.col("t") + F.col("source_ix")) * 0.02).alias("dtau_ddec"), *side(1), *side(2), "snr", "el1", "el2")


def est_n7_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fit a session, with its own clocks and wet delays; spellings of a source are one source."""
    o = _observables(spark, sf_dir).withColumn("source", text_key(F.col("source"))).where("source IS NOT NULL")
    return combine_positions(fit_sessions(DelayFit("FUMUMIS"), o))


def est_n13_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sources").select(F.radians("ra_deg").alias("ra"), F.radians("dec_deg").alias("dec"), (F.col("source_rawid") % 7 * 0.1).alias("dra"), (F.col("source_rawid") % 5 * 0.1).alias("ddec"))
    x = rotation_sums(s)
    return x.select(*[r(c).alias(c) for c in x.columns if c != "n"], "n")


def est_n14_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "observables").where(finite(F.col("tau_residual")) & finite(F.col("sigma_tau")) & (F.abs("tau_residual") < 1e-9) & (F.col("snr") > 20))
    e = error_model(o.select((F.col("tau_residual") * 1e12).alias("d"), (F.col("sigma_tau") * 1e12).alias("formal"), (F.col("sigma_tau_ionosphere") * 1e12).alias("external")), [1.0, 1.5, 2.0, 4.0, 8.0, 16.0], [float(k) for k in range(0, 200, 10)])
    return e.select("s", "f", r("nll", 3).alias("nll"), r("chi2", 6).alias("chi2"))


QUERIES = {f.__name__: f for f in (cal_c2_statistics, cal_c9_fringes, sel_p13_peaks, cal_c11_nodes, cal_c17_condense, cal_c17_bandpass, cal_c18_condense, cal_c18_amplitudes, img_i1_dirty, img_i1_map, img_i5_images, join_j1_combine, est_n7_positions, est_n13_rotation, est_n14_errors)}

_PI2 = repr(2 * math.pi) + "::DOUBLE"
_A = ["-sin(d) * cos(a)", "-sin(d) * sin(a)", "cos(d)"]
_B = ["sin(a)", "-cos(a)", "0e0"]
_ROT = ", ".join(f"round(sum(({_A[i]}) * ({_A[j]}) + ({_B[i]}) * ({_B[j]})), 6) + 0 AS n{i}{j}" for i in range(3) for j in range(i, 3)) + ", " + ", ".join(f"round(sum(({_A[i]}) * x + ({_B[i]}) * y), 6) + 0 AS y{i}" for i in range(3))
_AXIS = "(k - 3) * 2e0"

ORACLE = {
    "cal_c2_statistics": with_vis(
        "SELECT tcell, fcell, source, p, q, i, j, round(sum(w), 4) + 0 AS weight, round(sqrt(sum(w * (nu - nb) ** 2) / sum(w)), 2) + 0 AS bandwidth FROM b GROUP BY ALL",
        CELLS_CTE, "b AS (SELECT *, sum(w * nu) OVER k / sum(w) OVER k nb FROM cells WHERE w > 0 WINDOW k AS (PARTITION BY tcell, fcell, source, p, q, i, j))"),
    "cal_c17_condense": with_vis("SELECT source, p, q, i, j, scan AS hcell, fcell AS acell, tcell, chan AS k, round(sum(w * re), 7) + 0 AS sre, round(sum(w * im), 7) + 0 AS sim, round(sum(w), 2) + 0 AS sw FROM cells WHERE w > 0 GROUP BY ALL", CELLS_CTE),
    "cal_c18_condense": with_vis(
        "SELECT 1 AS i, CAST(t AS INT) AS tcell, chan AS fcell, least(p, q) AS p, greatest(p, q) AS q, round(sum(w * m * m), 3) + 0 AS sw, round(sum(w * m * m * (ln(a) - ln(m))), 3) + 0 AS sr, round(sum(w * m * m * (ln(a) - ln(m)) ** 2), 3) + 0 AS sq, count(*) AS n FROM (SELECT *, sqrt(mr * mr + mi * mi) m, sqrt(re * re + im * im) a FROM sm) WHERE m >= 0.13e0 AND m * sqrt(w) >= 3 AND a > 0 GROUP BY ALL",
        *_ST, _MODEL),
    "img_i1_dirty": with_vis(f"SELECT source, x, y, round(sum(w * (re * cos(-{_PI2} * (u * x + v * y)) - im * sin(-{_PI2} * (u * x + v * y)))) / sum(w), 6) + 0 AS value FROM st, (SELECT {_AXIS} x FROM range(6) r(k)), (SELECT {_AXIS} y FROM range(6) r(k)) GROUP BY ALL", *_ST),
    "join_j1_combine": with_vis("SELECT p, q, source, t, CAST(arg_min(um, (if_id, nu, i, j)) AS DOUBLE) AS u, CAST(arg_min(vm, (if_id, nu, i, j)) AS DOUBLE) AS v, count(DISTINCT if_id) AS n_bands FROM (SELECT p, q, source, t, nu, i, j, if_id, min(u) um, min(v) vm FROM vis GROUP BY ALL) GROUP BY ALL"),
    "est_n13_rotation": f"SELECT {_ROT}, count(*) AS n FROM (SELECT radians(ra_deg) a, radians(dec_deg) d, source_rawid % 7 * 0.1e0 x, source_rawid % 5 * 0.1e0 y FROM sources)",
    "est_n14_errors": """
WITH o AS (SELECT tau_residual * 1e12 d, sigma_tau * 1e12 f, sigma_tau_ionosphere * 1e12 e FROM observables WHERE isfinite(tau_residual) AND isfinite(sigma_tau) AND abs(tau_residual) < 1e-9 AND snr > 20),
g AS (SELECT s, fl, d, (s * f) ** 2 + fl ** 2 + e ** 2 v FROM o, (VALUES (1e0), (1.5e0), (2e0), (4e0), (8e0), (16e0)) a(s), (SELECT CAST(k * 10 AS DOUBLE) fl FROM range(20) r(k))),
n AS (SELECT s, fl, sum(d * d / v + ln(v)) nll, sum(d * d / v) q, count(*) n FROM g GROUP BY ALL)
SELECT s, fl AS f, round(nll, 3) + 0 AS nll, round(q / greatest(n - 3, 1), 6) + 0 AS chi2 FROM n ORDER BY nll, s, fl LIMIT 1""",
}
