"""Solves on data with injected truth: every session gets its own antenna delays, bandpasses, amplitudes, maps and positions,
made from its number by formulas that the SQL states as well (C3-C12, C17-C19, I1-I7, N1-N8, P13, P14, X2, X4).

Visibilities are those of a perfect point source, corrupted by a known solution; what the operators recover must be the
formula's values. The tables grow with the sessions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vislake.functions.fringemath import Search
from vislake.functions.imagemath import Grid
from vislake.operators.bandpass import condense, condense_amplitudes, normalized, solve_amplitudes, solve_bandpass
from vislake.operators.estimate import MAS, DelayFit, fit_sessions
from vislake.operators.fringe import edges, fringe_fit, fringe_planes, peak_observables, solve_nodes
from vislake.operators.gains import Solution, calibrate, corrupt
from vislake.operators.imaging import cleaned_flux, image_sources
from vislake.plans.common import r
from vislake.plans.schedule import Capture, fringe_step, run
from vislake.session import stored, table
from vislake.sources.adapters import DNU, NU0

#: Antennas, times in s, channels of one window.
ANTENNAS, TIMES, CHANNELS = 6, tuple(2.0 * k for k in range(8)), tuple(range(1, 9))
NU_REF, T_REF = NU0 + 3.5 * DNU, 7.0
SEARCH = Search((-0.24, 0.24), (-1.2e-7, 1.2e-7), (4.0, 4.0), 6)


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions' numbers."""
    return table(spark, sf_dir, "sessions").select("session", F.substring("session", 3, 12).cast("int").alias("k"))


def _each(*values: object) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit visibilities of every session (tcell), baseline, time and channel."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in range(1, ANTENNAS + 1) for q in range(p + 1, ANTENNAS + 1)])).alias("b")
    rows = _numbers(spark, sf_dir).select(F.col("k").alias("tcell"), pairs).select("tcell", "b.p", "b.q", _each(*TIMES).alias("t")).select("*", _each(*CHANNELS).alias("chan"))
    one = lambda x, n: F.lit(x).alias(n)
    return rows.select("tcell", one(1, "fcell"), one(1, "source"), "p", "q", one(1, "i"), one(1, "j"), "t", "chan", (NU0 + (F.col("chan") - 1) * DNU).alias("nu"), one(1.0, "re"), one(0.0, "im"), one(1.0, "w"))


def _delay(k: Column, p: Column) -> Column:
    return ((k + 2 * p) % 7 - 3) * 1.5e-8


def _rate(k: Column, p: Column) -> Column:
    return ((2 * k + p) % 5 - 2) * 0.03


def _solution(spark: SparkSession, sf_dir: str, values: dict[str, Column], cells: tuple[int, ...] = (1,)) -> Solution:
    """Components of every session and antenna; values may use k, p and c (the frequency cell)."""
    k = _numbers(spark, sf_dir).select("k", _each(*range(1, ANTENNAS + 1)).alias("p")).select("k", "p", _each(*cells).alias("c"))
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), v.cast("double").alias("value")) for n, v in values.items()])).alias("x")
    components = k.select("k", "p", "c", kinds).select("x.kind", "p", F.lit(1).alias("i"), F.col("k").alias("tcell"), F.col("c").alias("fcell"), "x.value")
    return Solution(components, _numbers(spark, sf_dir).select(F.col("k").alias("cell"), F.lit(T_REF).alias("ref")), spark.createDataFrame([(c, NU_REF) for c in cells], "cell int, ref double"))


def _truth(spark: SparkSession, sf_dir: str) -> Solution:
    k, p = F.col("k"), F.col("p")
    return _solution(spark, sf_dir, {"PhaseOffset": ((3 * k + 5 * p) % 11 - 5) * 0.2, "Delay": _delay(k, p), "Rate": _rate(k, p)})


def _corrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrupt(_points(spark, sf_dir), _truth(spark, sf_dir), ["PhaseOffset", "Delay", "Rate"])


def cal_c9_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays and rates of every baseline, in ns and mHz."""
    f = fringe_fit(_corrupted(spark, sf_dir), DNU, SEARCH)
    return peak_observables(f).select("tcell", "p", "q", r(F.col("delay") * 1e9, 2).alias("delay_ns"), r(F.col("rate") * 1e3, 2).alias("rate_mhz"))


def cal_c8_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak of every baseline's whole search plane, to the nearest bin of the lattice that the truth lies on."""
    plane = fringe_planes(_corrupted(spark, sf_dir), DNU, SEARCH)
    top = plane.groupBy("tcell", "p", "q").agg(F.max_by(F.struct("delay", "rate"), "magnitude").alias("m"), F.count("*").alias("n"))
    bin_ns, bin_mhz = 1e9 / (4 * len(CHANNELS) * DNU), 1e3 / (4 * len(TIMES) * 2.0)
    k, p, q = F.col("tcell"), F.col("p"), F.col("q")
    near = (F.abs(F.col("m.delay") - (_delay(k, p) - _delay(k, q))) * 1e9 <= bin_ns) & (F.abs(F.col("m.rate") - (_rate(k, p) - _rate(k, q))) * 1e3 <= bin_mhz)
    return top.select("tcell", "p", "q", near.alias("within_a_bin"))


def cal_c11_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays and rates of every antenna against antenna 1."""
    nodes = solve_nodes(edges(fringe_fit(_corrupted(spark, sf_dir), DNU, SEARCH), 3.0, F.col("p") < F.col("q")), "snr", 50, 1)
    return nodes.select("tcell", "p", r(F.col("delay") * 1e9, 2).alias("delay_ns"), r(F.col("rate") * 1e3, 2).alias("rate_mhz"), "anchored")


def cal_c12_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After one step of self-calibration nothing of the corruption is left: largest phase and deviation of the amplitude."""
    vis = _corrupted(spark, sf_dir)
    zero = Solution(spark.createDataFrame([], "kind string, p int, i int, tcell int, fcell int, value double"), _truth(spark, sf_dir).tcells, _truth(spark, sf_dir).fcells)
    done = run(vis, zero, [Capture("fringes", fringe_step(DNU, SEARCH, ["PhaseOffset", "Delay", "Rate"], 3.0, 1))])
    got = calibrate(vis, done.solutions[-1], ["PhaseOffset", "Delay", "Rate"])
    return got.groupBy("tcell", "p", "q").agg(F.count("*").alias("n"), r(F.max(F.abs(F.atan2("im", "re"))), 2).alias("worst_phase"), r(F.max(F.abs(F.hypot("re", "im") - 1)), 6).alias("worst_amp"))


def cal_c17_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ripple of every antenna's bandpass against antenna 1, about its mean over channels."""
    k, p, c = F.col("k"), F.col("p"), F.col("c")
    truth = _solution(spark, sf_dir, {"PhaseBandpass": F.sin(k + p * c) * 0.3, "LogAmplitudeBandpass": F.cos(k + p * c) * 0.05}, CHANNELS)
    vis = corrupt(_points(spark, sf_dir).withColumn("fcell", F.col("chan")), truth, ["PhaseBandpass", "LogAmplitudeBandpass"])
    sums = condense(vis.select("source", "p", "q", "i", "j", "re", "im", "w", "tcell", F.lit(1).alias("hcell"), F.lit(1).alias("acell"), F.col("chan").alias("k")))
    b = solve_bandpass(sums, 200, 1e-9, (1, 1))
    mean = b.groupBy("tcell", "p").agg(F.avg("phase").alias("mp"), F.avg("log_amp").alias("ma"))
    return b.join(mean, ["tcell", "p"]).select("tcell", "p", F.col("k").alias("chan"), r(F.col("phase") - F.col("mp"), 2).alias("phase"), r(F.col("log_amp") - F.col("ma"), 3).alias("log_amp"))


def cal_c18_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log gains of every antenna about the cell's mean."""
    truth = _solution(spark, sf_dir, {"LogAmplitudeBandpass": ((F.col("k") + F.col("p")) % 5 - 2) * 0.05})
    vis = corrupt(_points(spark, sf_dir), truth, ["LogAmplitudeBandpass"])
    model = vis.withColumns({"model_re": F.lit(1.0), "model_im": F.lit(0.0), "model_flux": F.lit(1.0)})
    a = normalized(solve_amplitudes(condense_amplitudes(model, 1e4, 3.0, 0.1), 1e-9), "percell")
    return a.select("tcell", "p", r("a", 5).alias("a"), "n_antennas", r("rms_after", 5).alias("rms_after"))


def img_i5_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point of known flux and place in every session's map: the strongest component and the total cleaned flux."""
    k = F.col("source")
    n = F.explode(F.sequence(F.lit(0), F.lit(299))).alias("n")
    uv = _numbers(spark, sf_dir).select(F.col("k").alias("source"), n).withColumn("rho", 0.01 + 0.3 * F.sqrt(F.col("n") / 300)).withColumn("u", F.col("rho") * F.cos(F.col("n") * 2.4)).withColumn("v", F.col("rho") * F.sin(F.col("n") * 2.4))
    arg = (F.col("u") * (k % 7 - 3) + F.col("v") * (k % 5 - 2)) * (2 * math.pi)
    flux = 1 + k % 3
    images = stored(image_sources(uv.select("source", "u", "v", (flux * F.cos(arg)).alias("re"), (flux * F.sin(arg)).alias("im"), F.lit(1e6).alias("w")), Grid(32, 1.0), 0.1, 10_000, 3.0, 1.0))
    first = images.select("source", F.element_at("comp_x", 1).alias("x"), F.element_at("comp_y", 1).alias("y"), r("peak_x", 1).alias("peak_x"), r("peak_y", 1).alias("peak_y"))
    return first.join(cleaned_flux(images), "source").select("source", "x", "y", "peak_x", "peak_y", r("flux", 2).alias("flux"))


def _delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise-free delay observables of 5 antennas on 6 sources over an hour in every session; offsets in mas by formula."""
    n = F.explode(F.sequence(F.lit(0), F.lit(11))).alias("n")
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in range(1, 6) for q in range(p + 1, 6)])).alias("b")
    rows = _numbers(spark, sf_dir).select("session", "k", n).select("session", "k", "n", pairs).select("session", "k", "n", "b.p", "b.q").withColumn("s", F.col("n") % 6).withColumn("t", F.col("n") * 300.0)
    side = lambda f, a: f(F.col("t") / 1000 + F.col(a) * 1.3 + F.col("s")) * 0.02
    rows = rows.withColumn("dtau_dra", side(F.cos, "p") - side(F.cos, "q")).withColumn("dtau_ddec", side(F.sin, "p") - side(F.sin, "q"))
    ra, dec = ((F.col("k") + F.col("s")) % 5 - 2), ((F.col("k") + 2 * F.col("s")) % 5 - 2)
    el = lambda a: 0.6 + 0.3 * F.sin(F.col("t") / 900 + F.col(a) + F.col("s"))
    ends = {f"{c}{e}": x for e, a in (("1", "p"), ("2", "q")) for c, x in (("el", el(a)), ("wet", 1 / F.sin(el(a))), ("grad", 1 / (F.sin(el(a)) * F.tan(el(a)) + 0.0032)), ("az", F.col("t") / 700 + F.col(a)))}
    return rows.withColumns(ends).select(
        (F.col("k") * 1000 + F.col("n") * 20 + F.col("p") * 5 + F.col("q")).cast("bigint").alias("obs_id"), "session", F.concat(F.lit("s"), F.col("s").cast("string")).alias("source"), F.concat(F.lit("A"), F.col("p").cast("string")).alias("a1"), F.concat(F.lit("A"), F.col("q").cast("string")).alias("a2"), F.lit(1).alias("slot"), "t", "n",
        (MAS * (F.col("dtau_dra") * ra + F.col("dtau_ddec") * dec)).alias("tau_residual"), F.lit(1e-12).alias("sigma_tau"), F.lit(0.0).alias("sigma_iono"), "dtau_dra", "dtau_ddec", *ends, F.lit(50.0).alias("snr"))


def est_n7_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of every session's sources in mas."""
    spec = DelayFit("A1", reweight=False, reject=False)
    f = fit_sessions(spec, _delays(spark, sf_dir))
    return f.select("session", "source", r(F.col("ra") / MAS, 3).alias("dra_mas"), r(F.col("dec") / MAS, 3).alias("ddec_mas"), "n")


QUERIES = {f.__name__: f for f in (cal_c9_truth, cal_c8_plane, cal_c11_truth, cal_c12_truth, cal_c17_truth, cal_c18_truth, img_i5_truth, est_n7_truth)}

_K = "k AS (SELECT session, CAST(substr(session, 3) AS INT) k FROM sessions)"
_PQ = f"a AS (SELECT CAST(x AS INT) p FROM range(1, {ANTENNAS + 1}) r(x)), b AS (SELECT x.p p, y.p q FROM a x JOIN a y ON x.p < y.p)"
_D = "(((k + 2 * {0}) % 7 - 3) * 15)"
_R = "(((2 * k + {0}) % 5 - 2) * 30)"

ORACLE = {
    "cal_c9_truth": f"WITH {_K}, {_PQ} SELECT k AS tcell, p, q, {_D.format('p')} - {_D.format('q')} + 0e0 AS delay_ns, {_R.format('p')} - {_R.format('q')} + 0e0 AS rate_mhz FROM k, b",
    "cal_c8_plane": f"WITH {_K}, {_PQ} SELECT k AS tcell, p, q, true AS within_a_bin FROM k, b",
    "cal_c11_truth": f"WITH {_K}, {_PQ} SELECT k AS tcell, p, {_D.format('p')} - {_D.format('1')} + 0e0 AS delay_ns, {_R.format('p')} - {_R.format('1')} + 0e0 AS rate_mhz, true AS anchored FROM k, a",
    "cal_c12_truth": f"WITH {_K}, {_PQ} SELECT k AS tcell, p, q, {len(TIMES) * len(CHANNELS)} AS n, 0e0 AS worst_phase, 0e0 AS worst_amp FROM k, b",
    "cal_c17_truth": f"""
WITH {_K}, {_PQ}, c AS (SELECT k tcell, p, CAST(x AS INT) chan, (sin(k + p * x) - sin(k + x)) * 0.3e0 f, cos(k + p * x) * 0.05e0 g FROM k, a, range(1, {len(CHANNELS) + 1}) r(x))
SELECT tcell, p, chan, round(f - avg(f) OVER w, 2) + 0 AS phase, round(g - avg(g) OVER w, 3) + 0 AS log_amp FROM c WINDOW w AS (PARTITION BY tcell, p)""",
    "cal_c18_truth": f"WITH {_K}, {_PQ}, c AS (SELECT k tcell, p, ((k + p) % 5 - 2) * 0.05e0 g FROM k, a) SELECT tcell, p, round(g - avg(g) OVER (PARTITION BY tcell), 5) + 0 AS a, {ANTENNAS} AS n_antennas, 0e0 AS rms_after FROM c",
    "img_i5_truth": f"WITH {_K} SELECT k AS source, k % 7 - 3 + 0e0 AS x, k % 5 - 2 + 0e0 AS y, k % 7 - 3 + 0e0 AS peak_x, k % 5 - 2 + 0e0 AS peak_y, 1 + k % 3 + 0e0 AS flux FROM k",
    "est_n7_truth": f"WITH {_K} SELECT session, 's' || s AS source, (k + s) % 5 - 2 + 0e0 AS dra_mas, (k + 2 * s) % 5 - 2 + 0e0 AS ddec_mas, 20 AS n FROM k, range(6) r(s)",
}
