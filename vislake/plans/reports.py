"""Queries on observables: residual tables, verdicts, splits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vislake.operators import residuals as res
from vislake.operators import verdicts as ver
from vislake.operators.bandpass import weighted_quantile_column
from vislake.operators.dimensions import common, first_by, longest, missing, tagged_union
from vislake.operators.tsys import has_antenna
from vislake.plans.common import channels, r, with_vis
from vislake.plans.records import _TONES, _names, _tones
from vislake.session import bounded, finite, micros, table


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted observables with residuals in ps (P20)."""
    o = table(spark, sf_dir, "observables").where(finite(F.col("tau_residual")) & finite(F.col("snr")) & finite(F.col("sigma_tau")) & (F.col("snr") >= 7) & (F.col("el1") >= 0.1) & (F.col("el2") >= 0.1) & (F.abs("tau_residual") < 1e-6))
    return o.select("obs_id", "session", "scan", "source", "a1", "a2", F.col("receptor_slot").alias("slot"), "t", "snr", "el1", "el2", (F.col("tau_residual") * 1e12).alias("r"), (1e-24 / (F.col("sigma_tau") ** 2 + 1e-24)).alias("w"), (F.col("tau_ionosphere") * 1e12).alias("iono"), (F.col("sigma_tau_ionosphere") * 1e12).alias("siono"), "delay", "rate", "sigma_tau")


def sel_p20_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obs(spark, sf_dir).select("obs_id", r("r", 3).alias("r"), r("w", 8).alias("w"))


def agg_a17_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return res.robust_sigma(_obs(spark, sf_dir), ["a1", "a2"], "r").select("a1", "a2", r("median", 7).alias("median"), r("sigma", 7).alias("sigma"), "n")


def agg_a18_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return res.source_stats(_obs(spark, sf_dir)).select("source", "n_obs", "n_scans", r("wrms", 4).alias("wrms"), r("snr_median", 4).alias("snr_median"), "snr_max", "n_baselines")


def agg_a19_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _obs(spark, sf_dir)
    return res.breakdown(o, F.pmod(F.col("t") / 3600, F.lit(24.0))).select("kind", "key", "n", r("wrms", 4).alias("wrms"))


def agg_a20_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return res.baseline_stats(_obs(spark, sf_dir)).select("a1", "a2", "n", r("wrms", 4).alias("wrms"), r("mean", 9).alias("mean"), r("snr_median", 4).alias("snr_median"))


def agg_a20_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"elevation": F.degrees(F.least("el1", "el2")), "iono_abs": F.abs("iono"), "sigma_iono": F.col("siono"), "snr": F.col("snr")}
    return res.binned(_obs(spark, sf_dir), values).select("kind", "bin", "n", r("wrms", 4).alias("wrms"), r("mean", 4).alias("mean"), r("median_abs", 4).alias("median_abs"))


def agg_a20_wander(spark: SparkSession, sf_dir: str) -> DataFrame:
    return res.wander(res.scan_means(_obs(spark, sf_dir))).select("session", "antenna", "n_scans", r("scan_rms", 4).alias("scan_rms"), r("scan_step", 4).alias("scan_step"))


def agg_a20_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return res.spectra(res.scan_means(_obs(spark, sf_dir)), [0.25, 0.5, 0.75]).select("session", "antenna", "period_h", r("amplitude", 3).alias("amplitude"))


def _triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _obs(spark, sf_dir)
    return res.delay_triangles(o.select("obs_id", "session", "scan", "source", "slot", "a1", "a2", (F.col("delay") * 1e12).alias("delay"), (F.col("sigma_tau") * 1e12).alias("sigma"), "snr"))


def join_j9_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triangles(spark, sf_dir).select("session", "scan", "source", "slot", "a", "b", "c", r("closure", 3).alias("closure"), r("thermal", 4).alias("thermal"), "min_snr")


def agg_a16_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _triangles(spark, sf_dir)
    return res.closure_floor(t, ((100.0, float("inf")), (50.0, 100.0), (20.0, 50.0), (0.0, 20.0))).select("bin", "n", r("sigma", 3).alias("sigma"), r("thermal", 4).alias("thermal"), r("excess", 3).alias("excess"))


def agg_a15_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _obs(spark, sf_dir).groupBy("source", "r").agg(F.sum("w").alias("w"))
    return weighted_quantile_column(o, ["source"], "r", "w", 0.9).select("source", r("value", 3).alias("value"))


def agg_a22_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _obs(spark, sf_dir)
    rows = o.select(F.concat_ws("|", "session", "scan", "a1").alias("row_key"), F.col("a1").alias("group"), F.col("slot").alias("fcell"), F.col("r").alias("delay"), "snr")
    return res.window_structure(rows, 10.0).select("n_groups", r("static_rms", 3).alias("static_rms"), r("var_rms", 3).alias("var_rms"), r("var_mad", 3).alias("var_mad"))


def join_j11_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _obs(spark, sf_dir)
    return res.match_rows(o.where("snr < 60"), o.where("snr > 30")).groupBy("session", "slot").agg(F.count("*").alias("n"), r(F.sum(F.col("r_a") - F.col("r_b")), 2).alias("d"))


def join_j12_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _obs(spark, sf_dir)
    half = lambda e: o.where(e).groupBy("source").agg(F.avg("r").alias("ra"), F.avg("iono").alias("dec"))
    c = res.compare_positions(half("slot = 1"), half("slot = 2"))
    return c.select("n", *[r(x, 3).alias(x) for x in ("mean_ra", "mean_dec", "rms_ra", "rms_dec", "worst")])


def win_w10_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return res.splits(_obs(spark, sf_dir), ["session"]).groupBy("session", "early", "odd").agg(F.count("*").alias("n"), r(F.avg("r"), 10).alias("mean"))


def win_w4_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dataset").where(finite(F.col("vis_re")) & finite(F.col("vis_im"))).select("vis_id", F.concat_ws("|", "session", "a1", "a2").alias("b"), F.struct("datetime", "vis_id").alias("o"), F.atan2(F.col("vis_im") + 0.0, "vis_re").alias("phase"))
    return res.unwrapped(d, ["b"], "o", "phase").select("vis_id", r("unwrapped", 5).alias("unwrapped"))


def agg_a34_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return res.slope(_obs(spark, sf_dir), ["session", "a1", "a2"], "t", "r", "w").select("session", "a1", "a2", r("slope", 5).alias("slope"), "n")


def agg_a26_identifiability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return res.identifiability(table(spark, sf_dir, "dataset").select("session", "t", "source"), 600.0)


def agg_a28_jet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return res.jet_geometry(_components(spark, sf_dir)).select("source", r("pa_deg", 5).alias("pa_deg"), r("radius").alias("radius"))


def agg_a29_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return res.structure_moment(_components(spark, sf_dir), 5e5).select("source", r("pa_deg", 5).alias("pa_deg"), r("radius", 4).alias("radius"), r("flux", 8).alias("flux"), "n")


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dataset").where(finite(F.col("vis_re")) & (F.col("weight") > 0.5))
    return d.groupBy("source", "u_m", "v_m").agg(F.max("vis_re").alias("flux")).select("source", "flux", F.col("u_m").alias("x"), F.col("v_m").alias("y"))


def agg_a31_nu_eff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return res.nu_eff(channels(spark)).select(r("nu_eff", 0).alias("nu_eff"))


def sel_p22_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _obs(spark, sf_dir).select(F.col("obs_id").alias("idx"), F.col("t").alias("x"), F.col("r").alias("y"))
    return res.decimate(p, {"x": (0.0, 4000.0), "y": (-200.0, 200.0)}, 20).select("idx", "x")


def set_o7_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with conflicting numbers: none may be."""
    return table(spark, sf_dir, "antennas").groupBy("name").agg(F.countDistinct("antenna_no").alias("n_numbers"), F.count("*").alias("n_rows"))


def set_o8_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that both tables have."""
    return common(table(spark, sf_dir, "dataset"), table(spark, sf_dir, "observables"), ["source"])


def set_o9_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Antennas of the register that the data never name."""
    d = table(spark, sf_dir, "dataset")
    return missing(table(spark, sf_dir, "antennas").select("name"), [d.select("a1"), d.select("a2")])


def set_o10_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of every baseline wins."""
    return first_by(table(spark, sf_dir, "dataset"), ["session", "a1", "a2"], "vis_id", ["source"])


def set_o6_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two tables in one (O6), counted per session and table."""
    both = tagged_union({n: table(spark, sf_dir, n) for n in ("dataset", "observables")}, ["session", "a1", "a2"])
    return both.groupBy("tab", "session").agg(F.count("*").alias("n"))


def set_o5_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst ten baselines of every session by wrms."""
    g = _obs(spark, sf_dir).groupBy("session", "a1", "a2").agg(res.wrms().alias("wrms"))
    return longest(g, ["session"], [F.desc("wrms"), F.col("a1"), F.col("a2")], 10).select("session", "a1", "a2", r("wrms", 4).alias("wrms"), "rank")


def diag_d10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dataset")
    expected = d.select("session", F.explode(F.array("a1", "a2")).alias("antenna")).distinct()
    have = table(spark, sf_dir, "gain_curve").join(bounded(_names(spark, sf_dir)), "antenna_no").groupBy("session", "antenna").agg(F.count("*").alias("n"))
    return ver.coverage(have, expected).select("level", "gate", "subject", F.col("measured")["n"].alias("n"))


def diag_d11_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ver.scan_verdicts(table(spark, sf_dir, "dataset")).select("level", "gate", "subject", F.col("measured")["n_sources"].alias("n_sources"))


def diag_d12_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ver.tone_verdicts(_tones(spark, sf_dir), ["session", "antenna_no"], 0.3)
    return v.select("level", "gate", "subject", r(F.col("measured")["weak_pct"], 6).alias("weak_pct"), r(F.col("measured")["median_amp"], 8).alias("median_amp"))


def diag_d13_cable(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tones").where(has_antenna(F.col("antenna_no"))).select("session", "antenna_no", micros(F.col("time")).alias("t"), F.col("tone_id").alias("row_id"), F.col("cable_cal").alias("cable"))
    c = ver.cable_census(t, ["session", "antenna_no"])
    return c.select("session", "antenna_no", "n", r(F.col("median") * 1e12, 5).alias("median_ps"), r(F.col("ptp") * 1e12, 5).alias("ptp_ps"), r(F.col("sigma") * 1e12, 5).alias("sigma_ps"), "jumps", "verdict")


def diag_d14_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tones").where(has_antenna(F.col("antenna_no")) & finite(F.col("cable_cal"))).groupBy("session", "antenna_no", micros(F.col("time")).alias("t")).agg((F.avg("cable_cal") * 1e12).alias("x"))
    g = ver.gap_steps(t, ["session", "antenna_no"], 180e6, 5, 5.0)
    return g.select("session", "antenna_no", "t_from", r("step", 7).alias("step"), r("sigma", 7).alias("sigma"))


def diag_d15_amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = table(spark, sf_dir, "system_temperature").join(bounded(table(spark, sf_dir, "sessions").select("session", "tsys_ceiling")), "session").where(has_antenna(F.col("antenna_no")))
    return ver.amplitude_census(st.select("session", "antenna_no", F.col("tsys_1").alias("tsys"), "tsys_ceiling"), ["session", "antenna_no"], "tsys_ceiling")


def diag_d17_fringes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "observables").where(finite(F.col("snr")) & finite(F.col("delay")) & finite(F.col("rate")))
    c = ver.fringe_census(o, 7.0, 2e-8, 5e-3)
    return c.select("session", "n", r("detection", 8).alias("detection"), "snr_median", r(F.col("delay_max") * 1e12, 2).alias("delay_max_ps"), r("rate_max", 8).alias("rate_max"), "level")


def diag_d18_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dataset")
    expected = d.select("session", F.explode(F.array("a1", "a2")).alias("antenna")).distinct()
    have = table(spark, sf_dir, "gain_curve").join(bounded(_names(spark, sf_dir)), "antenna_no").groupBy("session", "antenna").agg(F.count("*").alias("n"))
    return ver.summary(ver.coverage(have, expected).unionByName(ver.scan_verdicts(d)).unionByName(ver.tone_verdicts(_tones(spark, sf_dir), ["session", "antenna_no"], 0.3)))


QUERIES = {
    f.__name__: f
    for f in (
        sel_p20_accepted, agg_a17_robust, agg_a18_sources, agg_a19_breakdown, agg_a20_baselines, agg_a20_bins, agg_a20_wander, agg_a20_spectra, join_j9_delays, agg_a16_floor, agg_a15_quantile, agg_a22_windows, join_j11_match, join_j12_positions,
        win_w10_splits, win_w4_unwrap, agg_a34_slope, agg_a26_identifiability, agg_a28_jet, agg_a29_moment, agg_a31_nu_eff, sel_p22_decimate, set_o5_longest, set_o6_union, set_o7_distinct, set_o8_common, set_o9_missing, set_o10_first,
        diag_d10_coverage, diag_d11_scans, diag_d12_tones, diag_d13_cable, diag_d14_steps, diag_d15_amplitudes, diag_d17_fringes, diag_d18_summary,
    )
}

_O = """o AS (SELECT obs_id, session, scan, source, a1, a2, receptor_slot slot, t, snr, el1, el2, tau_residual * 1e12 r, 1e-24 / (sigma_tau ** 2 + 1e-24) w, tau_ionosphere * 1e12 iono, sigma_tau_ionosphere * 1e12 siono, delay, rate, sigma_tau
  FROM observables WHERE isfinite(tau_residual) AND isfinite(snr) AND isfinite(sigma_tau) AND snr >= 7 AND el1 >= 0.1 AND el2 >= 0.1 AND abs(tau_residual) < 1e-6)"""
_MEANS = "sm AS (SELECT session, antenna, scan, avg(r * s) mu, median(t) tm, count(*) n FROM (SELECT session, a2 antenna, scan, r, t, 1e0 s FROM o UNION ALL SELECT session, a1, scan, r, t, -1e0 FROM o) GROUP BY ALL)"
_TRI = """ed AS (SELECT session, scan, source, slot, least(a1, a2) p, greatest(a1, a2) q, arg_max(CASE WHEN a1 > a2 THEN -delay ELSE delay END * 1e12, obs_id) d, arg_max(sigma_tau * 1e12, obs_id) s, arg_max(snr, obs_id) n FROM o WHERE a1 <> a2 GROUP BY ALL),
tri AS (SELECT x.session, x.scan, x.source, x.slot, x.p a, x.q b, y.q c, x.d + y.d - z.d closure, sqrt(x.s ** 2 + y.s ** 2 + z.s ** 2) thermal, least(x.n, y.n, z.n) min_snr
  FROM ed x JOIN ed y ON x.session = y.session AND x.scan = y.scan AND x.source = y.source AND x.slot = y.slot AND x.q = y.p JOIN ed z ON x.session = z.session AND x.scan = z.scan AND x.source = z.source AND x.slot = z.slot AND x.p = z.p AND y.q = z.q)"""


def _band(x: str, edges: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {a} AND {x} < {b} THEN {k}" for k, (a, b) in enumerate(zip(edges, edges[1:]))) + " END"


_W = "sqrt(sum(w * r * r) / sum(w))"
_COMP = "co AS (SELECT source, u_m x, v_m y, max(vis_re) flux FROM dataset WHERE isfinite(vis_re) AND weight > 0.5 AND NOT isnan(weight) GROUP BY ALL)"
_PI2 = "6.283185307179586::DOUBLE"
_COV = """ex AS (SELECT DISTINCT session, antenna FROM (SELECT session, a1 antenna FROM dataset UNION SELECT session, a2 FROM dataset)),
hv AS (SELECT session, name antenna, count(*) n FROM gain_curve JOIN (SELECT DISTINCT antenna_no, name FROM antennas) USING (antenna_no) GROUP BY ALL),
cov AS (SELECT CASE WHEN n IS NULL THEN 'fail' WHEN n < 3 THEN 'warn' ELSE 'pass' END lvl, ex.session || '|' || ex.antenna subject, coalesce(n, 0) n FROM ex LEFT JOIN hv USING (session, antenna))"""
_SCV = "sv AS (SELECT CASE WHEN count(DISTINCT source) > 1 THEN 'fail' ELSE 'pass' END lvl, session || '|' || scan subject, count(DISTINCT source) n FROM dataset GROUP BY session, scan)"
_TNV = """ta AS (SELECT *, sqrt(re * re + im * im) amp FROM lt), tm AS (SELECT *, median(amp) OVER (PARTITION BY session, antenna_no, band, tone) m FROM ta),
tv AS (SELECT session || '|' || antenna_no subject, 100 * avg(CAST(amp < 0.3 * m AS INT)) weak, median(amp) med FROM tm GROUP BY session, antenna_no)"""

ORACLE = {
    "sel_p20_accepted": f"WITH {_O} SELECT obs_id, round(r, 3) + 0 AS r, round(w, 8) + 0 AS w FROM o",
    "agg_a17_robust": f"WITH {_O}, m AS (SELECT *, median(r) OVER (PARTITION BY a1, a2) md FROM o) SELECT a1, a2, round(min(md), 7) + 0 AS median, round(1.4826 * median(abs(r - md)), 7) + 0 AS sigma, count(*) AS n FROM m GROUP BY ALL",
    "agg_a18_sources": f"WITH {_O} SELECT source, count(*) AS n_obs, count(DISTINCT (session, scan)) AS n_scans, round({_W}, 4) + 0 AS wrms, round(median(snr), 4) + 0 AS snr_median, max(snr) AS snr_max, count(DISTINCT (a1, a2)) AS n_baselines FROM o GROUP BY ALL",
    "agg_a19_breakdown": f"""WITH {_O}, k AS (SELECT 'antenna' kind, a1 key, r, w FROM o UNION ALL SELECT 'antenna', a2, r, w FROM o UNION ALL SELECT 'slot', CAST(slot AS VARCHAR), r, w FROM o
  UNION ALL SELECT 'elevation', CAST({_band('degrees(least(el1, el2))', res.ELEVATION_BANDS)} AS VARCHAR), r, w FROM o UNION ALL SELECT 'hour', CAST({_band('(t / 3600) % 24', res.HOUR_BANDS)} AS VARCHAR), r, w FROM o)
SELECT kind, key, count(*) AS n, round({_W}, 4) + 0 AS wrms FROM k WHERE key IS NOT NULL GROUP BY ALL""",
    "agg_a20_baselines": f"WITH {_O} SELECT a1, a2, count(*) AS n, round({_W}, 4) + 0 AS wrms, round(avg(r), 9) + 0 AS mean, round(median(snr), 4) + 0 AS snr_median FROM o GROUP BY ALL",
    "agg_a20_bins": f"""WITH {_O}, k AS (SELECT 'elevation' kind, {_band('degrees(least(el1, el2))', res.BINS['elevation'])} bin, r, w FROM o UNION ALL SELECT 'iono_abs', {_band('abs(iono)', res.BINS['iono_abs'])}, r, w FROM o
  UNION ALL SELECT 'sigma_iono', {_band('siono', res.BINS['sigma_iono'])}, r, w FROM o UNION ALL SELECT 'snr', {_band('snr', res.BINS['snr'])}, r, w FROM o)
SELECT kind, CAST(bin AS INT) AS bin, count(*) AS n, round({_W}, 4) + 0 AS wrms, round(avg(r), 4) + 0 AS mean, round(median(abs(r)), 4) + 0 AS median_abs FROM k WHERE bin IS NOT NULL GROUP BY ALL""",
    "agg_a20_wander": f"WITH {_O}, {_MEANS} SELECT session, antenna, count(*) AS n_scans, round(sqrt(avg(mu * mu)), 4) + 0 AS scan_rms, round(sqrt(avg(d * d) / 2), 4) + 0 AS scan_step FROM (SELECT *, mu - lag(mu) OVER (PARTITION BY session, antenna ORDER BY scan) d FROM sm) GROUP BY ALL",
    "agg_a20_spectra": f"""WITH {_O}, {_MEANS}, y AS (SELECT session, antenna, mu - avg(mu) OVER w y, tm / 3600 h, count(*) OVER w k FROM sm WINDOW w AS (PARTITION BY session, antenna)),
s AS (SELECT session, antenna, p, sum(cos(a) ** 2) cc, sum(sin(a) ** 2) ss, sum(cos(a) * sin(a)) cs, sum(cos(a) * y) cy, sum(sin(a) * y) sy FROM (SELECT *, h * {_PI2} / p a FROM y, (VALUES (0.25e0), (0.5e0), (0.75e0)) v(p) WHERE k >= 4) GROUP BY ALL)
SELECT session, antenna, p AS period_h, round(sqrt(((cy * ss - sy * cs) / (cc * ss - cs * cs)) ** 2 + ((sy * cc - cy * cs) / (cc * ss - cs * cs)) ** 2), 3) + 0 AS amplitude FROM s""",
    "join_j9_delays": f"WITH {_O}, {_TRI} SELECT session, scan, source, slot, a, b, c, round(closure, 3) + 0 AS closure, round(thermal, 4) + 0 AS thermal, min_snr FROM tri",
    "agg_a16_floor": f"""WITH {_O}, {_TRI}, b AS (SELECT *, CASE WHEN min_snr >= 100 THEN 0 WHEN min_snr >= 50 THEN 1 WHEN min_snr >= 20 THEN 2 WHEN min_snr >= 0 THEN 3 END bin FROM tri), m AS (SELECT *, median(closure) OVER (PARTITION BY bin) md FROM b),
s AS (SELECT bin, count(*) n, 1.4826 * median(abs(closure - md)) sigma, median(thermal) thermal FROM m GROUP BY bin)
SELECT CAST(bin AS INT) AS bin, n, round(sigma, 3) + 0 AS sigma, round(thermal, 4) + 0 AS thermal, round(sqrt(greatest(sigma ** 2 - thermal ** 2, 0)) / sqrt(3), 3) + 0 AS excess FROM s""",
    "agg_a15_quantile": f"""WITH {_O}, g AS (SELECT source, r, sum(w) w FROM o GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY source ORDER BY r, w ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY source) hi, sum(w * w) OVER (PARTITION BY source) / (sum(w) OVER (PARTITION BY source)) ** 2 / 2 half FROM g),
l AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY source ORDER BY r, w), 0) lo FROM c), v AS (SELECT *, greatest(least(hi, 0.9 + half) - greatest(lo, 0.9 - half), 0) ov FROM l)
SELECT source, round(sum(ov * r) / sum(ov), 3) + 0 AS value FROM v GROUP BY source""",
    "agg_a22_windows": f"""WITH {_O}, k AS (SELECT session || '|' || scan || '|' || a1 rk, a1 grp, slot, r, snr FROM o),
d AS (SELECT *, r - avg(r) OVER (PARTITION BY rk) d, min(CASE WHEN snr >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY rk) ok FROM k),
v AS (SELECT *, avg(d) OVER (PARTITION BY grp, slot) m, count(*) OVER (PARTITION BY grp, slot) n FROM d WHERE ok = 1), u AS (SELECT * FROM v WHERE n >= 3)
SELECT (SELECT count(*) FROM (SELECT DISTINCT grp, slot FROM u)) AS n_groups, round((SELECT sqrt(avg(m * m)) FROM (SELECT DISTINCT grp, slot, m FROM u)), 3) + 0 AS static_rms, round(sqrt(avg((d - m) ** 2)), 3) + 0 AS var_rms, round(1.4826 * median(abs(d - m)), 3) + 0 AS var_mad FROM u""",
    "join_j11_match": f"WITH {_O} SELECT a.session, a.slot, count(*) AS n, round(sum(a.r - b.r), 2) + 0 AS d FROM o a JOIN o b USING (session, scan, a1, a2, slot) WHERE a.snr < 60 AND b.snr > 30 GROUP BY ALL",
    "join_j12_positions": f"WITH {_O}, s AS (SELECT source, slot, avg(r) ra, avg(iono) de FROM o GROUP BY ALL), j AS (SELECT a.ra - b.ra x, a.de - b.de y FROM s a JOIN s b ON a.source = b.source AND a.slot = 1 AND b.slot = 2) SELECT count(*) AS n, round(avg(x), 3) + 0 AS mean_ra, round(avg(y), 3) + 0 AS mean_dec, round(sqrt(avg(x * x)), 3) + 0 AS rms_ra, round(sqrt(avg(y * y)), 3) + 0 AS rms_dec, round(max(sqrt(x * x + y * y)), 3) + 0 AS worst FROM j",
    "win_w10_splits": f"WITH {_O}, s AS (SELECT *, t < median(t) OVER (PARTITION BY session) early, dense_rank() OVER (PARTITION BY session ORDER BY scan) % 2 = 1 odd FROM o) SELECT session, early, odd, count(*) AS n, round(avg(r), 10) + 0 AS mean FROM s GROUP BY ALL",
    "win_w4_unwrap": f"""WITH d AS (SELECT vis_id, session || '|' || a1 || '|' || a2 b, datetime, atan2(vis_im + 0e0, vis_re) ph FROM dataset WHERE isfinite(vis_re) AND isfinite(vis_im)),
s AS (SELECT *, ph - lag(ph) OVER o st, first_value(ph) OVER o f FROM d WINDOW o AS (PARTITION BY b ORDER BY datetime, vis_id)),
w AS (SELECT *, coalesce(st - {_PI2} * round_even(st / {_PI2}, 0), 0) q FROM s)
SELECT vis_id, round(f + sum(q) OVER (PARTITION BY b ORDER BY datetime, vis_id ROWS UNBOUNDED PRECEDING), 5) + 0 AS unwrapped FROM w""",
    "agg_a34_slope": f"WITH {_O}, g AS (SELECT session, a1, a2, sum(w) sw, sum(w * t) sx, sum(w * t * t) sxx, sum(w * r) sy, sum(w * t * r) sxy, count(*) n FROM o GROUP BY ALL) SELECT session, a1, a2, round(CASE WHEN sw * sxx - sx * sx > 1e-12 * sw * sxx THEN (sw * sxy - sx * sy) / (sw * sxx - sx * sx) END, 5) + 0 AS slope, n FROM g",
    "agg_a26_identifiability": """
WITH b AS (SELECT session, t, source, min(t) OVER w t0, max(t) OVER w t1 FROM dataset WINDOW w AS (PARTITION BY session)),
c AS (SELECT session, least(floor((t - t0) / 600) + 1, greatest(ceil((t1 - t0) / 600), 1)) cell, source, t FROM b), g AS (SELECT session, cell, count(DISTINCT source) k, max(t) - min(t) span FROM c GROUP BY ALL)
SELECT session, count(*) FILTER (span >= 300) AS n_cells, min(k) FILTER (span >= 300) AS n_min, median(k) FILTER (span >= 300) AS n_median, max(k) FILTER (span >= 300) AS n_max, count(*) FILTER (span < 300) AS n_stubs FROM g GROUP BY session""",
    "agg_a28_jet": f"""WITH {_COMP}, c AS (SELECT source, flux cf, x cx, y cy FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY flux DESC, x, y) n FROM co) WHERE n = 1),
g AS (SELECT source, sum(flux) FILTER (k) sw, sum(flux * (x - cx)) FILTER (k) sx, sum(flux * (y - cy)) FILTER (k) sy FROM (SELECT *, NOT (flux = cf AND x = cx AND y = cy) k FROM co JOIN c USING (source)) GROUP BY source)
SELECT source, round(degrees(atan2(sx / sw, sy / sw)), 5) + 0 AS pa_deg, round(sqrt((sx / sw) ** 2 + (sy / sw) ** 2), 6) + 0 AS radius FROM g""",
    "agg_a29_moment": f"""WITH {_COMP}, c AS (SELECT source, x cx, y cy FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY abs(flux) DESC, x, y) n FROM co) WHERE n = 1),
g AS (SELECT source, sum(flux) FILTER (k) f, sum(flux * dx) FILTER (k) sx, sum(flux * dy) FILTER (k) sy, count(*) FILTER (k) n FROM (SELECT *, x - cx dx, y - cy dy, sqrt((x - cx) ** 2 + (y - cy) ** 2) > 0 AND sqrt((x - cx) ** 2 + (y - cy) ** 2) <= 5e5 AND flux > 0 k FROM co JOIN c USING (source)) GROUP BY source)
SELECT source, round(degrees(atan2(sx / f, sy / f)), 5) + 0 AS pa_deg, round(sqrt((sx / f) ** 2 + (sy / f) ** 2), 4) + 0 AS radius, round(coalesce(f, 0), 8) + 0 AS flux, n FROM g""",
    "agg_a31_nu_eff": with_vis("SELECT round(sqrt(-var_pop(nu) / covar_pop(nu, 1 / nu)), 0) + 0 AS nu_eff FROM channels"),
    "sel_p22_decimate": f"WITH {_O}, p AS (SELECT obs_id, t, least(floor(t / 4000 * 20), 19) bx, least(floor((r + 200) / 400 * 20), 19) b FROM o WHERE t BETWEEN 0 AND 4000 AND r BETWEEN -200 AND 200) SELECT min(obs_id) AS idx, arg_min(t, obs_id) AS x FROM p GROUP BY bx, b",
    "set_o5_longest": f"WITH {_O}, g AS (SELECT session, a1, a2, {_W} x FROM o GROUP BY ALL), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY x DESC, a1, a2) AS INT) n FROM g) SELECT session, a1, a2, round(x, 4) + 0 AS wrms, n AS rank FROM k WHERE n <= 10",
    "set_o6_union": "SELECT tab, session, count(*) AS n FROM (SELECT 'dataset' tab, session FROM dataset UNION ALL SELECT 'observables', session FROM observables) GROUP BY ALL",
    "set_o7_distinct": "SELECT name, count(DISTINCT antenna_no) AS n_numbers, count(*) AS n_rows FROM antennas GROUP BY name",
    "set_o8_common": "SELECT source FROM dataset INTERSECT SELECT source FROM observables",
    "set_o9_missing": "SELECT name FROM antennas EXCEPT (SELECT a1 FROM dataset UNION SELECT a2 FROM dataset)",
    "set_o10_first": "SELECT session, a1, a2, arg_min(source, vis_id) AS source, min(vis_id) AS vis_id FROM dataset GROUP BY ALL",
    "diag_d10_coverage": f"WITH {_COV} SELECT lvl AS level, 'coverage' AS gate, subject, CAST(n AS DOUBLE) AS n FROM cov",
    "diag_d11_scans": f"WITH {_SCV} SELECT lvl AS level, 'scan-sources' AS gate, subject, CAST(n AS DOUBLE) AS n_sources FROM sv",
    "diag_d12_tones": f"WITH {_TONES}, {_TNV} SELECT CASE WHEN weak > 5 THEN 'warn' ELSE 'pass' END AS level, 'pcal-tone-health' AS gate, subject, round(weak, 6) + 0 AS weak_pct, round(med, 8) + 0 AS median_amp FROM tv",
    "diag_d13_cable": """
WITH d AS (SELECT session, antenna_no, cable_cal c, cable_cal - lag(cable_cal) OVER (PARTITION BY session, antenna_no ORDER BY time, tone_id) d FROM tones WHERE antenna_no >= 1 AND isfinite(cable_cal)),
m AS (SELECT *, median(d) OVER (PARTITION BY session, antenna_no) dm FROM d), s AS (SELECT *, 1.4826 * median(abs(d - dm)) OVER (PARTITION BY session, antenna_no) sg FROM m),
j AS (SELECT *, coalesce(abs(d) > greatest(10 * sg, 100e-12), false) jump FROM s),
g AS (SELECT session, antenna_no, count(*) n, median(c) md, max(c) - min(c) ptp, min(sg) sg, count(*) FILTER (jump) jumps, median(abs(d)) FILTER (jump) typ FROM j GROUP BY ALL)
SELECT session, antenna_no, n, round(md * 1e12, 5) + 0 AS median_ps, round(ptp * 1e12, 5) + 0 AS ptp_ps, round(sg * 1e12, 5) + 0 AS sigma_ps, jumps, CASE WHEN ptp = 0 OR (sg = 0 AND ptp < 1e-15) THEN 'dead constant' WHEN jumps > 5 AND typ > 0.5e-9 THEN 'wrap-like steps' WHEN jumps > 0 THEN 'steps' ELSE 'ok' END AS verdict FROM g""",
    "diag_d14_steps": """
WITH x AS (SELECT session, antenna_no, epoch_us(time) t, avg(cable_cal) * 1e12 x FROM tones WHERE antenna_no >= 1 AND isfinite(cable_cal) GROUP BY ALL),
i0 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session, antenna_no ORDER BY t) > 180000000 THEN 1 ELSE 0 END n FROM x), i AS (SELECT *, sum(n) OVER (PARTITION BY session, antenna_no ORDER BY t ROWS UNBOUNDED PRECEDING) isle FROM i0),
h AS (SELECT *, row_number() OVER (PARTITION BY session, antenna_no, isle ORDER BY t) hd, row_number() OVER (PARTITION BY session, antenna_no, isle ORDER BY t DESC) tl FROM i),
g AS (SELECT session, antenna_no, isle, avg(x) FILTER (hd <= 5) mh, var_samp(x) FILTER (hd <= 5) vh, count(x) FILTER (hd <= 5) nh, avg(x) FILTER (tl <= 5) mt, var_samp(x) FILTER (tl <= 5) vt, count(x) FILTER (tl <= 5) nt, min(t) t0 FROM h GROUP BY ALL),
l AS (SELECT *, lag(mt) OVER b m0, lag(vt) OVER b v0, lag(nt) OVER b n0 FROM g WINDOW b AS (PARTITION BY session, antenna_no ORDER BY isle))
SELECT session, antenna_no, t0 AS t_from, round(mh - m0, 7) + 0 AS step, round(sqrt(vh / nh + v0 / n0), 7) + 0 AS sigma FROM l WHERE n0 >= 2 AND nh >= 2""",
    "diag_d15_amplitudes": """
WITH x AS (SELECT t.session, antenna_no, tsys_1 x, tsys_ceiling c, coalesce(isnan(tsys_1) OR isinf(tsys_1) OR tsys_1 <= 0, false) bad FROM system_temperature t JOIN sessions USING (session) WHERE antenna_no >= 1)
SELECT session, antenna_no, count(*) AS n, count(*) FILTER (x IS NULL) AS n_absent, count(*) FILTER (bad) AS n_bad, count(*) FILTER (NOT bad AND x > c) AS n_high, median(x) FILTER (NOT bad AND NOT coalesce(x > c, false)) AS median FROM x GROUP BY ALL""",
    "diag_d17_fringes": """
WITH g AS (SELECT session, count(*) n, avg(CAST(snr >= 7 AS INT)) det, median(snr) sm, max(abs(delay)) FILTER (snr >= 7) dm, max(abs(rate)) FILTER (snr >= 7) rm FROM observables WHERE isfinite(snr) AND isfinite(delay) AND isfinite(rate) GROUP BY session)
SELECT session, n, round(det, 8) + 0 AS detection, sm AS snr_median, round(dm * 1e12, 2) + 0 AS delay_max_ps, round(rm, 8) + 0 AS rate_max, CASE WHEN det >= 0.9 AND dm < 0.9 * 2e-8 AND rm < 0.9 * 5e-3 THEN 'pass' ELSE 'warn' END AS level FROM g""",
    "diag_d18_summary": f"""WITH {_COV}, {_SCV}, {_TONES}, {_TNV}, al AS (SELECT 'coverage' gate, lvl FROM cov UNION ALL SELECT 'scan-sources', lvl FROM sv UNION ALL SELECT 'pcal-tone-health', CASE WHEN weak > 5 THEN 'warn' ELSE 'pass' END FROM tv)
SELECT gate, count(*) FILTER (lvl = 'pass') AS n_pass, count(*) FILTER (lvl = 'warn') AS n_warn, count(*) FILTER (lvl = 'fail') AS n_fail FROM al GROUP BY gate""",
}

