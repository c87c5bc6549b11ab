"""Tables over observables and post-fit residuals.

rows: one per observable with session, scan, source, a1, a2, slot, t, snr, el1, el2, r (residual), w (weight). All are hash
aggregates and windows inside small keys (a baseline's scans, an antenna's scans).
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vislake.functions.complexmath import TWO_PI, wrap

#: Elevation bands in degrees and UT bands in hours of the breakdown.
ELEVATION_BANDS = (7, 15, 25, 45, 90)
HOUR_BANDS = (0, 4, 8, 12, 16, 20, 24)
#: Bins of the forensic census: kind -> edges.
BINS = {
    "elevation": (7, 10, 15, 20, 25, 35, 50, 90), "hour_ut": tuple(range(0, 25, 2)), "iono_abs": (0, 5, 10, 20, 40, 80, 160, 1000),
    "sigma_iono": (0, 5, 10, 15, 20, 30, 50, 500), "snr": (7, 15, 30, 60, 120, 250, 500, 1_000_000),
}
#: SNR bins of the closure floor, by the weakest leg.
CLOSURE_BINS = ((1000.0, float("inf")), (300.0, 1000.0), (100.0, 300.0), (0.0, 100.0))


def wrms(r: str = "r", w: str = "w") -> Column:
    """Weighted rms as an aggregate; NULL without weight."""
    return F.sqrt(F.try_divide(F.sum(F.col(w) * F.col(r) * F.col(r)), F.sum(w)))


def robust_sigma(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, median, sigma, n): 1.4826 times the median distance to the median."""
    med = rows.groupBy(*by).agg(F.median(x).alias("median"))
    j = rows.join(med, by)
    return j.groupBy(*by).agg(F.first("median").alias("median"), (1.4826 * F.median(F.abs(F.col(x) - F.col("median")))).alias("sigma"), F.count(x).alias("n"))


def _band(x: Column, edges: tuple) -> Column:
    """Number of the band from 0; NULL outside."""
    out = F.lit(None).cast("int")
    for k, (a, b) in reversed(list(enumerate(zip(edges, edges[1:])))):
        out = F.when((x >= a) & (x < b), k).otherwise(out)
    return out


def breakdown(rows: DataFrame, hour: Column) -> DataFrame:
    """(kind, key, n, wrms): by antenna (a row counts for both), slot, elevation band (lower of the two) and UT band.

    One pass: every row is expanded to its five groups and aggregated once.
    """
    low = F.degrees(F.least("el1", "el2"))
    item = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    keys = F.explode(F.array(item("antenna", F.col("a1")), item("antenna", F.col("a2")), item("slot", F.col("slot")), item("elevation", _band(low, ELEVATION_BANDS)), item("hour", _band(hour, HOUR_BANDS)))).alias("k")
    return rows.select("r", "w", keys).where(F.col("k.key").isNotNull()).groupBy("k.kind", "k.key").agg(F.count("*").alias("n"), wrms().alias("wrms"))


def source_stats(rows: DataFrame) -> DataFrame:
    """(source, n_obs, n_scans, wrms, snr_median, snr_max, n_baselines)."""
    return rows.groupBy("source").agg(F.count("*").alias("n_obs"), F.countDistinct("session", "scan").alias("n_scans"), wrms().alias("wrms"), F.median("snr").alias("snr_median"), F.max("snr").alias("snr_max"), F.countDistinct("a1", "a2").alias("n_baselines"))


def baseline_stats(rows: DataFrame) -> DataFrame:
    """(a1, a2, n, wrms, mean, snr_median)."""
    return rows.groupBy("a1", "a2").agg(F.count("*").alias("n"), wrms().alias("wrms"), F.avg("r").alias("mean"), F.median("snr").alias("snr_median"))


def binned(rows: DataFrame, values: dict[str, Column], bins: dict[str, tuple] | None = None) -> DataFrame:
    """(kind, bin, n, wrms, mean, median_abs) over the bins of several quantities (A20); one expansion, one aggregate."""
    bins = bins or BINS
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), _band(v, bins[k]).alias("bin")) for k, v in values.items()])).alias("b")
    return rows.select("r", "w", keys).where(F.col("b.bin").isNotNull()).groupBy("b.kind", "b.bin").agg(F.count("*").alias("n"), wrms().alias("wrms"), F.avg("r").alias("mean"), F.median(F.abs("r")).alias("median_abs"))


def scan_means(rows: DataFrame) -> DataFrame:
    """(session, antenna, scan, mu, t_med, n): mean antenna-signed residual of every scan."""
    ends = F.explode(F.array(F.struct(F.col("a2").alias("antenna"), F.lit(1.0).alias("s")), F.struct(F.col("a1").alias("antenna"), F.lit(-1.0).alias("s")))).alias("e")
    e = rows.select("session", "scan", "t", "r", ends)
    return e.groupBy("session", "e.antenna", "scan").agg(F.avg(F.col("r") * F.col("e.s")).alias("mu"), F.median("t").alias("t_med"), F.count("*").alias("n"))


def wander(means: DataFrame) -> DataFrame:
    """(session, antenna, n_scans, scan_rms, scan_step): rms of the scan means and of their steps over root two."""
    o = Window.partitionBy("session", "antenna").orderBy("scan")
    d = F.col("mu") - F.lag("mu").over(o)
    return means.withColumn("d", d).groupBy("session", "antenna").agg(F.count("*").alias("n_scans"), F.sqrt(F.avg(F.col("mu") ** 2)).alias("scan_rms"), F.sqrt(F.avg(F.col("d") ** 2) / 2).alias("scan_step"))


def spectra(means: DataFrame, periods_h: list[float]) -> DataFrame:
    """(session, antenna, period_h, amplitude): least-squares sinusoid of every trial period on the scan means about their
    mean; antennas with fewer than four scans have none (A20). Periods are a literal list, so nothing is joined."""
    w = Window.partitionBy("session", "antenna")
    m = means.withColumn("y", F.col("mu") - F.avg("mu").over(w)).withColumn("k", F.count("*").over(w)).where("k >= 4")
    p = F.explode(F.array(*[F.lit(float(x)) for x in periods_h])).alias("period_h")
    m = m.select("session", "antenna", "y", (F.col("t_med") / 3600).alias("h"), p).withColumn("arg", F.col("h") * TWO_PI / F.col("period_h"))
    c, s = F.cos("arg"), F.sin("arg")
    g = m.groupBy("session", "antenna", "period_h").agg(F.sum(c * c).alias("cc"), F.sum(s * s).alias("ss"), F.sum(c * s).alias("cs"), F.sum(c * F.col("y")).alias("cy"), F.sum(s * F.col("y")).alias("sy"))
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    a, b = F.try_divide(F.col("cy") * F.col("ss") - F.col("sy") * F.col("cs"), det), F.try_divide(F.col("sy") * F.col("cc") - F.col("cy") * F.col("cs"), det)
    return g.select("session", "antenna", "period_h", F.hypot(a, b).alias("amplitude"))


def delay_triangles(obs: DataFrame) -> DataFrame:
    """(session, scan, source, slot, a, b, c, closure, thermal, min_snr) of delays that close.

    obs: session, scan, source, slot, a1, a2, delay, sigma, snr, obs_id. Of repeated rows of a baseline the last by obs_id
    counts; a baseline against its order counts with its sign turned.
    """
    g = ["session", "scan", "source", "slot"]
    flip = F.col("a1") > F.col("a2")
    e = obs.where(F.col("a1") != F.col("a2")).select(*g, F.least("a1", "a2").alias("p"), F.greatest("a1", "a2").alias("q"), F.struct("obs_id", F.when(flip, -F.col("delay")).otherwise(F.col("delay")).alias("d"), "sigma", "snr").alias("e"))
    e = e.groupBy(*g, "p", "q").agg(F.max("e").alias("e"))
    side = lambda n, x, y: e.select(*g, F.col("p").alias(x), F.col("q").alias(y), F.col("e.d").alias(f"d{n}"), F.col("e.sigma").alias(f"s{n}"), F.col("e.snr").alias(f"n{n}"))
    j = side(1, "a", "b").join(side(2, "b", "c"), [*g, "b"]).join(side(3, "a", "c"), [*g, "a", "c"])
    return j.select(*g, "a", "b", "c", (F.col("d1") + F.col("d2") - F.col("d3")).alias("closure"), F.sqrt(F.col("s1") ** 2 + F.col("s2") ** 2 + F.col("s3") ** 2).alias("thermal"), F.least("n1", "n2", "n3").alias("min_snr"))


def closure_floor(triangles: DataFrame, bins: tuple = CLOSURE_BINS) -> DataFrame:
    """(bin, n, sigma, thermal, excess): scatter above thermal over root three, by the weakest leg's SNR."""
    out = F.lit(None).cast("int")
    for k, (a, b) in enumerate(bins):
        out = F.when((F.col("min_snr") >= a) & (F.col("min_snr") < b), k).otherwise(out)
    t = triangles.withColumn("bin", out).where(F.col("bin").isNotNull())
    s = robust_sigma(t, ["bin"], "closure").join(t.groupBy("bin").agg(F.median("thermal").alias("thermal")), "bin")
    return s.select("bin", "n", "sigma", "thermal", (F.sqrt(F.greatest(F.col("sigma") ** 2 - F.col("thermal") ** 2, F.lit(0.0))) / math.sqrt(3)).alias("excess"))


def window_structure(rows: DataFrame, snr_gate: float) -> DataFrame:
    """(n_groups, static_rms, var_rms, var_mad): per-window delays about their row's mean, about their group's mean.

    rows: row_key, group, fcell, delay, snr; a row counts if all its windows are finite and at the gate; groups of fewer
    than three rows are left out.
    """
    w = Window.partitionBy("row_key")
    ok = F.min(F.when(F.coalesce(~F.isnan("delay") & (F.col("snr") >= snr_gate), F.lit(False)), 1).otherwise(0)).over(w)
    d = rows.withColumn("ok", ok).where("ok = 1").withColumn("d", F.col("delay") - F.avg("delay").over(w))
    g = Window.partitionBy("group", "fcell")
    v = d.withColumn("m", F.avg("d").over(g)).withColumn("n", F.count("*").over(g)).where("n >= 3")
    # One row per group first; the group's mean counts once, its deviations all.
    v = v.withColumn("first", F.row_number().over(g.orderBy("row_key")) == 1)
    d = F.col("d") - F.col("m")
    return v.agg(F.count_if("first").alias("n_groups"), F.sqrt(F.avg(F.when(F.col("first"), F.col("m") ** 2))).alias("static_rms"), F.sqrt(F.avg(d * d)).alias("var_rms"), (1.4826 * F.median(F.abs(d))).alias("var_mad"))


def match_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join of two observable tables on (session, scan, a1, a2, slot); unmatched rows are left out."""
    key = ["session", "scan", "a1", "a2", "slot"]
    return a.select(*key, F.col("r").alias("r_a")).join(b.select(*key, F.col("r").alias("r_b")), key)


def compare_positions(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, mean_ra, mean_dec, rms_ra, rms_dec, worst) over the sources of both tables."""
    j = a.alias("a").join(b.alias("b"), "source").select("source", (F.col("a.ra") - F.col("b.ra")).alias("dra"), (F.col("a.dec") - F.col("b.dec")).alias("ddec"))
    return j.agg(F.count("*").alias("n"), F.avg("dra").alias("mean_ra"), F.avg("ddec").alias("mean_dec"), F.sqrt(F.avg(F.col("dra") ** 2)).alias("rms_ra"), F.sqrt(F.avg(F.col("ddec") ** 2)).alias("rms_dec"), F.max(F.hypot("dra", "ddec")).alias("worst"))


def epoch_consistency(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row about two observable tables of shifted epochs (A21): median, robust sigma and number of correlator minus model
    plus clock in the first, the largest change of correlator minus model between the two (which must be small) and that of the
    correlator's delay alone (which must not). a, b: obs_id, tau_correlator, tau_model, tau_clock (s)."""
    number = lambda *c: reduce(and_, [F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)) for x in c])
    j = a.select("obs_id", F.col("tau_correlator").alias("ca"), F.col("tau_model").alias("ma"), F.col("tau_clock").alias("ka")).join(b.select("obs_id", F.col("tau_correlator").alias("cb"), F.col("tau_model").alias("mb")), "obs_id")
    x = F.when(number(F.col("ca"), F.col("ma"), F.col("ka")), F.col("ca") - F.col("ma") + F.col("ka"))
    d = j.select("*", x.alias("x"), F.lit(1).alias("one"))
    s = robust_sigma(d.where("x IS NOT NULL"), ["one"], "x").select("one", "median", "sigma", "n")
    both = F.when(number(F.col("ca"), F.col("cb"), F.col("ma"), F.col("mb")), F.abs((F.col("cb") - F.col("mb")) - (F.col("ca") - F.col("ma"))))
    alone = F.when(number(F.col("ca"), F.col("cb")), F.abs(F.col("cb") - F.col("ca")))
    m = d.groupBy("one").agg(F.max(both).alias("consistent_max"), F.max(alone).alias("correlator_max"), F.count("*").alias("n_rows"))
    return m.join(s, "one", "left").select("median", "sigma", F.coalesce("n", F.lit(0)).alias("n"), "consistent_max", "correlator_max", "n_rows")


def splits(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds early (t below the median), odd (odd rank of the scan) per group."""
    med = rows.groupBy(*by).agg(F.median("t").alias("t_mid"))
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy("scan"))
    return rows.join(med, by).withColumn("early", F.col("t") < F.col("t_mid")).withColumn("odd", rank % 2 == 1).drop("t_mid")


def unwrapped(rows: DataFrame, by: list[str], order: str, phase: str) -> DataFrame:
    """Adds turns: the phase continued over its wraps along the order."""
    o = Window.partitionBy(*by).orderBy(order)
    step = wrap(F.col(phase) - F.lag(phase).over(o))
    first = F.first(phase).over(o.rowsBetween(Window.unboundedPreceding, 0))
    s = rows.withColumn("__step", F.coalesce(step, F.lit(0.0)))
    return s.withColumn("unwrapped", first + F.sum("__step").over(o.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def excursion(rows: DataFrame, by: list[str], order: str, x: str) -> DataFrame:
    """(by, peak, low, high): the order value of the largest |x| of every group (the first of equals), and the first and last
    of the run around it that stays at half of it or above (W8). Groups without a number have no row."""
    some = rows.where(F.col(x).isNotNull() & ~F.isnan(x)).select(*by, F.col(order).alias("__o"), F.abs(F.col(x)).alias("__a"))
    w = Window.partitionBy(*by).orderBy("__o")
    top = some.groupBy(*by).agg(F.max(F.struct("__a", (-F.col("__o")).alias("__n"))).alias("__m")).select(*by, F.col("__m.__a").alias("__most"), (-F.col("__m.__n")).alias("peak"))
    near = some.join(top, by).withColumn("__weak", F.col("__a") < F.col("__most") / 2).withColumn("__before", F.lag("__o").over(w)).withColumn("__after", F.lead("__o").over(w))
    # The weak row next to the run on either side; its neighbour towards the peak is the run's end.
    side = lambda on, far: F.when(F.col("__weak") & on, F.struct("__o", far))
    g = near.groupBy(*by, "peak").agg(F.max(side(F.col("__o") < F.col("peak"), "__after")).alias("__l"), F.min(side(F.col("__o") > F.col("peak"), "__before")).alias("__h"), F.min("__o").alias("__first"), F.max("__o").alias("__last"))
    return g.select(*by, "peak", F.coalesce("__l.__after", "__first").alias("low"), F.coalesce("__h.__before", "__last").alias("high"))


def slope(rows: DataFrame, by: list[str], x: str, y: str, w: str) -> DataFrame:
    """(by, slope, n): weighted least squares with a free intercept; NULL if the abscissae are one to within rounding."""
    s = lambda e: F.sum(F.col(w) * e)
    g = rows.groupBy(*by).agg(F.sum(w).alias("sw"), s(F.col(x)).alias("sx"), s(F.col(x) ** 2).alias("sxx"), s(F.col(y)).alias("sy"), s(F.col(x) * F.col(y)).alias("sxy"), F.count("*").alias("n"))
    den = F.col("sw") * F.col("sxx") - F.col("sx") ** 2
    return g.select(*by, F.when(den > 1e-12 * F.col("sw") * F.col("sxx"), (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / den).alias("slope"), "n")


def identifiability(rows: DataFrame, step: float) -> DataFrame:
    """(session, n_cells, n_min, n_median, n_max, n_stubs): distinct sources per fixed cell; cells covered less than half are
    stubs (A26, D16, G13). rows: session, t, source."""
    t0 = rows.groupBy("session").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    n = F.greatest(F.ceil((F.col("t1") - F.col("t0")) / step), F.lit(1))
    c = rows.join(t0, "session").withColumn("cell", F.least(F.floor((F.col("t") - F.col("t0")) / step) + 1, n))
    cells = c.groupBy("session", "cell").agg(F.countDistinct("source").alias("k"), (F.max("t") - F.min("t")).alias("span"))
    full = F.when(F.col("span") >= 0.5 * step, F.col("k"))
    return cells.groupBy("session").agg(F.count(full).alias("n_cells"), F.min(full).alias("n_min"), F.median(full).alias("n_median"), F.max(full).alias("n_max"), F.count_if(F.col("span") < 0.5 * step).alias("n_stubs"))


def jet_geometry(components: DataFrame) -> DataFrame:
    """(source, pa_deg, radius): flux-weighted centre of all but the brightest component, seen from it (A28). Sources of one
    component, or whose rest sums to zero, have NULLs. components: source, flux, x, y."""
    core = components.groupBy("source").agg(F.max_by(F.struct("flux", "x", "y"), F.struct("flux", -F.col("x"), -F.col("y"))).alias("c"), F.count("*").alias("n"))
    j = components.join(core, "source")
    rest = ~((F.col("flux") == F.col("c.flux")) & (F.col("x") == F.col("c.x")) & (F.col("y") == F.col("c.y")))
    w = F.when(rest, F.col("flux"))
    g = j.groupBy("source").agg(F.sum(w).alias("sw"), F.sum(w * (F.col("x") - F.col("c.x"))).alias("sx"), F.sum(w * (F.col("y") - F.col("c.y"))).alias("sy"))
    cx, cy = F.try_divide("sx", "sw"), F.try_divide("sy", "sw")
    return g.select("source", F.degrees(F.atan2(cx, cy)).alias("pa_deg"), F.hypot(cx, cy).alias("radius"))


def structure_moment(components: DataFrame, rmax: float) -> DataFrame:
    """(source, pa_deg, radius, flux, n): the same over positive components within rmax of the strongest."""
    core = components.groupBy("source").agg(F.max_by(F.struct("x", "y"), F.struct(F.abs("flux"), -F.col("x"), -F.col("y"))).alias("c"))
    j = components.join(core, "source").withColumn("dx", F.col("x") - F.col("c.x")).withColumn("dy", F.col("y") - F.col("c.y"))
    d = F.hypot("dx", "dy")
    near = (d > 0) & (d <= rmax) & (F.col("flux") > 0)
    w = F.when(near, F.col("flux"))
    g = j.groupBy("source").agg(F.sum(w).alias("f"), F.sum(w * F.col("dx")).alias("sx"), F.sum(w * F.col("dy")).alias("sy"), F.count(w).alias("n"))
    cx, cy = F.try_divide("sx", "f"), F.try_divide("sy", "f")
    return g.select("source", F.degrees(F.atan2(cx, cy)).alias("pa_deg"), F.hypot(cx, cy).alias("radius"), F.coalesce("f", F.lit(0.0)).alias("flux"), "n")


def nu_eff(channels: DataFrame) -> DataFrame:
    """One row: sqrt(-var(nu) / cov(nu, 1/nu)), the frequency of a group delay's dispersion."""
    return channels.agg(F.sqrt(-F.var_pop("nu") / F.covar_pop("nu", 1 / F.col("nu"))).alias("nu_eff"))


def decimate(points: DataFrame, region: dict[str, tuple[float, float]], bins: int) -> DataFrame:
    """First point (by idx) of every occupied bin of the grid inside the region."""
    cells, inside = [], F.lit(True)
    for k, (c, (a, b)) in enumerate(region.items()):
        inside = inside & F.coalesce((F.col(c) >= a) & (F.col(c) <= b), F.lit(False))
        cells.append(F.least(F.floor((F.col(c) - a) / (b - a) * bins), F.lit(bins - 1)).alias(f"__b{k}"))
    p = points.where(inside).select("*", *cells)
    keys = [f"__b{k}" for k in range(len(region))]
    return p.groupBy(*keys).agg(F.min_by(F.struct(*points.columns), "idx").alias("x")).select("x.*")
