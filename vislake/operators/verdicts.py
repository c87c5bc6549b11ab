"""Data-quality verdicts as rows: level, gate, subject, measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASS, WARN, FAIL = "pass", "warn", "fail"
COLUMNS = ["level", "gate", "subject", "measured"]


def verdicts(rows: DataFrame, gate: str, subject: Column, level: Column, measured: dict[str, Column]) -> DataFrame:
    """One verdict per row; measured is a map of numbers."""
    values = F.create_map(*[x for k, v in measured.items() for x in (F.lit(k), v.cast("double"))])
    return rows.select(level.alias("level"), F.lit(gate).alias("gate"), subject.cast("string").alias("subject"), values.alias("measured"))


def tone_verdicts(tones: DataFrame, node: list[str], floor: float, weak_pct: float = 5.0) -> DataFrame:
    """Share of tones below floor times their median, per node (D12). tones: node, band, tone, re, im."""
    a = tones.withColumn("amp", F.hypot("re", "im"))
    med = a.groupBy(*node, "band", "tone").agg(F.median("amp").alias("m"))
    j = a.join(med, [*node, "band", "tone"])
    g = j.groupBy(*node).agg(F.count("*").alias("n"), (100 * F.avg((F.col("amp") < floor * F.col("m")).cast("int"))).alias("weak_pct"), (100 * F.avg((F.col("amp") == 0).cast("int"))).alias("dead_pct"), F.median("amp").alias("median_amp"))
    return verdicts(g, "pcal-tone-health", F.concat_ws("|", *node), F.when(F.col("weak_pct") > weak_pct, WARN).otherwise(PASS), {"n": F.col("n"), "weak_pct": F.col("weak_pct"), "dead_pct": F.col("dead_pct"), "median_amp": F.col("median_amp")})


def cable_census(readings: DataFrame, node: list[str]) -> DataFrame:
    """(node, n, median, ptp, sigma, jumps, verdict) of cable readings in time order (D13). readings: node, t, row_id, cable."""
    good = readings.where(F.col("cable").isNotNull() & ~F.isnan("cable"))
    o = Window.partitionBy(*node).orderBy("t", "row_id")
    d = good.withColumn("d", F.col("cable") - F.lag("cable").over(o))
    med = d.groupBy(*node).agg(F.median("d").alias("dm"))
    d = d.join(med, node)
    sig = d.groupBy(*node).agg((1.4826 * F.median(F.abs(F.col("d") - F.col("dm")))).alias("sigma"))
    d = d.join(sig, node)
    jump = F.abs("d") > F.greatest(10 * F.col("sigma"), F.lit(100e-12))
    g = d.groupBy(*node).agg(F.count("*").alias("n"), F.median("cable").alias("median"), (F.max("cable") - F.min("cable")).alias("ptp"), F.first("sigma").alias("sigma"), F.count_if(jump).alias("jumps"), F.median(F.when(jump, F.abs("d"))).alias("typical"))
    v = F.when((F.col("ptp") == 0) | ((F.col("sigma") == 0) & (F.col("ptp") < 1e-15)), "dead constant").when((F.col("jumps") > 5) & (F.col("typical") > 0.5e-9), "wrap-like steps").when(F.col("jumps") > 0, "steps").otherwise("ok")
    return g.select(*node, "n", "median", "ptp", "sigma", "jumps", v.alias("verdict"))


def amplitude_census(readings: DataFrame, node: list[str], ceiling: str) -> DataFrame:
    """(node, n, n_absent, n_bad, n_high, median): sentinels and readings above the ceiling (D15). readings: node, tsys."""
    x = F.col("tsys")
    bad = F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")) | (x <= 0), F.lit(False))
    high = ~bad & F.coalesce(x > F.col(ceiling), F.lit(False))
    return readings.groupBy(*node).agg(F.count("*").alias("n"), F.count_if(x.isNull()).alias("n_absent"), F.count_if(bad).alias("n_bad"), F.count_if(high).alias("n_high"), F.median(F.when(~bad & ~high, x)).alias("median"))


def coverage(tables: DataFrame, expected: DataFrame) -> DataFrame:
    """Antennas with too few records, or none, in a table (D10, O9). tables: session, antenna, n; expected: session, antenna."""
    j = expected.join(tables, ["session", "antenna"], "left")
    return verdicts(j, "coverage", F.concat_ws("|", "session", "antenna"), F.when(F.col("n").isNull(), FAIL).when(F.col("n") < 3, WARN).otherwise(PASS), {"n": F.coalesce("n", F.lit(0))})


def identifiability_verdicts(census: DataFrame, normalize: str) -> DataFrame:
    """Whether every amplitude interval holds an ensemble of sources (D16): warn if one holds a single source under global
    normalisation (its gain is degenerate with that source's flux) or fewer than four otherwise. census: as of
    residuals.identifiability. Sessions without a full interval are warned about too."""
    n = F.col("n_min")
    level = F.when(n.isNull(), WARN).when(F.lit(normalize == "global") & (n < 2), WARN).when(n < 4, WARN).otherwise(PASS)
    return verdicts(census, "amp-identifiability", F.col("session"), level, {c: F.col(c) for c in ("n_cells", "n_min", "n_median", "n_max", "n_stubs")})


def fringe_census(obs: DataFrame, min_snr: float, delay_limit: float, rate_limit: float) -> DataFrame:
    """(session, n, detection, snr_median, delay_max, rate_max, level) of peaks (D17); maxima over detections."""
    det = F.col("snr") >= min_snr
    g = obs.groupBy("session").agg(F.count("*").alias("n"), F.avg(det.cast("int")).alias("detection"), F.median("snr").alias("snr_median"), F.max(F.when(det, F.abs("delay"))).alias("delay_max"), F.max(F.when(det, F.abs("rate"))).alias("rate_max"))
    ok = (F.col("detection") >= 0.9) & (F.col("delay_max") < 0.9 * delay_limit) & (F.col("rate_max") < 0.9 * rate_limit)
    return g.withColumn("level", F.when(F.coalesce(ok, F.lit(False)), PASS).otherwise(WARN))


def scan_verdicts(rows: DataFrame) -> DataFrame:
    """A scan of several sources fails (D11). rows: session, scan, source."""
    g = rows.groupBy("session", "scan").agg(F.countDistinct("source").alias("n_sources"), F.count("*").alias("n"))
    return verdicts(g, "scan-sources", F.concat_ws("|", "session", "scan"), F.when(F.col("n_sources") > 1, FAIL).otherwise(PASS), {"n_sources": F.col("n_sources"), "n": F.col("n")})


def gap_steps(series: DataFrame, node: list[str], min_gap: float, span: int, nsigma: float) -> DataFrame:
    """Steps of a series across its gaps (D14, W7): mean of up to `span` samples after a gap minus before it, in units of
    their scatter. series: node, t, x. A gap with fewer than two samples on a side is left out."""
    o = Window.partitionBy(*node).orderBy("t")
    isle = F.sum(F.when(F.col("t") - F.lag("t").over(o) > min_gap, 1).otherwise(0)).over(o.rowsBetween(Window.unboundedPreceding, 0))
    s = series.withColumn("isle", isle)
    i = Window.partitionBy(*node, "isle")
    s = s.withColumn("head", F.row_number().over(i.orderBy("t"))).withColumn("tail", F.row_number().over(i.orderBy(F.desc("t"))))
    of = lambda k, f: f(F.when(F.col(k) <= span, F.col("x")))
    g = s.groupBy(*node, "isle").agg(of("head", F.avg).alias("m_head"), of("head", F.var_samp).alias("v_head"), of("head", F.count).alias("n_head"), of("tail", F.avg).alias("m_tail"), of("tail", F.var_samp).alias("v_tail"), of("tail", F.count).alias("n_tail"), F.min("t").alias("t_from"))
    b = Window.partitionBy(*node).orderBy("isle")
    g = g.select(*node, "t_from", "m_head", "v_head", "n_head", F.lag("m_tail").over(b).alias("m0"), F.lag("v_tail").over(b).alias("v0"), F.lag("n_tail").over(b).alias("n0")).where((F.col("n0") >= 2) & (F.col("n_head") >= 2))
    sigma = F.sqrt(F.col("v_head") / F.col("n_head") + F.col("v0") / F.col("n0"))
    step = F.col("m_head") - F.col("m0")
    return g.select(*node, "t_from", step.alias("step"), sigma.alias("sigma"), F.coalesce(F.abs(step) > nsigma * sigma, F.lit(False)).alias("broken"))


def summary(all_verdicts: DataFrame) -> DataFrame:
    """(gate, n_pass, n_warn, n_fail)."""
    of = lambda level: F.count_if(F.col("level") == level)
    return all_verdicts.groupBy("gate").agg(of(PASS).alias("n_pass"), of(WARN).alias("n_warn"), of(FAIL).alias("n_fail"))
