"""Calibration from instrument records: phase-cal tones and system temperatures.

All of it is joins, group-bys and circular statistics on Columns; nothing leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vislake.functions.complexmath import TWO_PI, circular_mean, wrap

CABLE_MODES = ("both", "delay", "none")


def tone_medians(tones: DataFrame, node: list[str]) -> DataFrame:
    """Adds amp (of the tone) and amed (its node's median over all records). tones: node, band, tone, re, im."""
    amp = tones.withColumn("amp", F.hypot("re", "im"))
    med = amp.groupBy(*node, "band", "tone").agg(F.median("amp").alias("amed"))
    return amp.join(med, [*node, "band", "tone"])


def pcal_init(tones: DataFrame, node: list[str], cable_apply: str = "both", amplitude_floor: float = 0.3) -> DataFrame:
    """Delay and phase of every (node, tcell, band) from pairs of tones: node, tcell, band, delay, phase.

    tones: node columns, tcell, band, tone (1 or 2), freq, re, im, cable (seconds, NaN or NULL where there is none). Tones
    below amplitude_floor times their node's median are dropped, the rest are averaged coherently per cell. The delay is
    known up to 1/spacing: each series is taken about its circular mean, a turn of the delay moves the phase by pi, and
    the bands of a cell are put on one branch about their common circular mean. NaN and NULL tones are dropped.
    """
    if cable_apply not in CABLE_MODES:
        raise ValueError(f"cable_apply {cable_apply!r}; one of {CABLE_MODES}")
    good = F.coalesce(~F.isnan("re") & ~F.isnan("im"), F.lit(False))
    t = tone_medians(tones.where(good), node)
    t = t.where((F.col("amp") >= amplitude_floor * F.col("amed")) & F.col("tcell").isNotNull())
    cell = [*node, "tcell", "band"]
    of = lambda k, c: F.sum(F.when(F.col("tone") == k, F.col(c)))
    g = t.groupBy(*cell).agg(of(1, "re").alias("r1"), of(1, "im").alias("i1"), of(2, "re").alias("r2"), of(2, "im").alias("i2"), F.min(F.when(F.col("tone") == 1, F.col("freq"))).alias("f1"), F.min(F.when(F.col("tone") == 2, F.col("freq"))).alias("f2"), F.median(F.when(~F.isnan("cable"), F.col("cable"))).alias("cab"))
    g = g.where(F.col("r1").isNotNull() & F.col("r2").isNotNull() & (F.col("f2") > F.col("f1")))
    cab = F.coalesce("cab", F.lit(0.0))
    spacing = F.col("f2") - F.col("f1")
    a1 = F.atan2("i1", "r1")
    dphi = wrap(F.atan2("i2", "r2") - a1)
    tau = dphi / (TWO_PI * spacing) + (cab if cable_apply != "none" else 0.0)
    phi = wrap(a1 + dphi / 2 + (TWO_PI * (F.col("f1") + F.col("f2")) / 2 * cab if cable_apply == "both" else 0.0))
    s = g.select(*cell, (1 / spacing).alias("amb"), tau.alias("tau"), phi.alias("phi"))
    # Reference of each (node, band): circular means over its cells.
    ref = s.groupBy(*node, "band").agg((F.first("amb") / TWO_PI * circular_mean(F.col("tau") * TWO_PI / F.col("amb"))).alias("tau_ref"), circular_mean(F.col("phi")).alias("phi_ref"))
    d = s.join(ref, [*node, "band"])
    turns = F.rint((F.col("tau") - F.col("tau_ref")) / F.col("amb"))
    d = d.select(*cell, (F.col("tau") - F.col("tau_ref") - turns * F.col("amb")).alias("delay"), wrap(F.col("phi") - F.col("phi_ref") - turns * math.pi).alias("dphi"))
    one = Window.partitionBy(*node, "tcell")
    branch = F.atan2(F.sum(F.sin("dphi")).over(one), F.sum(F.cos("dphi")).over(one))
    d = d.withColumn("branch", branch)
    return d.select(*cell, "delay", (F.col("branch") + wrap(F.col("dphi") - F.col("branch"))).alias("phase"))


def tone_health(tones: DataFrame, node: list[str], floor: float) -> DataFrame:
    """(band, tone, healthy, worst): a tone is healthy if its median amplitude is at least floor times the band's median at
    every node (P15)."""
    med = tones.groupBy(*node, "band", "tone").agg(F.median(F.hypot("re", "im")).alias("m"))
    w = Window.partitionBy(*node, "band")
    ratio = F.try_divide(F.col("m"), F.median("m").over(w))
    return med.withColumn("ratio", ratio).groupBy("band", "tone").agg(F.bool_and(F.coalesce(F.col("ratio") >= floor, F.lit(False))).alias("healthy"), F.min("ratio").alias("worst"))


def pick_tones(health: DataFrame) -> DataFrame:
    """(band, low, high): the outermost healthy pair of tones that lies symmetrically in the comb, the innermost of equals
    excluded by construction (P15). No pair: no row."""
    n = F.max("tone").over(Window.partitionBy("band")) + F.min("tone").over(Window.partitionBy("band"))
    h = health.withColumn("mirror", n - F.col("tone"))
    a, b = h.where("healthy").alias("a"), h.where("healthy").alias("b")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.mirror") == F.col("b.tone")) & (F.col("a.tone") < F.col("b.tone")))
    return pairs.groupBy(F.col("a.band").alias("band")).agg(F.min("a.tone").alias("low"), F.max("b.tone").alias("high"))


def gain_curve_value(coefficients: Column, x_typ: Column, elevation: Column) -> Column:
    """Polynomial of elevation (x_typ 0) or zenith angle (1) in degrees; a value not above 0 or another type is NULL."""
    x = F.when(x_typ == 0, F.degrees(elevation)).when(x_typ == 1, 90 - F.degrees(elevation))
    g = F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: acc * x + c)
    return F.when(g > 0, g)


def tsys_init(readings: DataFrame, curves: DataFrame, wanted: DataFrame, node: list[str], quantization: float = 0.88, reference_sefd: float = 1.0) -> DataFrame:
    """Log amplitude of every wanted cell: node, tcell, tsys, sefd, a, fallback.

    readings: node, tcell, tsys (accepted ones only); curves: node, dpfu, gain (ascending coefficients), x_typ, one row per
    node; wanted: node, tcell, el (radians). A cell without a reading takes its node's session median (fallback true); a
    node without any, or without a usable curve, has NULLs.
    """
    by_cell = readings.where(F.col("tcell").isNotNull()).groupBy(*node, "tcell").agg(F.median("tsys").alias("cell_tsys"))
    by_node = readings.groupBy(*node).agg(F.median("tsys").alias("node_tsys"))
    j = wanted.join(by_cell, [*node, "tcell"], "left").join(by_node, node, "left").join(curves, node, "left")
    t = F.coalesce("cell_tsys", "node_tsys")
    g = F.col("dpfu") * gain_curve_value(F.col("gain"), F.col("x_typ"), F.col("el"))
    sefd = F.when(g > 0, t / g)
    a = 0.5 * (math.log(quantization) + math.log(reference_sefd)) - 0.5 * F.ln(sefd)
    return j.select(*node, "tcell", t.alias("tsys"), sefd.alias("sefd"), a.alias("a"), F.col("cell_tsys").isNull().alias("fallback"))


def fallback_share(cells: DataFrame, by: list[str]) -> DataFrame:
    """Share of cells that fell back, per antenna: the figure that the cap of C16 is held against."""
    return cells.groupBy(*by).agg(F.avg(F.col("fallback").cast("int")).alias("share"), F.count("*").alias("n_cells"))


def derive_alignment(nodes: DataFrame) -> DataFrame:
    """Static delay and phase of every (p, i, fcell) from solved per-window delays and phases.

    nodes: p, i, tcell, fcell, nu, delay, phase, anchored at the reference. Only (p, i, tcell) with all windows count. The
    mean delay and the band slope that goes with it are taken out per cell, the deviations are averaged over cells by
    median and circular mean, and each (p, i) is put to zero mean.
    """
    centre = nodes.select("fcell", "nu").distinct().agg(F.avg("nu").alias("nu_bar"), F.count("*").alias("n_all")).first()  # two numbers
    w = Window.partitionBy("p", "i", "tcell")
    n = nodes.withColumn("nu_bar", F.lit(centre["nu_bar"])).withColumn("n_here", F.count("*").over(w)).where(F.col("n_here") == F.lit(centre["n_all"]))
    return _deviations(n, ["p", "i"])


def derive_alignment_by_setup(nodes: DataFrame) -> DataFrame:
    """The same for each set of windows that an antenna was observed with (setup, their numbers), so every cell counts.

    Deviations from the mean of different sets are not comparable, so they are averaged apart. The only window of a set of
    one is its own mean: zero.
    """
    w = Window.partitionBy("p", "i", "tcell")
    n = nodes.withColumn("setup", F.array_join(F.sort_array(F.collect_set("fcell").over(w)), ",")).withColumn("nu_bar", F.avg("nu").over(w))
    return _deviations(n, ["p", "i", "setup"])


def _deviations(n: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy("p", "i", "tcell")
    n = n.withColumn("tau_bar", F.avg("delay").over(w))
    n = n.withColumn("chi", F.col("phase") - TWO_PI * (F.col("nu") - F.col("nu_bar")) * F.col("tau_bar"))
    n = n.withColumn("chi", F.col("chi") - F.atan2(F.sum(F.sin("chi")).over(w), F.sum(F.cos("chi")).over(w)))
    g = n.groupBy(*keys, "fcell").agg(F.median(F.col("delay") - F.col("tau_bar")).alias("delay"), circular_mean(F.col("chi")).alias("phase"), F.count("*").alias("nruns"))
    v = Window.partitionBy(*keys)
    return g.select(*keys, "fcell", (F.col("delay") - F.avg("delay").over(v)).alias("delay"), wrap(F.col("phase") - F.atan2(F.sum(F.sin("phase")).over(v), F.sum(F.cos("phase")).over(v))).alias("phase"), "nruns")


def alignment_summary(alignment: DataFrame, keys: tuple[str, ...] = ("p", "i")) -> DataFrame:
    """(keys, rms, peak_to_peak, d2_rms) of the wrapped phase over windows."""
    w = Window.partitionBy(*keys).orderBy("fcell")
    d2 = wrap(F.lag("phase", 1).over(w) - 2 * F.col("phase") + F.lead("phase", 1).over(w))
    return alignment.withColumn("d2", d2).groupBy(*keys).agg(F.sqrt(F.avg(F.col("phase") ** 2)).alias("rms"), (F.max("phase") - F.min("phase")).alias("peak_to_peak"), F.sqrt(F.avg(F.col("d2") * F.col("d2"))).alias("d2_rms"))
