"""Stokes-I data, noise scale, imaging weights, beam and closure statistics.

Closures bring the edges of one (source, t, chan) group into one row, reduced to what the statistic needs (phase, log
amplitude, 1/SNR^2); triangles and quadrangles are formed inside the row, vectorised over all subsets of antennas.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vislake.functions.complexmath import TWO_PI, Complex, present, wrap
from vislake.operators.average import C_LIGHT, MAS
from vislake.session import small, stored

#: Sign of the correlator's baseline vector against the image plane.
UV_SIGN = -1.0


def uv_mas(metres: Column, nu: Column) -> Column:
    """uv coordinate in inverse milliarcseconds."""
    return metres * nu * (UV_SIGN * MAS / C_LIGHT)


def stokes_i(vis: DataFrame) -> DataFrame:
    """(row_id, source, p, q, scan, t, chan, u, v, re, im, w): half sum of the diagonal products, or the one present.

    Rows without a present diagonal product are dropped; a present product with a non-finite value is an error.
    """
    diag = vis.where((F.col("i") == F.col("j")) & present(F.col("w")))
    bad = F.isnan("re") | F.isnan("im") | F.col("re").isNull() | F.col("im").isNull()
    checked = diag.withColumn("re", F.when(bad, F.raise_error(F.lit("non-finite visibility with positive weight"))).otherwise(F.col("re")))
    of = lambda k, c: F.max(F.when(F.col("i") == k, F.col(c)))
    g = checked.groupBy("row_id", "source", "p", "q", "scan", "t", "chan", "nu").agg(of(1, "re").alias("r1"), of(1, "im").alias("i1"), of(1, "w").alias("w1"), of(2, "re").alias("r2"), of(2, "im").alias("i2"), of(2, "w").alias("w2"), F.min("u").alias("um"), F.min("v").alias("vm"))
    both = F.col("w1").isNotNull() & F.col("w2").isNotNull()
    pick = lambda a, b: F.when(both, (F.col(a) + F.col(b)) / 2).otherwise(F.coalesce(a, b))
    w = F.when(both, 4 * F.col("w1") * F.col("w2") / (F.col("w1") + F.col("w2"))).otherwise(F.coalesce("w1", "w2"))
    return g.select("row_id", "source", "p", "q", "scan", "t", "chan", uv_mas(F.col("um"), F.col("nu")).alias("u"), uv_mas(F.col("vm"), F.col("nu")).alias("v"), pick("r1", "r2").alias("re"), pick("i1", "i2").alias("im"), w.alias("w"))


def model_visibility(components: Column, u: Column, v: Column) -> Complex:
    """Sum of flux * cis(2 pi (u x + v y)) over an array of (flux, x, y) structs."""
    arg = lambda c: (u * c["x"] + v * c["y"]) * TWO_PI
    add = lambda f: F.aggregate(components, F.lit(0.0), lambda acc, c: acc + c["flux"] * f(arg(c)))
    return Complex(add(F.cos), add(F.sin))


def with_models(stokes: DataFrame, models: DataFrame) -> DataFrame:
    """Visibilities with the models of their source (source, components, ...): broadcast if a count proves the components to be
    few, else both sides are shuffled. Visibilities are never broadcast; Spark takes rows that an explode made for far fewer."""
    few = small(models.select(F.explode_outer("components")))
    return stokes.join(F.broadcast(models) if few else models.hint("merge"), "source")


def divide_model(vis: DataFrame, models: DataFrame, floor: float) -> DataFrame:
    """V / M and w |M|^2; below floor times the total flux the weight is 0 and the value stays (P10).

    vis: source, u, v, re, im, w; models: source, components. A source without a model (or with an empty one) is an error.
    """
    both = vis.join(models, "source", "left")
    m = model_visibility(F.col("components"), F.col("u"), F.col("v"))
    both = both.withColumn("__mr", m.re).withColumn("__mi", m.im)
    z = Complex(F.col("__mr"), F.col("__mi"))
    total = F.aggregate("components", F.lit(0.0), lambda acc, c: acc + F.abs(c["flux"]))
    weak = z.abs() < total * floor
    d = Complex(F.col("re"), F.col("im")) / z
    ok = F.when(F.coalesce(F.size("components"), F.lit(0)) > 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no model for source "), F.col("source").cast("string"))))
    out = {"re": F.when(weak, F.col("re")).otherwise(d.re), "im": F.when(weak, F.col("im")).otherwise(d.im), "w": F.when(weak, 0.0).otherwise(F.col("w") * z.abs2())}
    return both.where(ok).select(*[out.get(c, F.col(c)).alias(c) for c in vis.columns])


def significant(components: DataFrame, rms: float, nsigma: float) -> DataFrame:
    """Components of at least nsigma times rms."""
    return components.where(F.abs("flux") >= nsigma * rms)


def noise_series(stokes: DataFrame) -> DataFrame:
    """(source, p, q, chan, scan, k): 1/(sigma^2 mean w) of every series with three samples, from second differences."""
    order = Window.partitionBy("source", "p", "q", "chan", "scan").orderBy("t", "row_id")
    d = lambda c: F.lag(c, 2).over(order) - 2 * F.lag(c, 1).over(order) + F.col(c)
    s = stokes.withColumn("dr", d("re")).withColumn("di", d("im"))
    g = s.groupBy("source", "p", "q", "chan", "scan").agg(F.sum(F.col("dr") * F.col("dr") + F.col("di") * F.col("di")).alias("sd"), F.count("dr").alias("n"), F.avg("w").alias("mw"))
    return g.where((F.col("n") > 0) & (F.col("sd") > 0) & (F.col("mw") > 0)).select("source", "p", "q", "chan", "scan", (6 * F.col("n") / (F.col("sd") * F.col("mw"))).alias("k"))


def noise_scale(stokes: DataFrame) -> DataFrame:
    """One row: the median over series; no series is an error of the caller (NULL here)."""
    series = stored(noise_series(stokes).select("k"))
    k, n = exact_median(series, "k")
    return stokes.sparkSession.createDataFrame([(k, n)], "k double, n_series bigint")


def exact_median(rows: DataFrame, column: str, at_once: int = 100_000) -> tuple[float | None, int]:
    """(median, number of values) of a stored column: counted bounds close in on the middle until so few values are left
    between them that one task can sort them."""
    n = rows.where(F.col(column).isNotNull()).count()
    if not n:
        return None, 0
    low, high, below, inside = None, None, 0, n
    ranks = ((n - 1) // 2, n // 2)
    middle = rows.where(F.col(column).isNotNull())
    while inside > at_once:
        got = middle.select(F.percentile_approx(column, [max(0.0, (ranks[0] - below) / inside - 0.01), min(1.0, (ranks[1] - below) / inside + 0.01)], 1000).alias("q")).first()["q"]
        if (low, high) == tuple(got):
            break  # a run of ties
        low, high = got
        below = rows.where(F.col(column) < low).count()
        middle = rows.where(F.col(column).between(low, high))
        inside = middle.count()
        if below > ranks[0] or below + inside <= ranks[1]:
            raise ValueError("bounds of the median missed it")
    if low is not None and low == high:
        return float(low), n
    at = middle.orderBy(column).limit(ranks[1] - below + 1).agg(F.sort_array(F.collect_list(column)).alias("v")).first()["v"] if inside <= at_once else [low]
    return float((at[ranks[0] - below] + at[ranks[1] - below]) / 2) if inside <= at_once else float(low), n


def map_sigma(stokes: DataFrame, weight_scale: float) -> DataFrame:
    """Noise of a pixel of the dirty map per source (A9). wt: imaging weights; w: natural weights."""
    s = stokes.where(F.col("wt") != 0)
    return s.groupBy("source").agg((F.sqrt(F.sum(F.col("wt") * F.col("wt") / F.col("w")) / (2 * weight_scale)) / F.sum("wt")).alias("sigma"))


def uniform_weights(stokes: DataFrame, npix: int, pixel: float) -> DataFrame:
    """Adds wt: the weight over the total weight of its uv cell (A10). Sums are pre-aggregated per cell and joined back."""
    cell = lambda c: F.rint(F.col(c) * (npix * pixel)).cast("bigint")
    s = stokes.withColumn("cu", cell("u")).withColumn("cv", cell("v"))
    dens = s.groupBy("source", "cu", "cv").agg(F.sum("w").alias("dens"))
    return s.join(dens, ["source", "cu", "cv"]).withColumn("wt", F.col("w") / F.col("dens")).drop("cu", "cv", "dens")


def fit_beam(stokes: DataFrame) -> DataFrame:
    """(source, sigma_major, ratio, pa) of the restoring beam from weighted second moments (A11); a coverage that is a
    point or a line has NULLs."""
    m = lambda a, b: F.sum(F.col("w") * F.col(a) * F.col(b)) / F.sum("w")
    g = stokes.groupBy("source").agg(m("u", "u").alias("uu"), m("v", "v").alias("vv"), m("u", "v").alias("uv"))
    k = 4 * math.pi**2
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    ok = (F.col("uu") > 0) & (F.col("vv") > 0) & (det > 0)
    d = F.when(ok, det * k)
    a, b, c = F.col("vv") / d, -F.col("uv") / d, F.col("uu") / d
    half, root = (a + c) / 2, F.sqrt((a - c) * (a - c) / 4 + b * b)
    major, minor = half + root, half - root
    # Eigenvector of the larger value; for a diagonal matrix the axis itself.
    ex = F.when(b != 0, b).when(a >= c, 1.0).otherwise(0.0)
    ey = F.when(b != 0, major - a).when(a >= c, 0.0).otherwise(1.0)
    pa = F.atan2(ex, ey)
    # A line has no direction: position angle in (-pi/2, pi/2].
    pa = pa - math.pi * F.ceil(pa / math.pi - 0.5)
    return g.select("source", F.sqrt(major).alias("sigma_major"), F.sqrt(minor / major).alias("ratio"), pa.alias("pa"))


def edges(stokes: DataFrame, weight_scale: float) -> DataFrame:
    """One edge per (source, t, chan, p < q): phase, log amplitude, 1/SNR^2 of data and model. Of several rows of one
    baseline the last by row_id counts. model_re, model_im are optional (a point source otherwise)."""
    flip = F.when(F.col("p") <= F.col("q"), 1.0).otherwise(-1.0)
    amp = F.hypot("re", "im")
    snr2 = amp * amp * F.col("w") * weight_scale
    has = "model_re" in stokes.columns
    m_phase = F.atan2(F.col("model_im") * flip, F.col("model_re")) if has else F.lit(0.0)
    m_amp = F.hypot("model_re", "model_im") if has else F.lit(1.0)
    e = stokes.where(present(F.col("w"))).select("source", "t", "chan", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "row_id", F.struct(F.atan2(F.col("im") * flip, F.col("re")).alias("phase"), F.ln(F.when(amp > 0, amp)).alias("lna"), F.when(snr2 > 0, 1 / snr2).alias("isnr2"), m_phase.alias("m_phase"), F.ln(F.when(m_amp > 0, m_amp)).alias("m_lna")).alias("e"))
    return e.groupBy("source", "t", "chan", "p", "q").agg(F.max_by("e", F.struct("row_id", "e")).alias("e")).select("source", "t", "chan", "p", "q", "e.*")


#: Columns of an edge that the kernels take.
_EDGE = ("phase", "isnr2", "m_phase", "lna", "m_lna")
_GROUP = ["source", "t", "chan"]


def _closed(e: DataFrame, kernel: Callable[[np.ndarray, dict[str, np.ndarray]], Iterator[dict[str, np.ndarray]]], fields: dict[str, str]) -> DataFrame:
    """Run a kernel on the edges of every (source, t, chan): one exchange brings a group's edges into one row (bounded by the
    number of antennas), and closures are formed inside it, without joins.

    The kernel gets the sorted antennas and a square matrix per column (NaN where there is no edge, antisymmetric or
    symmetric completion is not needed: only p < q is read) and yields columns of results.
    """
    schema = e.select(*_GROUP).schema
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    rows = e.groupBy(*_GROUP).agg(F.collect_list(F.struct("p", "q", *_EDGE)).alias("e"))
    types = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("e")
            offsets = lists.offsets.to_numpy()
            flat = {c: lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("p", "q", *_EDGE)}
            names, held, size = [*_GROUP, *fields], [], 0

            def flush() -> pa.RecordBatch:
                at = np.concatenate([np.full(len(next(iter(x.values()))), i) for i, x in held])
                columns = [batch.column(c).take(pa.array(at)) for c in _GROUP] + [pa.array(np.concatenate([x[c] for _, x in held]), types[t]) for c, t in fields.items()]
                return pa.RecordBatch.from_arrays(columns, names=names)

            for i in range(batch.num_rows):
                span = slice(offsets[i], offsets[i + 1])
                ants, place = np.unique(np.concatenate([flat["p"][span], flat["q"][span]]), return_inverse=True)
                half = len(place) // 2
                full = {}
                for c in _EDGE:
                    full[c] = np.full((len(ants), len(ants)), np.nan)
                    full[c][place[:half], place[half:]] = flat[c][span].astype(float)
                for x in kernel(ants, full):
                    size += len(next(iter(x.values())))
                    held.append((i, x))
                    if size > 100_000:
                        yield flush()
                        held, size = [], 0
            if held:
                yield flush()

    return rows.mapInArrow(run, head + ", " + ", ".join(f"{c} {t}" for c, t in fields.items()))


def _wrapped(x: np.ndarray) -> np.ndarray:
    return x - TWO_PI * np.rint(x / TWO_PI)


@cache
def _subsets(n: int, k: int) -> tuple[np.ndarray, ...]:
    """All ascending k-subsets of range(n), as k arrays."""
    return tuple(np.array(x, np.int32) for x in zip(*combinations(range(n), k))) if n >= k else tuple(np.array([], np.int32) for _ in range(k))


def _triangles(m: dict[str, np.ndarray]) -> Iterator[tuple]:
    """(a, b, c, phase, model, var) of the closed triangles, one first antenna at a time."""
    n = len(m["phase"])
    for a in range(n - 2):
        b, c = (x + a + 1 for x in _subsets(n - a - 1, 2))
        close = lambda v: v[a, b] + v[b, c] - v[a, c]
        var = m["isnr2"][a, b] + m["isnr2"][b, c] + m["isnr2"][a, c]
        ok = ~np.isnan(var)
        if ok.any():
            yield np.full(ok.sum(), a), b[ok], c[ok], _wrapped(close(m["phase"])[ok]), _wrapped(close(m["m_phase"])[ok]), var[ok]


def triangles(e: DataFrame) -> DataFrame:
    """(source, t, chan, a, b, c, phase, model, var) of every closed triangle a < b < c."""

    def kernel(ants: np.ndarray, m: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        for a, b, c, phase, model, var in _triangles(m):
            yield {"a": ants[a], "b": ants[b], "c": ants[c], "phase": phase, "model": model, "var": var}

    return _closed(e, kernel, {"a": "int", "b": "int", "c": "int", "phase": "double", "model": "double", "var": "double"})


def closure_chi2(e: DataFrame, by: list[str]) -> DataFrame:
    """(by, chi2, n): mean of squared closure phase residuals over their variance (A12, A14). by: of source, t, chan, whose
    groups add up their sums, so that no closure leaves its group; other columns of triangles() work on the rows."""
    if not set(by) <= set(_GROUP):
        d = wrap(F.col("phase") - F.col("model"))
        return triangles(e).groupBy(*by).agg(F.avg(d * d / F.col("var")).alias("chi2"), F.count("*").alias("n"))

    def kernel(ants: np.ndarray, m: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        total, n = 0.0, 0
        for *_, phase, model, var in _triangles(m):
            d = _wrapped(phase - model)
            total, n = total + (d * d / var).sum(), n + len(d)
        if n:
            yield {"s": np.array([total]), "n": np.array([n])}

    sums = _closed(e, kernel, {"s": "double", "n": "bigint"})
    return sums.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("chi2"), F.sum("n").alias("n"))


#: Pairings of four antennas: the edges above and below the line.
_PAIRINGS = (("abcd/acbd", "ab", "cd", "ac", "bd"), ("abcd/adbc", "ab", "cd", "ad", "bc"), ("acbd/adbc", "ac", "bd", "ad", "bc"))


def _quadrangles(m: dict[str, np.ndarray], min_snr: float) -> Iterator[tuple]:
    """(pairing, a, b, c, d, residual, var), one first antenna at a time."""
    x, v = m["lna"] - m["m_lna"], np.where(m["isnr2"] <= 1 / min_snr**2, m["isnr2"], np.nan)
    x = np.where(np.isnan(v) | np.isnan(m["m_lna"]), np.nan, x)
    n = len(x)
    for a in range(n - 3):
        b, c, d = (y + a + 1 for y in _subsets(n - a - 1, 3))
        at = {"ab": (a, b), "cd": (c, d), "ac": (a, c), "bd": (b, d), "ad": (a, d), "bc": (b, c)}
        for name, one, two, three, four in _PAIRINGS:
            residual = x[at[one]] + x[at[two]] - x[at[three]] - x[at[four]]
            ok = ~np.isnan(residual)
            if ok.any():
                var = v[at[one]] + v[at[two]] + v[at[three]] + v[at[four]]
                yield name, np.full(ok.sum(), a), b[ok], c[ok], d[ok], residual[ok], var[ok]


def quadrangles(e: DataFrame, min_snr: float) -> DataFrame:
    """(source, t, chan, a, b, c, d, pairing, residual, var): log closure amplitudes of all 4-subsets, three pairings each
    (J10). A pairing needs its own four edges only."""

    def kernel(ants: np.ndarray, m: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        for name, a, b, c, d, residual, var in _quadrangles(m, min_snr):
            yield {"a": ants[a], "b": ants[b], "c": ants[c], "d": ants[d], "pairing": np.full(len(a), name, object), "residual": residual, "var": var}

    return _closed(e, kernel, {"a": "int", "b": "int", "c": "int", "d": "int", "pairing": "string", "residual": "double", "var": "double"})


def closure_amp_chi2(e: DataFrame, min_snr: float, by: list[str]) -> DataFrame:
    """(by, chi2, rms, n) of log closure amplitudes (A13); by as in closure_chi2."""
    if not set(by) <= set(_GROUP):
        d = F.col("residual")
        return quadrangles(e, min_snr).groupBy(*by).agg(F.avg(d * d / F.col("var")).alias("chi2"), F.sqrt(F.avg(d * d)).alias("rms"), F.count("*").alias("n"))

    def kernel(ants: np.ndarray, m: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        scaled, plain, n = 0.0, 0.0, 0
        for *_, residual, var in _quadrangles(m, min_snr):
            d2 = residual * residual
            scaled, plain, n = scaled + (d2 / var).sum(), plain + d2.sum(), n + len(d2)
        if n:
            yield {"s": np.array([scaled]), "r": np.array([plain]), "n": np.array([n])}

    sums = _closed(e, kernel, {"s": "double", "r": "double", "n": "bigint"})
    return sums.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("chi2"), F.sqrt(F.sum("r") / F.sum("n")).alias("rms"), F.sum("n").alias("n"))
