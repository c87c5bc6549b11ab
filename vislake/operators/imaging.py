"""Imaging of every source in parallel.

A source's visibilities are first summed per uv cell of a fine grid (re, im, w), so the kernel of one source gets a bounded
table however many rows the source has; with uv_cell None the rows go in as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vislake.functions.complexmath import TWO_PI, present
from vislake.functions.imagemath import FWHM, Grid, beam_moments, dirty_beam, dirty_map, hogbom, peak_position, restore
from vislake.operators.average import MAS
from vislake.operators.closure import divide_model, model_visibility, with_models


def gridded(stokes: DataFrame, uv_cell: float) -> DataFrame:
    """Weighted sums per (source, uv cell) as single visibilities at their weighted mean uv (at most cells^2 rows a source)."""
    cell = lambda c: F.rint(F.col(c) / uv_cell).cast("bigint")
    on = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c)
    g = stokes.where(present(F.col("w"))).groupBy("source", cell("u").alias("cu"), cell("v").alias("cv")).agg(on("u"), on("v"), on("re"), on("im"), F.sum("w").alias("sw"))
    return g.select("source", "u", "v", "re", "im", F.col("sw").alias("w"))


def fine_cell(grid: Grid) -> float:
    """Side of a uv cell within which a source's visibilities are summed before imaging: a 32nd of what the map's width
    resolves, so that the phase across a cell stays below a twentieth of a radian at the map's edge."""
    return 1 / (32 * grid.npix * grid.pixel)


def image_sources(stokes: DataFrame, grid: Grid, gain: float, niter: int, sigmas: float, weight_scale: float, window: Callable[[np.ndarray, Grid], np.ndarray] | None = None) -> DataFrame:
    """One row per source: maps, beam, components, peak and noise.

    stokes: source, u, v (1/mas), re, im, w. CLEAN stops at sigmas times the map's noise 1/sqrt(2 k sum w). Sources
    whose coverage is a point or a line have no beam and come out with NULL maps. Columns: source, npix, pixel, dirty,
    residual, restored (arrays, x fastest), flux, comp_x, comp_y (arrays, strongest first), sigma_major, ratio, pa, peak,
    peak_x, peak_y, rms, sigma, niter, nvis.
    """
    out = "source int, npix int, pixel double, dirty array<double>, residual array<double>, restored array<double>, flux array<double>, comp_x array<double>, comp_y array<double>, sigma_major double, ratio double, pa double, peak double, peak_x double, peak_y double, rms double, sigma double, niter int, nvis bigint"
    columns = [c.split()[0] for c in out.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "v", "re", "im"], ignore_index=True)
        u, v, w = (pdf[c].to_numpy() for c in ("u", "v", "w"))
        vis = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        row = dict.fromkeys(columns) | {"source": int(pdf["source"].iloc[0]), "npix": grid.npix, "pixel": grid.pixel, "nvis": len(pdf)}
        try:
            beam = beam_moments(u, v, w)
        except ValueError:
            return pd.DataFrame([row])[columns]
        dirty, patch = dirty_map(u, v, vis, w, grid), dirty_beam(u, v, w, grid)
        sigma = 1 / np.sqrt(2 * weight_scale * w.sum())
        flux, residual, used = hogbom(dirty, patch, gain, niter, sigmas * sigma, None if window is None else window(dirty, grid))
        image = restore(flux, residual, beam, grid)
        x, y = np.nonzero(flux)
        order = np.argsort(-np.abs(flux[x, y]), kind="stable")
        px, py = peak_position(image, grid)
        flat = lambda m: m.ravel(order="F").tolist()
        row |= {"dirty": flat(dirty), "residual": flat(residual), "restored": flat(image), "flux": flux[x, y][order].tolist(), "comp_x": grid.axis()[x[order]].tolist(), "comp_y": grid.axis()[y[order]].tolist()}
        row |= {"sigma_major": beam[0], "ratio": beam[1], "pa": beam[2], "peak": float(image.max()), "peak_x": px, "peak_y": py, "rms": float(np.sqrt((residual**2).mean())), "sigma": float(sigma), "niter": used}
        return pd.DataFrame([row])[columns]

    return stokes.where(present(F.col("w"))).select("source", "u", "v", "re", "im", "w").groupBy("source").applyInPandas(run, out)


def dirty_pixels(stokes: DataFrame, npix: int, pixel: float) -> DataFrame:
    """(source, x, y, value) of the dirty map as Columns alone: each visibility adds to a constant list of pixels, summed by
    a hash aggregate (I1 for small maps and large data; the pixel list is a literal, so no join is involved)."""
    axis = [(k - npix // 2) * pixel for k in range(npix)]
    xy = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in axis for y in axis])).alias("g")
    s = stokes.where(present(F.col("w"))).select("source", "u", "v", "re", "im", "w", xy)
    arg = (F.col("u") * F.col("g.x") + F.col("v") * F.col("g.y")) * -TWO_PI
    add = F.col("w") * (F.col("re") * F.cos(arg) - F.col("im") * F.sin(arg))
    return s.groupBy("source", "g.x", "g.y").agg((F.sum(add) / F.sum("w")).alias("value"))


def dirty_maps(stokes: DataFrame, grid: Grid) -> DataFrame:
    """The same on grids of any size, one source's map per task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "v", "re", "im"], ignore_index=True)
        u, v, w = (pdf[c].to_numpy() for c in ("u", "v", "w"))
        value = dirty_map(u, v, pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy(), w, grid)
        x, y = np.meshgrid(grid.axis(), grid.axis(), indexing="ij")
        return pd.DataFrame({"source": int(pdf["source"].iloc[0]), "x": x.ravel(), "y": y.ravel(), "value": value.ravel()})

    return stokes.where(present(F.col("w"))).select("source", "u", "v", "re", "im", "w").groupBy("source").applyInPandas(run, "source int, x double, y double, value double")


def components_of(images: DataFrame) -> DataFrame:
    """(source, components array<struct<flux, x, y>>) for divide_model and closures; empty models are left out."""
    z = F.transform(F.arrays_zip("flux", "comp_x", "comp_y"), lambda c: F.struct(c["flux"].alias("flux"), c["comp_x"].alias("x"), c["comp_y"].alias("y")))
    return images.where(F.size("flux") > 0).select("source", z.alias("components"))


def cleaned_flux(images: DataFrame) -> DataFrame:
    """(source, flux): total of the components, 0 for an empty model."""
    return images.select("source", F.aggregate(F.coalesce("flux", F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x).alias("flux"))


def hybrid(stokes: DataFrame, refit: Callable[[DataFrame], DataFrame], rounds: int, floor: float, uv_cell: float | None = None, **imaging) -> tuple[DataFrame, DataFrame]:
    """The imaging loop (I8): image, divide the model out, let refit improve the data, image again. Returns (images, data).

    refit gets model-divided data and returns corrected original data; each round is cut, so lineage stays flat. Images are
    made of uv cells (fine_cell of the grid unless given), so that no task holds all rows of a bright source.
    """
    from vislake.session import cut

    uv_cell = uv_cell or fine_cell(imaging["grid"])
    images = cut(image_sources(gridded(stokes, uv_cell), **imaging))
    for _ in range(rounds):
        models = components_of(images)
        divided = divide_model(stokes.join(models.select("source"), "source", "left_semi"), models, floor)
        stokes = cut(refit(divided))
        images = cut(image_sources(gridded(stokes, uv_cell), **imaging))
    return images, stokes


def image_by_receptor(stokes: dict[int, DataFrame], uv_cell: float | None = None, **imaging) -> DataFrame:
    """One image per source and receptor slot, to seed the loop (I8): the columns of image_sources and slot. stokes: slot ->
    data of that slot's diagonal product alone; a receptor without data has no image."""
    cell = uv_cell or fine_cell(imaging["grid"])
    parts = [image_sources(gridded(s, cell), **imaging).withColumn("slot", F.lit(k)) for k, s in sorted(stokes.items())]
    return reduce(DataFrame.unionByName, parts)


def best_seed(images: DataFrame) -> DataFrame:
    """(source, slot, components) of the receptor whose map stands out most from its noise, one per source (I8)."""
    ratio = F.col("peak") / F.col("rms")
    parts = F.transform(F.arrays_zip("flux", "comp_x", "comp_y"), lambda c: F.struct(c["flux"].alias("flux"), c["comp_x"].alias("x"), c["comp_y"].alias("y")))
    some = images.where(F.coalesce(F.size("flux"), F.lit(0)) > 0).select("source", F.struct(ratio.alias("r"), (-F.col("slot")).alias("n")).alias("k"), F.struct("slot", parts.alias("components")).alias("v"))
    return some.groupBy("source").agg(F.max_by("v", "k").alias("v")).select("source", "v.slot", "v.components")


def beam_matched_correlation(images: DataFrame, models: DataFrame) -> DataFrame:
    """(source, r, r_rotated, n): correlation of a source's restored map with a reference model restored with the map's own
    beam on its own grid, and with the model turned by 180 degrees (I10).

    Pixels within one beam (largest width at half maximum) of the peak are left out: the core is symmetric and would drown
    what is tested. images: as of image_sources; models: source, components array<flux, x, y>. Sources without either, or
    with a NULL map, have no row; constant maps have NULL.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                grid = Grid(int(r.npix), float(r.pixel))
                x, y = np.meshgrid(grid.axis(), grid.axis(), indexing="ij")
                mine = np.asarray(r.restored, float).reshape(grid.npix, grid.npix, order="F")
                keep = np.hypot(x - r.peak_x, y - r.peak_y) > FWHM * r.sigma_major
                sin, cos = np.sin(r.pa), np.cos(r.pa)
                maps = {1: np.zeros_like(mine), -1: np.zeros_like(mine)}
                for c in r.components:
                    for turn, m in maps.items():
                        dx, dy = x - turn * c["x"], y - turn * c["y"]
                        m += c["flux"] * np.exp(-0.5 * (((dx * sin + dy * cos) / r.sigma_major) ** 2 + ((dx * cos - dy * sin) / (r.sigma_major * r.ratio)) ** 2))
                ok = keep.sum() > 2 and mine[keep].std() > 0
                each = [float(np.corrcoef(m[keep], mine[keep])[0, 1]) if ok and m[keep].std() > 0 else None for m in maps.values()]
                out.append((r.source, *each, int(keep.sum())))
            yield pd.DataFrame(out, columns=["source", "r", "r_rotated", "n"])

    wanted = images.where(F.col("restored").isNotNull()).select("source", "npix", "pixel", "restored", "sigma_major", "ratio", "pa", "peak_x", "peak_y")
    return wanted.join(models.select("source", "components"), "source").mapInPandas(run, f"source {dict(images.dtypes)['source']}, r double, r_rotated double, n int")


# Edges of the baseline-length bins in millions of wavelengths, and the least number of data in a bin.
LENGTH_BINS = (0, 50, 100, 150, 200, 250, 300, 400, 1000)
LEAST_IN_BIN = 50


def amplitude_ratios(stokes: DataFrame, models: DataFrame, weight_scale: float, min_snr: float, floor: float = 0.02, least: int = LEAST_IN_BIN) -> tuple[DataFrame, DataFrame]:
    """Median |V| / |M| per source and baseline-length bin (source, bin, lo, hi, n, ratio), and per source and antenna
    (source, antenna, n, ratio): gain errors show in the second, differences of compactness in the first (I10).

    stokes: source, p, q, u, v (1/mas), re, im, w. Data where the model is below floor of its total flux or the model's SNR
    below min_snr are left out, and bins with fewer than `least` of them.
    """
    j = with_models(stokes.where(present(F.col("w"))), models.where(F.size("components") > 0).select("source", "components"))
    m = model_visibility(F.col("components"), F.col("u"), F.col("v")).abs()
    total = F.aggregate("components", F.lit(0.0), lambda a, c: a + F.abs(c["flux"]))
    good = j.select("source", "p", "q", m.alias("m"), F.hypot("re", "im").alias("a"), total.alias("total"), "w", (F.hypot("u", "v") / MAS / 1e6).alias("length"))
    good = good.where((F.col("m") > floor * F.col("total")) & (F.col("m") * F.sqrt(weight_scale * F.col("w")) >= min_snr)).withColumn("x", F.col("a") / F.col("m"))
    at = F.lit(None).cast("int")
    for k in range(len(LENGTH_BINS) - 1):
        at = F.when((F.col("length") >= LENGTH_BINS[k]) & (F.col("length") < LENGTH_BINS[k + 1]), k).otherwise(at)
    edges = F.array(*[F.lit(float(x)) for x in LENGTH_BINS])
    bins = good.withColumn("bin", at).where(F.col("bin").isNotNull()).groupBy("source", "bin").agg(F.count("*").alias("n"), F.median("x").alias("ratio")).where(F.col("n") >= least)
    bins = bins.select("source", "bin", edges[F.col("bin")].alias("lo"), edges[F.col("bin") + 1].alias("hi"), "n", "ratio")
    ends = good.select("source", F.explode(F.array("p", "q")).alias("antenna"), "x")
    return bins, ends.groupBy("source", "antenna").agg(F.count("*").alias("n"), F.median("x").alias("ratio"))
