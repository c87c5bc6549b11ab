"""A small session from a file to its products."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vislake.operators.gains import Solution
from vislake.operators.partition import gap_scans
from vislake.operators.residuals import excursion
from vislake.plans import session_run as sr
from vislake.plans.config import OwnImaging, SessionConfig, VisibilityAveraging
from vislake.sources import fits
from test_whatif import SPEC, observables  # noqa: F401

CHANNELS = [(k + 1, 8.4e9 + k * 1e7, 1) for k in range(4)]


def _file(path):
    """Four antennas, one source of 2 Jy at the phase centre, two scans; antenna 1 is flagged in the second half of scan 2."""
    rng = np.random.default_rng(12)
    rows = []
    for t in [*range(0, 60, 10), *range(1000, 1060, 10)]:
        for p in range(1, 5):
            for q in range(p + 1, 5):
                uvw = rng.normal(size=3) * 3e-3
                rows.append((t, 256 * p + q, *uvw))
    n = len(rows)
    flux = np.zeros((n, 4, 2, 2), "f4")
    flux[..., 0] = 2.0
    cols = {"UU": np.array([r[2] for r in rows]), "VV": np.array([r[3] for r in rows]), "WW": np.zeros(n), "DATE": np.full(n, 2460000.5), "TIME": np.array([r[0] for r in rows]) / 86400, "BASELINE": np.array([r[1] for r in rows], "i4"), "SOURCE": np.ones(n, "i4"), "INTTIM": np.full(n, 5.0, "f4"), "WEIGHT": np.ones((n, 2), "f4"), "FLUX": flux.reshape(n, -1)}
    more = [fits.card(k, v) for k, v in (("MAXIS", 4), ("CTYPE1", "COMPLEX"), ("MAXIS1", 2), ("CTYPE2", "STOKES"), ("MAXIS2", 2), ("CTYPE3", "FREQ"), ("MAXIS3", 4), ("CTYPE4", "BAND"), ("MAXIS4", 1))]
    flags = {"ANTS": np.array([[1, 0]], "i4"), "TIMERANG": np.array([[1030.0, 2000.0]], "f4") / 86400}
    path.write_bytes(fits.header([fits.card("SIMPLE", True), fits.card("BITPIX", 8), fits.card("NAXIS", 0)]) + fits.table_bytes("UV_DATA", cols, more) + fits.table_bytes("FLAG", flags))


def test_session_from_file_to_products(spark, tmp_path, observables):  # noqa: F811
    _file(tmp_path / "x.fits")
    own = OwnImaging(npix=32, pixel=0.5, niter=200, sigmas=3.0, window_radius=4.0)
    config = SessionConfig("sess", str(tmp_path / "x.fits"), "AA", str(tmp_path), members=(own,), averaging=VisibilityAveraging(30.0, "window"), fit=SPEC)
    channels = spark.createDataFrame(CHANNELS, "chan int, nu double, if_id int")
    s = sr.open_session(spark, config, channels)
    assert set(s.tables) == {"FLAG"} and s.scans.cells.count() == 2
    assert s.vis.where("t >= 1030 and (p = 1 or q = 1)").count() == 0 and s.vis.where("t = 1020 and p = 1").count() == 3 * 4 * 2
    zero = Solution(spark.createDataFrame([], "kind string, p int, i int, tcell int, fcell int, value double"), s.scans.cells.select("cell", "ref"), s.windows.cells.select("cell", "ref"))
    stokes = sr.calibrate_and_average(s, zero).cache()
    assert stokes.agg(F.max(F.abs(F.col("re") - 2.0))).first()[0] < 1e-6 and {r["scan"] for r in stokes.select("scan").distinct().collect()} == {1, 2}
    images = sr.own_images(stokes, own).withColumn("source", F.lit("s1"))
    assert images.first()["peak"] == pytest.approx(2.0, rel=0.05)
    sets = spark.sql("SELECT 'point' model_set, 1 source, array(struct(1D flux, 0D x, 0D y)) components")
    closures = sr.closure_evaluation(stokes, sets, 100.0).select("model_set", F.lit("s1").alias("source"), "chi2_phase", "chi2_amp")
    assert closures.first()["chi2_phase"] == pytest.approx(0, abs=1e-9) and closures.first()["chi2_amp"] == pytest.approx(0, abs=1e-9)
    models = spark.sql("SELECT 's1' source, array(struct(1D flux, 0.5D x, 0D y)) components")
    results = sr.register_sets(s, observables, {"point": None, "shifted": models})
    moved = results["point"]["positions"].set_index("source").dra_mas - results["shifted"]["positions"].set_index("source").dra_mas
    assert moved["s1"] == pytest.approx(0.5, rel=1e-3) and abs(moved["s2"]) < 1e-6
    infos = spark.createDataFrame([("s1", 10.0, 20.0, 0.7)], "source string, ra_deg double, dec_deg double, flux double")
    made = sr.products(spark, s, results, images, infos, closures, infos.select("source", F.lit(0.1).alias("ref_ra")), str(tmp_path / "out"))
    assert set(made) == set(config.products) and made["wcs"].count() == 1 and (tmp_path / "out" / "manifest.toml").exists()
    assert len((tmp_path / "out" / "catalogue.csv").read_text().splitlines()) == 9


def test_files_of_two_bands_become_one(spark, tmp_path):
    for name in ("low", "high"):
        _file(tmp_path / f"{name}.fits")
    at = lambda base: spark.createDataFrame([(k + 1, base + k * 1e7) for k in range(4)], "chan int, nu double")
    files = {str(tmp_path / "low.fits"): at(8.4e9), str(tmp_path / "high.fits"): at(8.6e9)}
    rows, vis = sr.open_files(spark, files, 1e7, gap_scans(100.0))
    got = rows.collect()
    assert len(got) == 12 * 6 and {r["n_bands"] for r in got} == {2} and {r["scan"] for r in got} == {1, 2}
    assert [(r["t"], r["p"], r["q"]) for r in got] == sorted((r["t"], r["p"], r["q"]) for r in got)
    assert vis.count() == 12 * 6 * 4 * 2 * 2 and {r["band"] for r in vis.select("band").distinct().collect()} == {1, 2}
    with pytest.raises(ValueError):
        sr.open_files(spark, {**files, str(tmp_path / "high.fits"): at(8.43e9)}, 1e7, gap_scans(100.0))


def test_uncertainty_model(spark):
    rng = np.random.default_rng(13)
    n = 60
    pdf = pd.DataFrame({"source": [f"s{k}" for k in range(n)], "ra": rng.uniform(0, 6, n), "dec": rng.uniform(-1, 1, n), "sigma_ra_mas": 0.05, "sigma_dec_mas": 0.05})
    pdf["dra_mas"], pdf["ddec_mas"] = rng.normal(size=n) * 0.2, rng.normal(size=n) * 0.2
    ref = pd.DataFrame({"source": pdf.source, "ref_ra": 0.0, "ref_dec": 0.0, "ref_sigma_ra": 0.0, "ref_sigma_dec": 0.0})
    got = sr.uncertainty_model(spark.createDataFrame(pdf), spark.createDataFrame(ref))
    assert np.abs(got["rotation"]).max() < 0.1 and 0.1 < got["fixed"]["ra"]["f"] < 0.3 and got["offsets"].count() == n
    runs = spark.createDataFrame([("a", k, x) for k, x in enumerate([0.0, 1.0, 3.0, -4.0, 2.0, 1.9, 0.0])] + [("b", 5, 1.0), ("c", 1, float("nan")), ("c", 2, None), ("b", 6, None), ("d", 1, 2.0), ("d", 2, 2.0)], "g string, k int, x double")
    assert sorted(tuple(r) for r in excursion(runs, ["g"], "k", "x").collect()) == [("a", 3, 2, 4), ("b", 5, 5, 5), ("d", 1, 1, 2)]
