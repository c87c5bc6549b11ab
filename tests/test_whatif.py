"""Solves under changes: splits, jackknife, stress, injections, registration."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vislake.operators import whatif
from vislake.operators.estimate import MAS, DelayFit


@pytest.fixture(scope="module")
def observables(spark):
    rng = np.random.default_rng(11)
    ants, srcs = ["AA", "BB", "CC"], ["s1", "s2", "s3", "s4"]
    rows = []
    for n in range(240):
        a1, a2 = rng.choice(ants, 2, replace=False)
        el, part = rng.uniform(0.4, 1.4, 2), rng.normal(size=2) * 0.02
        rows.append({"obs_id": n, "scan": n // 10, "source": str(rng.choice(srcs)), "a1": str(a1), "a2": str(a2), "slot": 1 + n % 2, "t": n * 15.0, "tau_residual": part[0] * 0.3 * MAS + rng.normal() * 3e-12, "sigma_tau": 3e-12, "sigma_iono": 1e-12, "dtau_dra": part[0], "dtau_ddec": part[1], "wet1": 1 / np.sin(el[0]), "wet2": 1 / np.sin(el[1]), "grad1": 0.1, "grad2": 0.2, "az1": 0.1 * n, "az2": 0.2 * n, "snr": 50.0, "el1": el[0], "el2": el[1]})
    return spark.createDataFrame(pd.DataFrame(rows).astype({"slot": "int32", "scan": "int32"})).cache()


SPEC = DelayFit("AA", robust_iterations=0, reweight=False, reject=False, sigma_floor_init=0.0)


def test_halves_agree_and_jackknife_names_every_free_antenna(observables):
    halves = whatif.split_solves(observables, SPEC)
    assert set(halves) == {"time", "scan", "slot"}
    assert all(abs(d["n_sigma_ra"]).max() < 6 for _, _, d in halves.values())
    assert set(whatif.jackknife(observables, SPEC)) == {"BB", "CC"}


def test_stress_and_constraints(observables):
    s = whatif.stress(observables, SPEC, {"min_snr": [7.0, 10.0], "zwd_node": [900.0]})
    assert len(s) == 3 and s.loc[0, "rms_ra_mas"] == pytest.approx(0, abs=1e-9)
    assert whatif.constraint_chi2(whatif.variant(observables, SPEC, min_snr=5.0)) >= 0


def test_injections_move_positions(observables):
    ids = observables.select("obs_id", (F.col("dtau_dra") * MAS).alias("injected"))
    t = whatif.transfer(observables, SPEC, {"shift": [ids, ids.withColumn("injected", F.col("injected") * 2)], "none": [ids.where("false")]}).set_index("family")
    assert t.loc["shift", "mean_mas"] == pytest.approx(1.5 / np.sqrt(2), rel=1e-3) and t.loc["none", "mean_mas"] == pytest.approx(0, abs=1e-9)


def test_registration_matches_rows_that_wrapped(observables):
    wrapped = observables.withColumn("tau_residual", F.when(F.col("obs_id") < 20, float("nan")).otherwise(F.col("tau_residual")))
    r = whatif.register({"point": observables, "model": wrapped}, SPEC)
    assert r["point"]["n_wrapped"] == 0 and r["model"]["n_wrapped"] == 20
    assert whatif.compare(r["model"]["fit"], r["model"]["matched"])["dra_mas"].abs().max() < 1e-9
    assert whatif.fit_summary(r).shape == (2, 6) and r["model"]["sources"].count() == 4


def test_scans_and_series(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    rows = pd.DataFrame({"b": rng.choice(["u", "v"], 400), "installed": x, "w": 1.0})
    rows["residual"] = np.where(rows.b == "u", 0.8, -0.3) * x
    scan = whatif.fraction_scan(spark.createDataFrame(rows), ["b"], [-1.0, -0.5, 0.0, 0.5, 1.0, 1.5], {"all": F.lit(True), "few": F.col("installed") > 0, "none": F.lit(False)})
    low = {(r["arm"], r["b"]): (r["scale"], r["value"]) for r in whatif.scan_minima(scan, ["arm", "b"]).collect()}
    assert set(low) == {(a, b) for a in ("all", "few") for b in "uv"}
    assert all(low[a, b][0] == pytest.approx({"u": 0.8, "v": -0.3}[b]) and low[a, b][1] == pytest.approx(0, abs=1e-6) for a, b in low)
    edge = whatif.scan_minima(spark.createDataFrame([("x", 0.0, 1.0), ("x", 1.0, 2.0)], "k string, scale double, value double"), ["k"]).first()
    assert (edge["scale"], edge["value"]) == (0.0, 1.0)
    assert whatif.turbulent(256, 1.0, -5 / 3, 2.0, 1).std() == pytest.approx(2.0)
    t = np.linspace(0, 100, 60)
    x = np.sin(t)
    both = pd.concat([pd.DataFrame({"s": "one", "t": t, "installed": x, "residual": 0.7 * x + 3 + 0.01 * t}), pd.DataFrame({"s": "two", "t": t, "installed": x, "residual": -x}), pd.DataFrame({"s": "flat", "t": t, "installed": 0.0, "residual": x}), pd.DataFrame({"s": "one", "t": [5.0], "installed": [float("nan")], "residual": [0.0]})])
    got = {r["s"]: (r["slope"], r["n"]) for r in whatif.sign_regressions(spark.createDataFrame(both), ["s"], 20.0).collect()}
    assert got["one"] == (pytest.approx(0.7, abs=0.02), 60) and got["two"][0] == pytest.approx(-1) and got["flat"][0] is None
