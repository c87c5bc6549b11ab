"""Visibilities made by an explode are joined with their models and never broadcast, whatever Spark's estimate of them."""

from pathlib import Path

import pytest

from vislake.operators import closure
from vislake.plans import views

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [True, False])
def test_closures_broadcast_models_only(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(closure, "small", lambda df: False)
    c = views.agg_a14_closures(spark, FOLDER)
    assert "BuildLeft" not in _plan(c)
    got = c.collect()
    assert len(got) == len({r["source"] for r in got}) == spark.read.parquet(f"{FOLDER}/sessions.parquet").count()
    assert {(r["n_phase"], r["n_amp"], r["chi2_phase"], r["chi2_amp"]) for r in got} == {(20 * 64, 45 * 64, 0.0, 0.0)}


@pytest.mark.parametrize("few", [True, False])
def test_amplitude_ratios_broadcast_models_only(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(closure, "small", lambda df: False)
    c = views.img_i10_ratios(spark, FOLDER)
    assert "BuildLeft" not in _plan(c)
    got = c.collect()
    assert len(got) == len({(r["source"], r["antenna"]) for r in got}) == 7 * spark.read.parquet(f"{FOLDER}/sessions.parquet").count()
    assert {(r["antenna"] == 0, r["n"], r["ratio"]) for r in got} == {(True, 15 * 64, 1.5), (False, 5 * 64, 1.5)}
