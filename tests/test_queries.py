"""Every registered core query runs on the smallest tables and matches its SQL; the entry module keeps its contract."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from helpers import differences

FOLDER = "/root/testdata/sf0.001"
CORE = {n: f for m in entry.CORE for n, f in __import__(m, fromlist=["QUERIES"]).QUERIES.items()}
SQL = {n: s for m in entry.CORE for n, s in __import__(m, fromlist=["ORACLE"]).ORACLE.items()}

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, name):
    ours, theirs, more, less = differences(spark, name, CORE[name], SQL[name], FOLDER)
    assert (ours, more, less) == (theirs, [], [])


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = CORE[name](spark, FOLDER)
    assert df.columns and df.count() >= 0


def test_images_are_whole_and_stop_on_noise(spark):
    rows = CORE["img_i5_images"](spark, FOLDER).where("peak IS NOT NULL").collect()
    assert rows and {r["npix"] for r in rows} == {256} and max(r["niter"] for r in rows) < 100_000
    # An image that the cap of 200 steps would have cut.
    assert max(r["niter"] for r in rows) > 200
    whole = CORE["img_i1_map"](spark, FOLDER)
    assert whole.groupBy("source").count().where("count <> 65536").count() == 0
    few = CORE["img_i1_dirty"](spark, FOLDER)
    assert few.join(whole.withColumnRenamed("value", "v"), ["source", "x", "y"]).where("abs(value - v) < 2e-6").count() == few.count() > 0


def test_gap_scans_cover_the_table(spark):
    from vislake.plans.common import vis

    whole = CORE["part_g1_gaps_whole"](spark, FOLDER)
    assert whole.count() == vis(spark, FOLDER).select("t", "source", "p", "q").distinct().count()
    one = lambda df: sorted(tuple(x) for x in df.select("t", "scan").collect())
    assert one(whole.where("source = 1 AND p = 1 AND q = 2")) == one(CORE["part_g1_gaps"](spark, FOLDER))
    assert one(CORE["part_g1_gaps_by_source_whole"](spark, FOLDER).where("p = 1 AND q = 2")) == one(CORE["part_g1_gaps_by_source"](spark, FOLDER))


def test_alignment_and_last_valid_take_every_band(spark):
    from vislake.plans.records import _windows
    from pyspark.sql import functions as F

    every = _windows(spark, FOLDER, F.col("band").isNotNull())
    a = CORE["cal_c13_setups"](spark, FOLDER)
    assert a.agg({"nruns": "sum"}).first()[0] == every.count()
    assert a.where("fcell > 2").count() > 0
    ends = CORE["join_j5_last_valid_ends"](spark, FOLDER)
    assert ends.where("band > 1").count() > 0 and ends.where("side = 2").count() > 0


def test_positions_have_one_row_a_source(spark):
    names = [r["source"] for r in CORE["est_n7_positions"](spark, FOLDER).collect()]
    assert names and len({n.strip().upper() for n in names}) == len(names)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(CORE) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
