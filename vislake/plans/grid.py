"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vislake.operators.regular_grid import AFTER, BEFORE, GAP, HELD, INTERPOLATED, MAX_GAP, MEASURED, to_grid
from vislake.operators.tsys import has_antenna, readings, usable
from vislake.session import bounded, table


def p1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every period of every (session, antenna_no, band) series with its value and mark."""
    rows = readings(table(spark, sf_dir, "system_temperature"), table(spark, sf_dir, "sessions"), "t0_us", "stop_us", "grid_us")
    rows = rows.where(has_antenna(F.col("antenna_no")) & usable(F.col("tsys_1"), F.col("ceiling")))
    known = table(spark, sf_dir, "antennas").select("antenna_no").distinct()
    rows = rows.join(bounded(known), "antenna_no", "left_semi")
    return to_grid(rows, ["session", "antenna_no", "band"], "t_us", "tsys_1", "t0_us", "stop_us", "grid_us")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty periods of the series."""
    return p1_grid(spark, sf_dir).where(F.col("mark") != MEASURED).select("session", "antenna_no", "band", "period_start_us")


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid with rounded values: means, interpolated and held values, marks and lengths of gaps."""
    return p1_grid(spark, sf_dir).withColumn("value", F.round("value", 6))


QUERIES = {"p1_found": p1_found, "p1_grid": p1_grid, "p1_values": p1_values}

_CASES = """
WITH r AS (
  SELECT t.session, t.antenna_no, t.band, epoch_us(s.time0) t0, s.grid_s * 1000000::BIGINT g,
         (epoch_us(s.stop_at) - epoch_us(s.time0)) // (s.grid_s * 1000000::BIGINT) n,
         (epoch_us(t.time) - epoch_us(s.time0)) // (s.grid_s * 1000000::BIGINT) k, t.tsys_1 v
  FROM system_temperature t JOIN sessions s USING (session)
  WHERE t.antenna_no IN (SELECT antenna_no FROM antennas) AND t.antenna_no >= 1
    AND t.tsys_1 IS NOT NULL AND isfinite(t.tsys_1) AND t.tsys_1 > 0 AND t.tsys_1 <= s.tsys_ceiling
    AND t.time >= s.time0 AND t.time < s.stop_at),
occ AS (SELECT session, antenna_no, band, k, t0, g, n, avg(v) v, count(*) c FROM r GROUP BY ALL),
series AS (SELECT DISTINCT session, antenna_no, band, t0, g, n FROM occ),
grid AS (SELECT session, antenna_no, band, t0, g, n, unnest(range(0, n)) k FROM series)
"""

ORACLE = {
    "p1_values": _CASES + f""",
g AS (
  SELECT grid.*, v, c, last_value(CASE WHEN c IS NOT NULL THEN grid.k END IGNORE NULLS) OVER b pk, last_value(v IGNORE NULLS) OVER b pv, first_value(CASE WHEN c IS NOT NULL THEN grid.k END IGNORE NULLS) OVER f nk, first_value(v IGNORE NULLS) OVER f nv
  FROM grid LEFT JOIN occ USING (session, antenna_no, band, k)
  WINDOW b AS (PARTITION BY session, antenna_no, band ORDER BY grid.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY session, antenna_no, band ORDER BY grid.k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
m AS (
  SELECT *, CASE WHEN c IS NOT NULL THEN 0 ELSE coalesce(nk, n) - coalesce(pk, -1) - 1 END gp,
    CASE WHEN c IS NOT NULL THEN '{MEASURED}' WHEN pk IS NULL THEN CASE WHEN nk - k <= {MAX_GAP} THEN '{HELD}' ELSE '{BEFORE}' END WHEN nk IS NULL THEN CASE WHEN k - pk <= {MAX_GAP} THEN '{HELD}' ELSE '{AFTER}' END WHEN nk - pk - 1 <= {MAX_GAP} THEN '{INTERPOLATED}' ELSE '{GAP}' END mark FROM g)
SELECT session, antenna_no, band, t0 + k * g AS period_start_us, round(CASE mark WHEN '{MEASURED}' THEN v WHEN '{HELD}' THEN CASE WHEN pk IS NULL THEN nv ELSE pv END WHEN '{INTERPOLATED}' THEN pv + (nv - pv) * (k - pk) / (nk - pk) END, 6) AS value, coalesce(c, 0) AS n_readings, gp AS gap_periods, mark FROM m
""",
    "p1_found": _CASES + """
SELECT grid.session, grid.antenna_no, grid.band, grid.t0 + grid.k * grid.g AS period_start_us
FROM grid ANTI JOIN occ USING (session, antenna_no, band, k)
""",
}
