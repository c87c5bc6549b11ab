"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vislake.operators.impute import ABSENT, FILLED, RECORDED, fill_readings
from vislake.session import table


def p2_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of system_temperature with antenna_no and tsys_1 recorded, filled or absent."""
    return fill_readings(table(spark, sf_dir, "system_temperature"), table(spark, sf_dir, "sessions"), table(spark, sf_dir, "antennas"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that were filled."""
    rows = p2_filled(spark, sf_dir)
    fields = F.explode(F.array_compact(F.array(F.when(F.col("antenna_mark") == FILLED, "antenna_no"), F.when(F.col("tsys_mark") == FILLED, "tsys_1"))))
    return rows.where((F.col("antenna_mark") == FILLED) | (F.col("tsys_mark") == FILLED)).select("st_id", fields.alias("field"))


def p2_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its antenna and marks, its reading if recorded, and whether a filled one is a reading at all."""
    f = p2_filled(spark, sf_dir)
    return f.select("st_id", "antenna_no", "antenna_mark", "tsys_mark", F.when(F.col("tsys_mark") == RECORDED, F.col("tsys_1")).alias("recorded"), F.coalesce((F.col("tsys_mark") != FILLED) | ((F.col("tsys_1") > 0) & (F.col("tsys_1") < 1e6)), F.lit(False)).alias("plausible"))


QUERIES = {"p2_found": p2_found, "p2_filled": p2_filled, "p2_marks": p2_marks}

_FOUND = """
WITH r AS (
  SELECT t.st_id, t.session, t.band, t.rec_id, CASE WHEN t.antenna_no >= 1 THEN t.antenna_no END own,
         coalesce(isfinite(t.tsys_1) AND t.tsys_1 > 0 AND t.tsys_1 <= s.tsys_ceiling, false) ok
  FROM system_temperature t JOIN sessions s USING (session)),
best AS (
  SELECT rec_id, max(CASE WHEN own IN (SELECT antenna_no FROM antennas) THEN 1000000000 + own ELSE own END) b FROM r WHERE own IS NOT NULL GROUP BY rec_id),
w AS (SELECT r.*, coalesce(own, b % 1000000000) ant FROM r LEFT JOIN best USING (rec_id)),
good AS (SELECT DISTINCT session, band, ant FROM w WHERE ok AND ant IS NOT NULL)
"""

ORACLE = {
    "p2_marks": _FOUND.replace("t.rec_id, CASE", "t.rec_id, t.tsys_1, CASE") + f"""
SELECT st_id, ant AS antenna_no, CASE WHEN own IS NOT NULL THEN '{RECORDED}' WHEN ant IS NOT NULL THEN '{FILLED}' ELSE '{ABSENT}' END AS antenna_mark,
  CASE WHEN ok THEN '{RECORDED}' WHEN good.ant IS NOT NULL THEN '{FILLED}' ELSE '{ABSENT}' END AS tsys_mark, CASE WHEN ok THEN tsys_1 END AS recorded, true AS plausible
FROM w LEFT JOIN good USING (session, band, ant)
""",
    "p2_found": _FOUND + """
SELECT st_id, 'antenna_no' AS field FROM w WHERE own IS NULL AND ant IS NOT NULL
UNION ALL SELECT st_id, 'tsys_1' FROM w JOIN good USING (session, band, ant) WHERE NOT ok
""",
}
