"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vislake.operators.interval_runs import runs_and_gaps
from vislake.operators.tsys import has_antenna
from vislake.session import micros, table

#: Longer half intervals (more than 140 000 years, infinite ones too) are taken as this many microseconds, which is beyond any
#: other time, so that their ends can be placed on the clock.
FARTHEST_US = 4.5e18


def covers(df: DataFrame, tab: str) -> DataFrame:
    """(tab, session, antenna_no, start_us, end_us) of the rows with antenna_no and a usable interval."""
    half = F.least(F.col("interval") / 2 * 1e6, F.lit(FARTHEST_US))
    good = has_antenna(F.col("antenna_no")) & F.col("time").isNotNull() & F.coalesce(~F.isnan("interval") & (F.col("interval") >= 0), F.lit(False))
    rows = df.where(good).select("session", "antenna_no", micros(F.col("time")).alias("t"), F.rint(half).cast("bigint").alias("h"))
    return rows.select(F.lit(tab).alias("tab"), "session", "antenna_no", (F.col("t") - F.col("h")).alias("start_us"), (F.col("t") + F.col("h")).alias("end_us"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered periods and gaps of tones and system_temperature per session and antenna."""
    both = covers(table(spark, sf_dir, "tones"), "tones").unionByName(covers(table(spark, sf_dir, "system_temperature"), "system_temperature"))
    return runs_and_gaps(both, ["tab", "session", "antenna_no"]).select("tab", "session", "antenna_no", "kind", "start_us", "end_us")


QUERIES = {"p3_found": p3_found}

ORACLE = {
    "p3_found": """
WITH c AS (
  SELECT 'tones' tab, session, antenna_no, epoch_us(time) - CAST(round_even(interval * 5e5, 0) AS BIGINT) s, epoch_us(time) + CAST(round_even(interval * 5e5, 0) AS BIGINT) e
  FROM tones WHERE antenna_no >= 1 AND interval IS NOT NULL AND NOT isnan(interval) AND interval >= 0
  UNION ALL
  SELECT 'system_temperature', session, antenna_no, epoch_us(time) - CAST(round_even(interval * 5e5, 0) AS BIGINT), epoch_us(time) + CAST(round_even(interval * 5e5, 0) AS BIGINT)
  FROM system_temperature WHERE antenna_no >= 1 AND interval IS NOT NULL AND NOT isnan(interval) AND interval >= 0),
u AS (SELECT DISTINCT * FROM c),
m AS (SELECT *, max(e) OVER (PARTITION BY tab, session, antenna_no ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM u),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY tab, session, antenna_no ORDER BY s, e ROWS UNBOUNDED PRECEDING) isl FROM m),
p AS (SELECT tab, session, antenna_no, isl, min(s) s, max(e) e FROM i GROUP BY ALL),
g AS (SELECT *, lead(s) OVER (PARTITION BY tab, session, antenna_no ORDER BY s) nx FROM p)
SELECT tab, session, antenna_no, 'period' AS kind, s AS start_us, e AS end_us FROM g
UNION ALL SELECT tab, session, antenna_no, 'gap', e, nx FROM g WHERE nx IS NOT NULL
""",
}
