"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vislake.llm.rank_summary import EPSILON, combine, combined, percentiles, summarise
from vislake.operators.references import text_key
from vislake.operators.tsys import has_antenna, readings, usable
from vislake.session import finite, table

QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, dim, grp, month, x): every value once per grouping it belongs to."""
    obs = table(spark, sf_dir, "observables").select("source", "a1", "a2", "tau_residual", "snr", F.date_format("datetime", "yyyy-MM").alias("month"))
    pair = F.concat_ws("-", F.least("a1", "a2"), F.greatest("a1", "a2"))
    cell = lambda metric, dim, grp, x: F.struct(F.lit(metric).alias("metric"), F.lit(dim).alias("dim"), grp.alias("grp"), F.col(x).cast("double").alias("x"))
    both = [cell(m, d, g, m) for m in ("tau_residual", "snr") for d, g in (("baseline", pair), ("source", text_key(F.col("source"))))]
    one = obs.select("month", F.explode(F.array(*both)).alias("c"))
    st = readings(table(spark, sf_dir, "system_temperature"), table(spark, sf_dir, "sessions"))
    st = st.where(usable(F.col("tsys_1"), F.col("ceiling"))).select("antenna_no", "band", "tsys_1", F.date_format(F.timestamp_micros("t_us"), "yyyy-MM").alias("month"))
    antenna = F.when(has_antenna(F.col("antenna_no")), F.col("antenna_no").cast("string"))
    two = st.select("month", F.explode(F.array(cell("tsys_1", "antenna", antenna, "tsys_1"), cell("tsys_1", "band", F.col("band").cast("string"), "tsys_1"))).alias("c"))
    return one.unionByName(two).select("c.metric", "c.dim", "c.grp", "month", "c.x").where(F.col("grp").isNotNull())


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per antenna, baseline, source and band over all rows, with their error bounds."""
    keys = ["metric", "dim", "grp"]
    return percentiles(combined(_values(spark, sf_dir), keys, "x"), keys, QUANTILES)


def p5_from_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles, combined from summaries of single months."""
    keys = ["metric", "dim", "grp"]
    months = combine(summarise(_values(spark, sf_dir), [*keys, "month"], "x"), [*keys, "month"])
    return percentiles(combine(months, keys), keys, QUANTILES)


def _bounds(values: DataFrame, found: DataFrame) -> DataFrame:
    """Whether every percentile is within its own bound, and that within EPSILON, by the exact ranks of the value: (metric, dim, grp, q, n, within_bound)."""
    keys = ["metric", "dim", "grp"]
    held = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("q", "value", "rank_error", "rank_bound"))).alias("got"))  # one per quantile
    value = lambda i: F.col("got")[i]["value"]
    counts = [c for i in range(len(QUANTILES)) for c in (F.count_if(F.col("x") < value(i)).alias(f"below{i}"), F.count_if(F.col("x") <= value(i)).alias(f"upto{i}"))]
    ranked = values.where(finite(F.col("x"))).join(held, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.first("got").alias("got"), *counts)

    def row(i: int) -> Column:
        want, of = 1 + F.lit(QUANTILES[i]) * (F.col("n") - 1), F.col("got")[i]
        off = F.greatest(F.col(f"below{i}") + 1 - want, want - F.col(f"upto{i}"), F.lit(0.0))
        return F.struct(F.lit(QUANTILES[i]).alias("q"), ((off <= of["rank_error"] * F.col("n") + 1e-6) & (of["rank_error"] <= of["rank_bound"] + 1e-9) & (of["rank_bound"] <= EPSILON + 0.5 / F.col("n") + 1e-9)).alias("within_bound"))

    return ranked.select(*keys, "n", F.explode(F.array(*[row(i) for i in range(len(QUANTILES))])).alias("r")).select(*keys, "r.q", "n", "r.within_bound")


def p5_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles of all rows against exact ranks."""
    return _bounds(_values(spark, sf_dir), p5_percentiles(spark, sf_dir))


def p5_month_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles combined from months against exact ranks."""
    return _bounds(_values(spark, sf_dir), p5_from_months(spark, sf_dir))


QUERIES = {"p5_month_bounds": p5_month_bounds, "p5_percentiles": p5_percentiles, "p5_from_months": p5_from_months, "p5_bounds": p5_bounds}

#: The groups and their exact sizes; every percentile is expected within its bound.
_BOUNDS = f"""
WITH v AS (
  SELECT 'tau_residual' metric, 'baseline' dim, least(a1, a2) || '-' || greatest(a1, a2) grp, tau_residual x FROM observables
  UNION ALL SELECT 'snr', 'baseline', least(a1, a2) || '-' || greatest(a1, a2), snr FROM observables
  UNION ALL SELECT 'tau_residual', 'source', upper(trim(source)), tau_residual FROM observables WHERE trim(source) <> ''
  UNION ALL SELECT 'snr', 'source', upper(trim(source)), snr FROM observables WHERE trim(source) <> ''
  UNION ALL SELECT 'tsys_1', 'antenna', CAST(antenna_no AS VARCHAR), tsys_1 FROM system_temperature JOIN sessions USING (session) WHERE antenna_no >= 1 AND tsys_1 > 0 AND tsys_1 <= tsys_ceiling
  UNION ALL SELECT 'tsys_1', 'band', CAST(band AS VARCHAR), tsys_1 FROM system_temperature JOIN sessions USING (session) WHERE tsys_1 > 0 AND tsys_1 <= tsys_ceiling),
g AS (SELECT metric, dim, grp, count(*) n FROM v WHERE grp IS NOT NULL AND isfinite(x) GROUP BY ALL)
SELECT metric, dim, grp, q, n, true AS within_bound FROM g, (SELECT unnest([{", ".join(map(str, QUANTILES))}])::DOUBLE q)
"""

ORACLE = {"p5_bounds": _BOUNDS, "p5_month_bounds": _BOUNDS}
