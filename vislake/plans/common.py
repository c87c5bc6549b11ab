"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vislake.sources.adapters import CHANNELS_CTE, VIS_CTE, channels, vis


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero: sums differ in their last bits between engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def with_vis(sql: str, *more: str) -> str:
    """SQL with the visibility and channel tables in front."""
    return "WITH " + ",\n".join([VIS_CTE, CHANNELS_CTE, *more]) + "\n" + sql


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visibilities with tcell (year) and fcell (frequency window)."""
    return vis(spark, sf_dir).select("*", (F.floor((F.col("scan") - 1) / 12) - 1994).cast("int").alias("tcell"), F.col("if_id").alias("fcell"))


#: The same for DuckDB.
CELLS_CTE = "cells AS (SELECT *, CAST((scan - 1) // 12 - 1994 AS INT) AS tcell, if_id AS fcell FROM vis)"

__all__ = ["CELLS_CTE", "CHANNELS_CTE", "VIS_CTE", "cells", "channels", "r", "vis", "with_vis"]
