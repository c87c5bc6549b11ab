"""Usable system-temperature readings (shared by several operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vislake.session import bounded, finite, micros


def has_antenna(antenna_no: Column) -> Column:
    """The number is recorded: not NULL and at least 1."""
    return F.coalesce(antenna_no >= 1, F.lit(False))


def usable(tsys: Column, ceiling: Column) -> Column:
    """A reading counts if it is finite, above zero and not above the session's ceiling; never NULL."""
    return finite(tsys) & F.coalesce((tsys > 0) & (tsys <= ceiling), F.lit(False))


def session_terms(sessions: DataFrame) -> DataFrame:
    """One row per session with its clock in microseconds, grid, tolerance and ceiling."""
    return sessions.where(F.col("session").isNotNull()).select(
        "session",
        micros(F.col("time0")).alias("t0_us"),
        micros(F.col("stop_at")).alias("stop_us"),
        (F.col("grid_s").cast("bigint") * 1_000_000).alias("grid_us"),
        (F.col("match_tol_s") * 1e6).alias("tol_us"),
        F.col("tsys_ceiling").alias("ceiling"),
    )


def readings(system_temperature: DataFrame, sessions: DataFrame, *terms: str) -> DataFrame:
    """system_temperature rows (columns the operators need) with the session's terms joined on."""
    dims = bounded(session_terms(sessions).select("session", "ceiling", *[t for t in terms if t != "ceiling"]))
    rows = system_temperature.select("st_id", "session", "rec_id", micros(F.col("time")).alias("t_us"), "antenna_no", "band", "tsys_1", "tsys_2")
    return rows.join(dims, "session")
