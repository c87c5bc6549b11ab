"""The data set value: visibilities in long form with their dimension tables, and selections on it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vislake.functions.complexmath import present


@dataclass(frozen=True)
class Dataset:
    """vis: row_id, p, q, source, scan, t, chan, i, j, u, v, w, re, im (one row per product); dimension tables alongside.

    row_id and chan are the lineage to the root: selections keep them. root is False for a selection, and partitions are
    built on roots only.
    """

    vis: DataFrame
    channels: DataFrame
    antennas: DataFrame | None = None
    sources: DataFrame | None = None
    time0: str = "1995-01-01 00:00:00"
    root: bool = True


@dataclass(frozen=True)
class Selection:
    """A row predicate (a Column, or a callable of the data set's visibilities) and a strictly increasing channel list."""

    where: Column | Callable[[DataFrame], Column] | None = None
    channels: Sequence[int] | None = field(default=None)

    def __post_init__(self) -> None:
        c = self.channels
        if c is not None and any(a >= b for a, b in zip(c, c[1:])):
            raise ValueError(f"channels must be strictly increasing, got {list(c)}")


def select(ds: Dataset, selection: Selection) -> Dataset:
    """Rows and channels of a selection; dimensions, encodings and the clock stay. A NULL predicate drops the row."""
    vis, chans = ds.vis, ds.channels
    if selection.where is not None:
        vis = vis.where(selection.where(vis) if callable(selection.where) else selection.where)
    if selection.channels is not None:
        wanted = F.col("chan").isin(list(selection.channels))
        vis, chans = vis.where(wanted), chans.where(wanted)
    return replace(ds, vis=vis, channels=chans, root=False)


def usable(ds: Dataset) -> DataFrame:
    """Products with positive weight."""
    return ds.vis.where(present(F.col("w")))


def diagonal_slot(ds: Dataset, r: int) -> Dataset:
    """Weight 0 for all products but (r, r)."""
    return replace(ds, vis=ds.vis.withColumn("w", F.when((F.col("i") == r) & (F.col("j") == r), F.col("w")).otherwise(0.0)), root=False)


def window(ds: Dataset, t_low: float, t_high: float, p: int, q: int) -> Dataset:
    """Rows of one directed baseline within a closed stretch of time (P5)."""
    return select(ds, Selection(F.col("t").between(t_low, t_high) & (F.col("p") == p) & (F.col("q") == q)))


def counts(ds: Dataset) -> DataFrame:
    """(n_rows, n_channels, n_antennas, n_sources, n_present) of a data set in one pass."""
    v = ds.vis
    return v.agg(
        F.count("*").alias("n_products"), F.countDistinct("row_id").alias("n_rows"), F.countDistinct("chan").alias("n_channels"),
        F.countDistinct("source").alias("n_sources"), F.count_if(present(F.col("w"))).alias("n_present"),
        F.size(F.array_distinct(F.concat(F.collect_set("p"), F.collect_set("q")))).alias("n_antennas"),
    )
