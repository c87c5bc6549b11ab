"""Partitions of the time and frequency axes: the cells that later steps group by.

A partition is two tables: cells (cell, lo, hi, ref) and a lookup (axis item -> cell). Cells are numbered from 1 in the
order of their support. The cell tables are small next to the data, but nothing here relies on that: all are joins and
windows over per-item (time, scan) tables that were made distinct first, never over raw visibilities, and in shards.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Partition:
    """item: the lookup's key column ("t", "scan" or "chan")."""

    cells: DataFrame
    lookup: DataFrame
    item: str

    def n_cells(self) -> int:
        """Number of cells."""
        return self.cells.count()

    def supports(self) -> DataFrame:
        """(cell, lo, hi)."""
        return self.cells.select("cell", "lo", "hi")

    def references(self) -> DataFrame:
        """(cell, ref)."""
        return self.cells.select("cell", "ref")


#: A partition strategy (X9): a callable from the axis' table (rows of scan and t, or channels) to a Partition. Own ones go
#: into STRATEGIES, or are given to time_mode and frequency_mode in place of a name.
Strategy = Callable[[DataFrame], Partition]
#: A scan strategy (X10): a callable from distinct times (t, source) to the same rows with scan.
ScanStrategy = Callable[[DataFrame], DataFrame]


def gap_scans(min_gap: float, by_source: bool = True) -> ScanStrategy:
    """Scans by gaps in time and changes of source."""
    return lambda times: scans_by_gap(times, min_gap, ["source"] if by_source else [])


def listed_scans(starts: list[float]) -> ScanStrategy:
    """Scans that begin at given times (ascending); earlier times belong to scan 0."""
    return lambda times: times.withColumn("scan", F.size(F.filter(F.array(*[F.lit(float(x)) for x in starts]), lambda x: x <= F.col("t"))))


#: Length of a time shard in which scan borders are found, in s.
SCAN_SHARD = 86_400.0


def scans_by_gap(times: DataFrame, min_gap: float, keys: list[str] | None = None, shard: float = SCAN_SHARD, series: list[str] | None = None) -> DataFrame:
    """Adds scan (from 1): a new one starts where the time since the previous row is above min_gap.

    With keys (for instance source), scans never span two of their values in time order. times is one row per distinct
    time; ties in t share a scan unless a key changes. NULL times are left out. Empty in, empty out. With series (for instance
    the baseline), each of their values has its own times and its own numbers from 1.

    Borders are found inside time shards; one row per shard carries the last row and the number of scans across shards, so
    no task sorts all times.
    """
    keys, series = keys or [], series or []
    row = F.struct("t", *keys)
    s = times.where(F.col("t").isNotNull()).withColumn("__shard", F.floor(F.col("t") / shard).cast("bigint")).withColumn("__row", row)
    inside = Window.partitionBy(*series, "__shard").orderBy("t", *keys)

    def breaks(now: str, before: str) -> Column:
        new = F.col(f"{now}.t") - F.col(f"{before}.t") > min_gap
        for k in keys:
            new = new | ~F.col(f"{now}.{k}").eqNullSafe(F.col(f"{before}.{k}"))
        return new

    s = s.withColumn("__before", F.lag("__row").over(inside))
    s = s.withColumn("__new", F.when(F.col("__before").isNotNull() & breaks("__row", "__before"), 1).otherwise(0))
    ends = s.groupBy(*series, "__shard").agg(F.min("__row").alias("head"), F.max("__row").alias("tail"), F.sum("__new").alias("n"))
    across = Window.partitionBy(*series).orderBy("__shard") if series else Window.orderBy("__shard")
    ends = ends.withColumn("prev", F.lag("tail").over(across)).withColumn("opens", F.when(F.col("prev").isNull() | breaks("head", "prev"), 1).otherwise(0))
    total = F.sum(F.col("n") + F.col("opens")).over(across.rowsBetween(Window.unboundedPreceding, -1))
    base = ends.select(*[F.col(c).alias(f"__{c}") for c in series], F.col("__shard").alias("__at"), (F.coalesce(total, F.lit(0)) + F.col("opens")).alias("__base"))
    # A range frame: ties share the sum, in whatever order they come.
    s = s.withColumn("__own", F.sum("__new").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    same = F.col("__shard") == F.col("__at")
    for c in series:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return s.join(base, same).withColumn("scan", (F.col("__base") + F.col("__own")).cast("int")).select(*times.columns, "scan")


def whole(times: DataFrame) -> Partition:
    """One cell over all times."""
    cells = times.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).select(F.lit(1).alias("cell"), "lo", "hi", ((F.col("lo") + F.col("hi")) / 2).alias("ref"))
    return Partition(cells, times.select("t").distinct().withColumn("cell", F.lit(1)), "t")


#: Scans and times that one task numbers.
SCANS_AT_ONCE = 65_536


def _numbered(cells: DataFrame, by: str, width: float | None = None, amount: str | None = None) -> DataFrame:
    """Adds cell: the number of each row in order of the distinct column `by`, from 1. With amount, a row stands for that
    many cells and `base` is the number of those before it.

    Rows are numbered inside shards of `width`; one row per shard carries the number of those before it. Without a width
    (channels and frequency windows, which are few) there is one shard.
    """
    count = F.col(amount) if amount else F.lit(1)
    at = F.floor(F.col(by) / width).cast("bigint") if width else F.lit(0).cast("bigint")
    s = cells.withColumn("__shard", at)
    inside = Window.partitionBy("__shard").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    before = s.groupBy("__shard").agg(F.sum(count).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(across), F.lit(0))).drop("__n")
    s = s.withColumn("__own", F.coalesce(F.sum(count).over(inside), F.lit(0))).join(before, "__shard")
    return s.withColumn("base" if amount else "cell", (F.col("__before") + F.col("__own") + (0 if amount else 1)).cast("int")).drop("__shard", "__own", "__before")


def by_scan(rows: DataFrame) -> Partition:
    """A cell per scan id, in id order, over the extrema of its times."""
    cells = _numbered(rows.where(F.col("scan").isNotNull()).groupBy("scan").agg(F.min("t").alias("lo"), F.max("t").alias("hi")), "scan", SCANS_AT_ONCE).withColumn("ref", (F.col("lo") + F.col("hi")) / 2)
    return Partition(cells.select("cell", "lo", "hi", "ref"), cells.select("scan", "cell"), "scan")


def by_duration(rows: DataFrame, d: float) -> Partition:
    """Each scan cut into n = max(round((hi - lo) / d), 1) equal cells (G4). rows: scan, t."""
    spans = rows.groupBy("scan").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).withColumn("n", F.greatest(F.rint((F.col("hi") - F.col("lo")) / d), F.lit(1.0)).cast("int"))
    spans = _numbered(spans, "scan", SCANS_AT_ONCE, "n").withColumn("width", (F.col("hi") - F.col("lo")) / F.col("n"))
    k = F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")
    cells = spans.select("base", "lo", "width", k).select((F.col("base") + F.col("k")).alias("cell"), (F.col("lo") + (F.col("k") - 1) * F.col("width")).alias("lo"), (F.col("lo") + F.col("k") * F.col("width")).alias("hi"))
    times = rows.select("scan", "t").distinct().join(spans, "scan")
    sub = F.least(F.greatest(F.coalesce(F.floor(F.try_divide(F.col("t") - F.col("lo"), F.col("width"))), F.lit(0)) + 1, F.lit(1)), F.col("n"))
    return Partition(cells.withColumn("ref", (F.col("lo") + F.col("hi")) / 2), times.select("scan", "t", (F.col("base") + sub).cast("int").alias("cell")), "t")


def by_edges(times: DataFrame, edges: list[float]) -> Partition:
    """Given edges; the last one is inclusive, a time outside is an error."""
    if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError("at least two strictly increasing edges")
    spark = times.sparkSession
    cells = spark.createDataFrame([(k + 1, float(a), float(b), (a + b) / 2) for k, (a, b) in enumerate(zip(edges, edges[1:]))], "cell int, lo double, hi double, ref double")
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col("t")))
    inside = F.col("t").between(edges[0], edges[-1])
    cell = F.when(inside, F.least(F.greatest(at, F.lit(1)), F.lit(len(edges) - 1))).otherwise(F.raise_error(F.concat(F.lit("time outside the edges: "), F.col("t").cast("string"))))
    return Partition(cells, times.select("t").distinct().withColumn("cell", cell.cast("int")), "t")


def by_window(channels: DataFrame) -> Partition:
    """A cell per frequency window over its channels' extrema."""
    cells = _numbered(channels.groupBy("if_id").agg(F.min("nu").alias("lo"), F.max("nu").alias("hi")), "if_id").withColumn("ref", (F.col("lo") + F.col("hi")) / 2)
    return Partition(cells.select("cell", "lo", "hi", "ref"), channels.join(cells.select("if_id", "cell"), "if_id").select("chan", "cell"), "chan")


def by_channel(channels: DataFrame, width: float) -> Partition:
    """A cell per channel, half a width to either side."""
    cells = _numbered(channels, "chan").select("chan", "cell", (F.col("nu") - width / 2).alias("lo"), (F.col("nu") + width / 2).alias("hi"), F.col("nu").alias("ref"))
    return Partition(cells.select("cell", "lo", "hi", "ref"), cells.select("chan", "cell"), "chan")


def whole_band(channels: DataFrame) -> Partition:
    """One frequency cell (G2 on the frequency axis)."""
    cells = channels.agg(F.min("nu").alias("lo"), F.max("nu").alias("hi")).select(F.lit(1).alias("cell"), "lo", "hi", ((F.col("lo") + F.col("hi")) / 2).alias("ref"))
    return Partition(cells, channels.select("chan", F.lit(1).alias("cell")), "chan")


def containing(fine: DataFrame, coarse: DataFrame, items: list[str]) -> DataFrame:
    """(fine, coarse, n_coarse) of two lookups over the same items; a refinement has n_coarse = 1 everywhere."""
    both = fine.select(*items, F.col("cell").alias("fine")).join(coarse.select(*items, F.col("cell").alias("coarse")), items)
    return both.groupBy("fine").agg(F.min("coarse").alias("coarse"), F.countDistinct("coarse").alias("n_coarse"))


def refines(fine: DataFrame, coarse: DataFrame, items: list[str]) -> bool:
    """Whether every fine cell lies in one coarse cell."""
    return containing(fine, coarse, items).where("n_coarse > 1").isEmpty()


def coarsen(fine: Partition, into: DataFrame, n: int) -> DataFrame:
    """(cell, new_cell, lo, hi): blocks of n consecutive fine cells inside each container.

    into: (fine, coarse) as containing() gives it, for a refinement.
    """
    order = Window.partitionBy("coarse").orderBy("fine")
    numbered = into.withColumn("block", F.floor((F.row_number().over(order) - 1) / n).cast("int"))
    per = numbered.groupBy("coarse").agg((F.max("block") + 1).alias("__blocks"))
    blocks = _numbered(per, "coarse", SCANS_AT_ONCE, "__blocks").select("coarse", "base")
    cells = numbered.join(blocks, "coarse").withColumn("new_cell", F.col("base") + F.col("block") + 1).join(fine.cells, F.col("fine") == F.col("cell"))
    w = Window.partitionBy("new_cell")
    return cells.select("cell", "new_cell", F.min("lo").over(w).alias("lo"), F.max("hi").over(w).alias("hi"))


def regroup(windows: Partition, groups: list[list[int]]) -> Partition:
    """Frequency windows put into groups; each must be in exactly one."""
    given = sorted(c for g in groups for c in g)
    have = sorted(r[0] for r in windows.cells.select("cell").collect())  # one row per frequency window
    if given != have:
        raise ValueError(f"every window must be in exactly one group: {given} and {have}")
    to = F.create_map(*[F.lit(x) for g, cells in enumerate(groups, 1) for c in cells for x in (c, g)])
    cells = windows.cells.groupBy(to[F.col("cell")].alias("cell")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("ref", (F.col("lo") + F.col("hi")) / 2)
    return Partition(cells, windows.lookup.withColumn("cell", to[F.col("cell")]), "chan")


def fixed_cells(t: Column, t0: Column, step: float) -> Column:
    """Number of the cell of fixed length since t0, from 1."""
    return (F.floor((t - t0) / step) + 1).cast("int")


#: Names of the partition modes that the inspector offers (G12): axis -> mode.
MODES = {"time": ("scan", "whole", "integration", "custom"), "frequency": ("channel", "window", "band")}


#: Own strategies by name.
STRATEGIES: dict[str, Strategy] = {}


def time_mode(rows: DataFrame, mode: str | Strategy, custom: float | None = None) -> Partition:
    """Time partition by mode (G12) or own strategy (X9); rows: scan, t."""
    if callable(mode) or mode in STRATEGIES:
        return (mode if callable(mode) else STRATEGIES[mode])(rows)
    if mode == "scan":
        return by_scan(rows)
    if mode == "whole":
        return whole(rows)
    if mode == "integration":
        cells = _numbered(rows.where(F.col("t").isNotNull()).select("t").distinct(), "t", SCAN_SHARD)
        return Partition(cells.select("cell", F.col("t").alias("lo"), F.col("t").alias("hi"), F.col("t").alias("ref")), cells.select("t", "cell"), "t")
    if mode == "custom" and custom:
        return by_duration(rows, custom)
    raise ValueError(f"mode {mode!r} of {MODES['time']}")


def frequency_mode(channels: DataFrame, mode: str | Strategy, width: float = 1.0) -> Partition:
    """Frequency partition by mode (G12) or own strategy."""
    if callable(mode) or mode in STRATEGIES:
        return (mode if callable(mode) else STRATEGIES[mode])(channels)
    if mode == "channel":
        return by_channel(channels, width)
    if mode == "window":
        return by_window(channels)
    if mode == "band":
        return whole_band(channels)
    raise ValueError(f"mode {mode!r} of {MODES['frequency']}")
