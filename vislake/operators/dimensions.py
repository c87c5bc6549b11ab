"""Names, ends of baselines, set operations and quantiles per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vislake.session import bounded


def dense_names(rows: DataFrame, names: list[str], within: list[str], registry: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """(within, name, keep, ix): the different names of some columns, numbered from 1 in their order inside each group, with
    what a registry says about them; unknown names have NULL there (J7). NULL names are left out.

    registry: one row per key. The windows run over a group's different names, which the registry bounds.
    """
    each = rows.select(*within, F.explode(F.array(*names)).alias("name")).where(F.col("name").isNotNull()).distinct()
    known = bounded(registry.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in keep]))
    full = each.join(known, F.col("name") == F.col("__key"), "left")
    o = Window.partitionBy(*within).orderBy("name") if within else Window.orderBy("name")
    return full.select(*within, "name", *[F.col(f"__{c}").alias(c) for c in keep], F.dense_rank().over(o).alias("ix"))


def endpoints(rows: DataFrame, registry: DataFrame, key: str, columns: list[str], ends: tuple[str, str] = ("a1", "a2")) -> DataFrame:
    """rows with a registry's columns for both ends of a baseline, suffixed 1 and 2 (J8): two look-ups of one small table. Rows
    with an end that is not there are left out."""
    for n, end in enumerate(ends, 1):
        side = bounded(registry.select(F.col(key).alias(f"__{end}"), *[F.col(c).alias(f"{c}{n}") for c in columns]))
        rows = rows.join(side, F.col(end) == F.col(f"__{end}")).drop(f"__{end}")
    return rows


def quantiles(rows: DataFrame, by: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column per share, n): exact quantiles with linear interpolation (A24). NULLs don't count; for groups too large
    for one buffer take llm.rank_summary."""
    return rows.groupBy(*by).agg(*[F.percentile(x, q).alias(name) for name, q in shares.items()], F.count(x).alias("n"))


def longest(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """rows with rank: the first k of every group in an order that has no ties (O5). Spark keeps only k rows of a group per
    partition before it exchanges any."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def tagged_union(tables: dict[str, DataFrame], columns: list[str], tag: str = "tab") -> DataFrame:
    """Rows of several tables in one, with their table's name."""
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias(tag), *columns)
        out = part if out is None else out.unionByName(part)
    return out


def common(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Different values that both tables have (O8); NULLs are equal."""
    return a.select(*columns).intersect(b.select(*columns))


def missing(expected: DataFrame, names: list[DataFrame]) -> DataFrame:
    """Different expected values that none of the others has (O9); NULLs are equal."""
    seen = names[0]
    for n in names[1:]:
        seen = seen.union(n)
    return expected.subtract(seen)


def first_by(rows: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Per group the given columns of the row that comes first."""
    return rows.groupBy(*by).agg(*[F.min_by(c, order).alias(c) for c in columns], F.min(order).alias(order))
