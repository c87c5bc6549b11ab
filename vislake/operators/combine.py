"""Data sets of several files in one (J1, J2): bands side by side, rows joined on their key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def band_plan(channels: dict[str, DataFrame], width: float) -> dict[str, int]:
    """File -> band. Setups of two files must be disjoint or nested; partial overlap and interleaving are errors.

    Channel tables are small (one row a channel) and are compared on the driver.
    """
    sets = {k: {round(r["nu"] / width) for r in c.select("nu").collect()} for k, c in channels.items()}
    bands: list[tuple[set, list[str]]] = []
    for name in sorted(sets, key=lambda n: (-len(sets[n]), n)):
        own = sets[name]
        for have, members in bands:
            if own <= have:
                members.append(name)
                break
            if own & have:
                raise ValueError(f"{name} overlaps {members[0]} in part")
            if max(min(own), min(have)) < min(max(own), max(have)):
                raise ValueError(f"{name} and {members[0]} interleave")
        else:
            bands.append((own, [name]))
    bands.sort(key=lambda b: min(b[0]))
    return {n: k for k, (_, members) in enumerate(bands, 1) for n in members}


def combine(files: dict[str, DataFrame], bands: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(rows, vis) of all files: rows one per (p, q, source, t) with u, v, int_time of the first band that has it, vis with
    a common row number and band (J1). files: vis in long form with p, q, source, t, nu, i, j, re, im, w, u, v, int_time.

    In long form a missing band is simply absent: no padding. Two rows of one key and frequency in one band are an error.
    The row number is a hash of the key, so no global numbering is needed.
    """
    parts = None
    for name, df in files.items():
        p = df.withColumn("band", F.lit(bands[name]))
        parts = p if parts is None else parts.unionByName(p, allowMissingColumns=True)
    key = ["p", "q", "source", "t"]
    row = F.xxhash64(*key).alias("row_id")
    cell = Window.partitionBy(*key, "band", "nu", "i", "j")
    checked = parts.withColumn("__n", F.count("*").over(cell)).withColumn("w", F.when(F.col("__n") > 1, F.raise_error(F.lit("two rows of one key in one band"))).otherwise(F.col("w"))).drop("__n")
    vis = checked.select(row, *key, "band", "nu", "i", "j", "re", "im", "w")
    first = lambda c: F.min_by(c, F.struct("band", "nu", "i", "j")).alias(c)
    rows = checked.groupBy(*key).agg(first("u"), first("v"), first("int_time"), F.countDistinct("band").alias("n_bands")).select(row, *key, "u", "v", "int_time", "n_bands")
    return rows, vis


def in_time_order(rows: DataFrame) -> DataFrame:
    """Rows by time, ties by baseline and source (O1): a range exchange, no single task sorts all."""
    return rows.orderBy("t", "p", "q", "source")


def near_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows closer to the one before than half an integration (J2). rows: keys, t, int_time, row_id."""
    o = Window.partitionBy(*keys).orderBy("t", "row_id")
    return rows.withColumn("gap", F.col("t") - F.lag("t").over(o)).where(F.col("gap") < F.col("int_time") / 2)


def merged_dimension(tables: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Union of dimension tables; a key with conflicting values is an error."""
    u = tables[0].select(key, *columns)
    for t in tables[1:]:
        u = u.unionByName(t.select(key, *columns))
    g = u.groupBy(key).agg(F.count_distinct(F.struct(*columns)).alias("n"), *[F.first(c).alias(c) for c in columns])
    return g.withColumn(key, F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("conflict for "), F.col(key).cast("string")))).otherwise(F.col(key))).drop("n")
