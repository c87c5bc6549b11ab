"""Joins on time: overlapping intervals, largest overlap, last valid record, bracketing records.

A pure range condition would be planned as a nested loop. Here both sides get time buckets (an interval one row per
bucket that it touches), the join is an equi-join on key and bucket, and the exact condition filters what it yields.
Buckets come in size classes, so that no interval touches more than two of its own.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vislake.session import fresh


#: Buckets of one size class are this many times longer than those of the class below.
CLASS_STEP = 8


def _class_of(lo: Column, hi: Column, width: float) -> Column:
    """Size class of an interval: the least one whose buckets are no shorter, so that it touches two buckets at most."""
    return F.greatest(F.ceil(F.log(float(CLASS_STEP), F.greatest((hi - lo) / width, F.lit(1.0))) - 1e-9), F.lit(0)).cast("int")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: float, how: str = "inner") -> DataFrame:
    """Left intervals [lo, hi] with right intervals [r_lo, r_hi] of equal keys that touch them (closed on both sides).

    how: inner (left and right columns, one row per pair), left_semi or left_anti (each left row at most once). width:
    bucket length in the unit of the bounds, about the length of a typical interval. A pair meets in the buckets of the
    larger of its two size classes, so a long interval costs a row or two per class and not one per bucket. Rows whose bounds
    are NULL or NaN or reversed touch nothing. left needs a unique row_key column for semi and anti joins.
    """
    bucket, size = fresh(left, "bucket"), fresh(left, "size")
    good = lambda lo, hi: F.coalesce((F.col(lo) <= F.col(hi)) & ~F.isnan(hi), F.lit(False))
    a = left.where(good("lo", "hi")).withColumn(f"{size}_l", _class_of(F.col("lo"), F.col("hi"), width))
    b = right.where(good("r_lo", "r_hi")).withColumn(f"{size}_r", _class_of(F.col("r_lo"), F.col("r_hi"), width))
    # Two numbers: the largest classes.
    most = max(x or 0 for x in (a.agg(F.max(f"{size}_l")).first()[0], b.agg(F.max(f"{size}_r")).first()[0]))
    length = lambda c: F.lit(width) * F.pow(F.lit(float(CLASS_STEP)), c)
    at = lambda x: F.floor(x / length(F.col(size))).cast("bigint")
    spread = lambda df, own, lo, hi: df.withColumn(size, F.explode(F.sequence(F.col(own), F.lit(most)))).withColumn(bucket, F.explode(F.sequence(at(F.col(lo)), at(F.col(hi)))))
    touch = (F.col("lo") <= F.col("r_hi")) & (F.col("r_lo") <= F.col("hi"))
    # The first bucket that both share is the one that counts: a pair comes out once.
    once = (F.col(size) == F.greatest(f"{size}_l", f"{size}_r")) & (F.col(bucket) == F.greatest(at(F.col("lo")), at(F.col("r_lo"))))
    pairs = spread(a, f"{size}_l", "lo", "hi").join(spread(b, f"{size}_r", "r_lo", "r_hi"), [*keys, size, bucket]).where(touch & once).drop(bucket, size, f"{size}_l", f"{size}_r")
    if how == "inner":
        return pairs
    return left.join(pairs.select("row_key").distinct(), "row_key", how)


#: Length of a time shard in which intervals are merged, in the unit of the bounds.
MERGE_SHARD = 86_400.0


def merged_intervals(rows: DataFrame, keys: list[str], shard: float = MERGE_SHARD) -> DataFrame:
    """Unions of overlapping or touching [r_lo, r_hi] per key, by the running maximum of ends.

    The maximum runs inside shards of the key's time axis; one row per shard carries it, and the number of unions, across
    shards, so no task sorts a whole key.
    """
    s = rows.where(F.coalesce((F.col("r_lo") <= F.col("r_hi")) & ~F.isnan("r_hi"), F.lit(False))).select(*keys, "r_lo", "r_hi").withColumn("__shard", F.floor(F.col("r_lo") / shard).cast("bigint"))
    across = Window.partitionBy(*keys).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b: reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in [*keys, "__shard"]])
    carry = s.groupBy(*keys, "__shard").agg(F.max("r_hi").alias("__far")).withColumn("__carry", F.max("__far").over(across)).drop("__far")
    inside = Window.partitionBy(*keys, "__shard").orderBy("r_lo", "r_hi")
    both = s.alias("s").join(carry.alias("c"), same("s", "c")).select("s.*", "c.__carry")
    reach = F.greatest(F.max("r_hi").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("__carry"))
    both = both.withColumn("__reach", reach).withColumn("__new", F.when(F.col("__reach").isNull() | (F.col("r_lo") > F.col("__reach")), 1).otherwise(0))
    numbers = both.groupBy(*keys, "__shard").agg(F.sum("__new").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(across), F.lit(0))).drop("__n")
    islands = both.withColumn("__own", F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("s").join(numbers.alias("n"), same("s", "n")).select("s.*", (F.col("n.__base") + F.col("s.__own")).alias("__island"))
    return islands.groupBy(*keys, "__island").agg(F.min("r_lo").alias("r_lo"), F.max("r_hi").alias("r_hi")).drop("__island")


def unflagged(rows: DataFrame, flags: DataFrame, width: float) -> DataFrame:
    """Rows whose [t, t + int_time] touches no flag of either antenna (P3, J3). rows: row_key, a1, a2, lo, hi;
    flags: antenna, r_lo, r_hi. Flags are merged first, so a pile of equal flags costs one interval."""
    merged = merged_intervals(flags, ["antenna"])
    ends = rows.select("row_key", "lo", "hi", F.explode(F.array("a1", "a2")).alias("antenna"))
    hit = overlapping(ends, merged, ["antenna"], width).select("row_key").distinct()
    return rows.join(hit, "row_key", "left_anti")


def largest_overlap(records: DataFrame, cells: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Per record the cell it overlaps most (J4): row_key, cell. records: row_key, lo, hi; cells: cell, r_lo, r_hi.

    Ties go to the smaller cell; an overlap of length 0 counts only for records of length 0, which go to the first cell
    that holds them. Records that overlap nothing do not come out.
    """
    pairs = overlapping(records, cells, keys, width)
    length = F.least("hi", "r_hi") - F.greatest("lo", "r_lo")
    pairs = pairs.withColumn("__len", length).where((F.col("__len") > 0) | (F.col("lo") == F.col("hi")))
    return pairs.groupBy("row_key").agg(F.max_by("cell", F.struct(F.col("__len"), -F.col("cell"))).alias("cell"))


def first_cell(points: DataFrame, cells: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Per point t the first (smallest) closed cell that holds it (G10): row_key, cell."""
    p = points.withColumn("lo", F.col("t")).withColumn("hi", F.col("t"))
    return overlapping(p, cells, keys, width).groupBy("row_key").agg(F.min("cell").alias("cell"))


#: Length of a time shard of one key in the as-of joins, in the unit of t.
ASOF_SHARD = 86_400.0


def _sharded(queries: DataFrame, records: DataFrame, keys: list[str], at: str, record: Column, shard: float) -> DataFrame:
    """Queries and records (as m) in one table with a shard of their key's time axis, so that no task sorts a whole key.

    Every shard also gets the newest record of the shards before it (pos 0) and the oldest of those after it (pos 2): one
    small row per shard finds both.
    """
    kind = records.select(record.alias("m")).schema["m"].dataType
    none = F.lit(None).cast(kind)
    a = queries.select(*keys, F.col("t").alias("t"), "row_key", F.lit(1).alias("is_query"), none.alias("m"))
    b = records.select(*keys, F.col(at).alias("t"), F.lit(None).cast(queries.schema["row_key"].dataType).alias("row_key"), F.lit(0).alias("is_query"), record.alias("m"))
    events = a.unionByName(b).withColumn("shard", F.floor(F.col("t") / shard).cast("bigint")).withColumn("pos", F.lit(1))
    known = F.struct("t", "m")
    has = F.col("m").isNotNull()
    shards = events.groupBy(*keys, "shard").agg(F.min(F.when(has, known)).alias("head"), F.max(F.when(has, known)).alias("tail"))
    order = Window.partitionBy(*keys).orderBy("shard")
    shards = shards.select(*keys, "shard", F.last("tail", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("head", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    border = lambda c, pos: shards.where(F.col(c).isNotNull()).select(*keys, F.col(f"{c}.t").alias("t"), F.lit(None).cast(queries.schema["row_key"].dataType).alias("row_key"), F.lit(0).alias("is_query"), F.col(f"{c}.m").alias("m"), "shard", F.lit(pos).alias("pos"))
    return events.unionByName(border("before", 0)).unionByName(border("after", 2))


def last_valid(queries: DataFrame, records: DataFrame, keys: list[str], payload: list[str], shard: float = ASOF_SHARD) -> DataFrame:
    """For each query (keys, t, row_key) the last record (keys, start, duration, payload) with start <= t, if
    t - start < duration (J5). Others come out with NULL payload. Of records with equal start the last by payload counts.

    One union sorted by (keys, shard, time): both sides are shuffled once, nothing is multiplied. NULL keys match each
    other; a NULL t matches nothing.
    """
    mark = F.struct(F.col("start"), F.col("duration"), *[F.col(c) for c in payload])
    both = _sharded(queries, records.where(F.col("start").isNotNull()), keys, "start", mark, shard)
    order = Window.partitionBy(*keys, "shard").orderBy("pos", "t", "is_query", "m").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("last", F.last("m", ignorenulls=True).over(order)).where("is_query = 1")
    valid = F.col("t") - F.col("last.start") < F.col("last.duration")
    return seen.select(*keys, "t", "row_key", *[F.when(valid, F.col(f"last.{c}")).alias(c) for c in ["start", *payload]])


def bracketing(queries: DataFrame, series: DataFrame, keys: list[str], shard: float = ASOF_SHARD) -> DataFrame:
    """Linear interpolation of a series (keys, s, x) at each query (keys, t, row_key), held constant outside it."""
    both = _sharded(queries, series.where(F.col("s").isNotNull()), keys, "s", F.struct(F.col("s").alias("s"), F.col("x").alias("x")), shard)
    order = Window.partitionBy(*keys, "shard").orderBy("pos", "t", "is_query")
    both = both.withColumn("a", F.last("m", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first("m", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    w = F.try_divide(F.col("t") - F.col("a.s"), F.col("b.s") - F.col("a.s"))
    x = F.when(F.col("a").isNull(), F.col("b.x")).when(F.col("b").isNull() | (F.col("a.s") == F.col("t")), F.col("a.x")).otherwise(F.col("a.x") + (F.col("b.x") - F.col("a.x")) * w)
    return both.where("is_query = 1").select(*keys, "t", "row_key", x.alias("x"))


def horner(coefficients: Column, x: Column) -> Column:
    """Polynomial with ascending coefficients (F16)."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: acc * x + c)
