"""Merging of covered stretches of time into periods and gaps (problem 3).

A cover is a half-open stretch [start, end) of whole microseconds. Each time shard of an entity has a compressed
bitmap: the set microseconds as sorted, disjoint, non-touching runs, held as two arrays. Bitmaps are built from the
rows inside each input batch (before any shuffle), brought together by (entity, shard) and united in one sorted pass
over Arrow batches; runs belong to the shard in which they start and may reach beyond it. Set runs and clear runs that
cross shards are closed with one small row per shard, so no task holds a whole entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vislake.session import stored

#: Length of a time shard in microseconds (half an hour).
SHARD_US = 1800 * 1_000_000

PERIOD, GAP = "period", "gap"


def united(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal unions of [start, end) per group; touching stretches join, stretches of length 0 are kept.

    group must be ascending integers; order inside a group is free.
    """
    if not len(group):
        return group, start, end
    order = np.lexsort((end, start, group))
    group, start, end = group[order], start[order], end[order]
    # Running maximum of the end inside each group: over ranks, with groups stacked above one another.
    levels, rank = np.unique(end, return_inverse=True)
    top = np.maximum.accumulate(group.astype(np.int64) * len(levels) + rank) % len(levels)
    reach = levels[top]
    fresh = np.ones(len(group), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(group)) - 1
    return group[first], start[first], reach[last]


def _coded(batch: pa.Table, names: list[str]) -> np.ndarray:
    """One integer per row, equal for equal values of the named columns (NULL equals NULL)."""
    code = np.zeros(batch.num_rows, np.int64)
    for name in names:
        column = batch.column(name).combine_chunks()
        column = column.dictionary_encode(null_encoding="encode")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        own = column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    return code


def _bitmaps(rows: pa.Table, keys: list[str], schema: pa.Schema, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row per group with its run arrays; the keys' values come from the group's first row in rows."""
    names, sample = np.unique(group, return_index=True)
    g, s, e = united(group, start, end)
    offsets = np.append(np.searchsorted(g, names), len(g)).astype(np.int32)
    values = rows.select(keys).take(pa.array(sample))
    columns = [values.column(k).combine_chunks() for k in keys] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (s, e)]
    columns = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def shard_bitmaps(covers: DataFrame, keys: list[str], shard_us: int = SHARD_US) -> DataFrame:
    """(keys, shard, starts, ends): the run bitmap of each (entity, shard). covers: keys, start_us, end_us."""
    sharded = covers.withColumn("shard", F.floor(F.col("start_us") / shard_us).cast("bigint")).select(*keys, "shard", "start_us", "end_us")
    types = {f.name: f.dataType for f in sharded.schema.fields}
    out = ", ".join(f"`{k}` {types[k].simpleString()}" for k in [*keys, "shard"]) + ", starts array<bigint>, ends array<bigint>"
    by = [*keys, "shard"]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(out))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                yield _bitmaps(t, by, schema, _coded(t, by), t.column("start_us").to_numpy(), t.column("end_us").to_numpy())

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            held = None
            if not t.num_rows:
                continue
            code = _coded(t, by)
            cut = int(np.argmax(code == code[-1]))  # rows are sorted: the last entity and shard may go on in the next batch
            done, held = _joined(t.slice(0, cut), by, schema, code[:cut]), _joined(t.slice(cut), by, schema, code[cut:])
            if done is not None:
                yield done
            held = pa.Table.from_batches([held])
        if held is not None:
            yield held.to_batches()[0]

    local = sharded.mapInArrow(build, out)
    return local.repartition(*by).sortWithinPartitions(*by).mapInArrow(unite, out)


def _joined(rows: pa.Table, by: list[str], schema: pa.Schema, code: np.ndarray) -> pa.RecordBatch | None:
    """Bitmaps of equal (entity, shard) united."""
    if not rows.num_rows:
        return None
    starts, ends = rows.column("starts").combine_chunks(), rows.column("ends").combine_chunks()
    group = np.repeat(code, pc.list_value_length(starts).to_numpy(zero_copy_only=False))
    first = np.unique(code, return_index=True)[1]
    g, s, e = united(group, starts.flatten().to_numpy(), ends.flatten().to_numpy())
    names = np.unique(code)
    offsets = np.append(np.searchsorted(g, names), len(g)).astype(np.int32)
    values = rows.select(by).take(pa.array(first))
    columns = [values.column(k).combine_chunks() for k in by] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (s, e)]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def runs_and_gaps(covers: DataFrame, keys: list[str], shard_us: int = SHARD_US) -> DataFrame:
    """(keys, kind, start_us, end_us): maximal periods and the gaps between consecutive periods of each entity.

    covers: keys, start_us and end_us BIGINT with start <= end. Rows with a NULL bound or start > end cover nothing.
    Touching covers join; covers of length 0 are periods when they stand alone. NULL keys are entities of their own.
    Repeated rows change nothing; an empty input gives an empty result; other columns are ignored.
    """
    renamed = [f"key{i}" for i in range(len(keys))]
    clean = covers.where(F.col("start_us") <= F.col("end_us")).select(*[F.col(c).alias(r) for c, r in zip(keys, renamed)], "start_us", "end_us")
    maps = shard_bitmaps(clean, renamed, shard_us)
    entity = Window.partitionBy(*renamed).orderBy("shard")
    earlier = maps.select(*renamed, "shard", F.array_max("ends").alias("reach")).select(*renamed, "shard", F.max("reach").over(entity.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    condition = F.lit(True)
    a, b = maps.alias("a"), earlier.alias("b")
    for c in [*renamed, "shard"]:
        condition = condition & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    runs = F.arrays_zip(F.col("a.starts"), F.col("a.ends"))
    seen = a.join(b, condition).select(*[F.col(f"a.{c}").alias(c) for c in [*renamed, "shard"]], "carry", runs.alias("runs"))
    low = F.coalesce(F.col("carry"), F.lit(-(2**63)))
    is_new = lambda r: F.col("carry").isNull() | (r["starts"] > low)
    seen = seen.select(*renamed, "shard", "carry", F.filter("runs", is_new).alias("new"), F.greatest("carry", F.array_max(F.transform(F.filter("runs", lambda r: ~is_new(r)), lambda r: r["ends"]))).alias("reach"))
    # Two uses below.
    seen = stored(seen)
    inner = seen.where(F.size("new") > 1).select(
        *renamed,
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(1), F.size("new") - 1),
                    lambda i: F.array(
                        F.struct(F.lit(PERIOD).alias("kind"), F.element_at("new", i)["starts"].alias("start_us"), F.element_at("new", i)["ends"].alias("end_us")),
                        F.struct(F.lit(GAP).alias("kind"), F.element_at("new", i)["ends"].alias("start_us"), F.element_at("new", i + 1)["starts"].alias("end_us")),
                    ),
                )
            )
        ).alias("x"),
    )
    # Shards without a new run only pass their reach on; the last new run of a shard ends where the next new one's
    # predecessors reach to.
    whole = Window.partitionBy(*renamed)
    opened = seen.select(*renamed, "shard", "reach", F.size("new").alias("n"), F.try_element_at("new", F.lit(1))["starts"].alias("first_start"), F.try_element_at("new", F.lit(-1))["starts"].alias("last_start"), F.try_element_at("new", F.lit(-1))["ends"].alias("last_end"))
    opened = opened.withColumn("total", F.max(F.greatest("reach", "last_end")).over(whole)).where(F.col("n") > 0)
    closing = opened.select(*renamed, "last_start", F.coalesce(F.lead("reach").over(entity), F.col("total")).alias("end_us"), F.lead("first_start").over(entity).alias("next_start"))
    edges = closing.select(
        *renamed,
        F.explode(
            F.concat(
                F.array(F.struct(F.lit(PERIOD).alias("kind"), F.col("last_start").alias("start_us"), F.col("end_us").alias("end_us"))),
                F.when(F.col("next_start").isNotNull(), F.array(F.struct(F.lit(GAP).alias("kind"), F.col("end_us").alias("start_us"), F.col("next_start").alias("end_us")))).otherwise(F.array()),
            )
        ).alias("x"),
    )
    return inner.unionByName(edges).select(*[F.col(r).alias(c) for c, r in zip(keys, renamed)], "x.kind", "x.start_us", "x.end_us")
