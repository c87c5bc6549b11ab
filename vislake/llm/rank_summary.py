"""Percentiles of very large columns from mergeable rank-interval summaries (problem 5).

A summary is a sorted list of tuples (value, rmin, rmax): an element of that value has a rank between rmin and rmax.
Chunks of rows become exact summaries (two tuples per run of ties), summaries are pruned to budget + 1 tuples, which adds
at most n / (2 * budget) ranks of uncertainty, and merged without adding any; the sum of what pruning added is kept in the
summary. A summary knows its level in the merge tree, and the budget doubles from level to level, so that the sum stays
within EPSILON * n for any number of levels, combinations of days or sessions included. The tree is built level by level
until one summary a group is left: a task merges about FAN_IN summaries of a group at a time. Everything is deterministic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vislake.session import stored

#: Permitted rank error of a result as a share of n, over all prunings of any merge tree.
EPSILON = 0.005
#: Values that are sorted at once.
CHUNK = 1 << 19
#: Summaries of a group that one task merges at a time.
FAN_IN = 64

FIELDS = "v array<double>, lo array<bigint>, hi array<bigint>, n bigint, err double, level int"


def budget_of(level: int, epsilon: float = EPSILON) -> int:
    """Tuples (less one) kept by a pruning on a level: half of the permitted error is spent on level 0, a quarter on level 1
    and so on, so that the sum stays within epsilon however deep the tree is."""
    return int(np.ceil(2**level / epsilon))


@dataclass(frozen=True)
class Summary:
    """Tuples (v, lo, hi) in order, number of values n, and err: ranks of uncertainty that prunings have added."""

    v: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    n: int
    err: float = 0.0
    level: int = -1  # not pruned yet

    @staticmethod
    def of(values: np.ndarray) -> Summary:
        """Exact summary of sorted values: two tuples for a run of ties (its first and last rank), one otherwise."""
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(values)) - 1
        at = np.unique(np.concatenate([first, last]))
        return Summary(values[at], at + 1, at + 1, len(values))

    def pruned(self, epsilon: float = EPSILON) -> Summary:
        """On the next level, with at most its budget + 1 tuples: for evenly spaced ranks the tuple whose interval is nearest."""
        budget = budget_of(self.level + 1, epsilon)
        if len(self.v) <= budget + 1:
            return replace(self, level=self.level + 1)
        want = 1 + np.arange(budget + 1) * (self.n - 1) / budget
        at = np.unique(self._nearest(want))
        return Summary(self.v[at], self.lo[at], self.hi[at], self.n, self.err + self.n / (2 * budget), self.level + 1)

    def _nearest(self, want: np.ndarray) -> np.ndarray:
        """For each rank the tuple with the least possible distance max(want - lo, hi - want)."""
        middle = (self.lo + self.hi) / 2
        i = np.clip(np.searchsorted(middle, want), 0, len(self.v) - 1)
        best, least = i, np.full(len(want), np.inf)
        for k in (i - 1, i, i + 1):  # lo and hi are both non-decreasing, so the best is next to the crossing
            k = np.clip(k, 0, len(self.v) - 1)
            far = np.maximum(want - self.lo[k], self.hi[k] - want)
            best, least = np.where(far < least, k, best), np.minimum(far, least)
        return best

    def merged(self, other: Summary) -> Summary:
        """Of both inputs' values: ranks add up, with the other side's neighbours as bounds."""

        def ranks(a: Summary, b: Summary, side: str) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(b.v, a.v, side)  # values of b before a's tuple
            low = np.concatenate([[0], b.lo])[at]
            high = np.concatenate([b.hi - 1, [b.n]])[at]
            return a.lo + low, a.hi + high

        lo_a, hi_a = ranks(self, other, "left")
        lo_b, hi_b = ranks(other, self, "right")
        v = np.concatenate([self.v, other.v])
        lo, hi = np.concatenate([lo_a, lo_b]), np.concatenate([hi_a, hi_b])
        order = np.lexsort((hi, lo, v))
        return Summary(v[order], lo[order], hi[order], self.n + other.n, self.err + other.err, max(self.level, other.level))

    def at(self, q: float) -> tuple[float, int, int, float]:
        """Value for the quantile, the bounds of its rank, and how many ranks it may be off at most."""
        want = 1 + q * (self.n - 1)
        i = int(self._nearest(np.array([want]))[0])
        off = float(max(want - self.lo[i], self.hi[i] - want))
        # Between two tuples of one value (a run of ties) every rank has that value.
        below, above = self.v[self.hi <= want], self.v[self.lo >= want]
        if len(below) and len(above) and below[-1] == self.v[i] == above[0]:
            off = 0.0
        return float(self.v[i]), int(self.lo[i]), int(self.hi[i]), off


def merge_all(parts: list[Summary], epsilon: float = EPSILON) -> Summary:
    """Balanced merge of any number of summaries, pruned once at its end."""
    while len(parts) > 1:
        parts = [parts[i].merged(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0].pruned(epsilon)


def summarise(rows: DataFrame, keys: list[str], value: str, epsilon: float = EPSILON) -> DataFrame:
    """Summaries (keys, part, v, lo, hi, n, err, level) of a numeric column per key and chunk of an input partition.

    NULL, NaN and infinite values are left out; a key without other values has no summary. keys must be STRING columns;
    a NULL key is a group of its own. Ties keep their first and last rank. An empty input gives no rows.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                yield chunk(held, part)
                held, size, part = [], 0, part + 1
        if size:
            yield chunk(held, part)

    def chunk(held: list[pa.RecordBatch], part: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        code = np.zeros(t.num_rows, np.int64)
        for k in keys:
            own = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            own = (own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own).indices.to_numpy(zero_copy_only=False).astype(np.int64)
            code = np.unique(code * (own.max() + 1) + own, return_inverse=True)[1]
        x = t.column(value).to_numpy()
        order = np.lexsort((x, code))
        code, x = code[order], x[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        parts = [Summary.of(g).pruned(epsilon) for g in np.split(x, first[1:])]
        return _batch(t.select(keys).take(pa.array(order[first])), keys, parts, {"part": [part] * len(parts)})

    clean = rows.where(F.coalesce(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.lit(False))).select(*keys, F.col(value).cast("double").alias(value))
    return clean.mapInArrow(build, ", ".join(f"`{k}` string" for k in keys) + f", part bigint, {FIELDS}")


def _batch(named: pa.Table, keys: list[str], parts: list[Summary], extra: dict[str, list]) -> pa.RecordBatch:
    """Rows of summaries; the key values are those of `named`."""
    offsets = pa.array(np.append(0, np.cumsum([len(s.v) for s in parts])).astype(np.int32))
    arrays = [named.column(k).combine_chunks().cast(pa.string()) for k in keys]
    arrays = [pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
    arrays += [pa.array(x, pa.int64()) for x in extra.values()]
    arrays += [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([getattr(s, f) for s in parts]))) for f in ("v", "lo", "hi")]
    arrays += [pa.array([s.n for s in parts], pa.int64()), pa.array([float(s.err) for s in parts]), pa.array([s.level for s in parts], pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, names=[*keys, *extra, "v", "lo", "hi", "n", "err", "level"])


def combine(summaries: DataFrame, keys: list[str], epsilon: float = EPSILON) -> DataFrame:
    """One summary per key from all of its summaries (of chunks, sessions or days), level by level.

    While a key has more than FAN_IN summaries, they are merged in groups of about FAN_IN, each by one task. One count of
    summaries a key (not of rows) decides the number of levels.
    """
    if "part" not in summaries.columns:
        # Any number that spreads the summaries of a key, equal ones too; it is fixed by being stored.
        summaries = summaries.withColumn("part", F.monotonically_increasing_id())
    held = stored(summaries.select(*keys, "part", "v", "lo", "hi", "n", "err", "level"))
    counted = held.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    while counted > FAN_IN:
        groups = -(-counted // FAN_IN)
        salt = F.pmod(F.xxhash64("part"), F.lit(groups))
        held = stored(_merged(held.withColumn("salt", salt.cast("string")), [*keys, "salt"], epsilon).withColumn("part", F.col("salt").cast("bigint")).drop("salt"))
        counted = groups
    return _merged(held, keys, epsilon)


def _merged(summaries: DataFrame, keys: list[str], epsilon: float) -> DataFrame:
    """One summary per key in one sorted pass over Arrow batches; a task holds the summaries of one key at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, named, parts, done = None, None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if done:
                yield _batch(pa.concat_tables([k for k, _ in done]), keys, [s for _, s in done], {})
                done.clear()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            at = list(zip(*[t.column(k).to_pylist() for k in keys])) if keys else [()] * t.num_rows
            lists = {f: t.column(f).combine_chunks() for f in ("v", "lo", "hi")}
            lists = {f: (pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c) for f, c in lists.items()}
            offsets = lists["v"].offsets.to_numpy()
            flat = {f: c.values.to_numpy() for f, c in lists.items()}
            n, err, level = (t.column(c).to_pylist() for c in ("n", "err", "level"))
            for i in range(t.num_rows):
                if at[i] != name:
                    if parts:
                        done.append((named, merge_all(parts, epsilon)))
                    name, named, parts = at[i], t.select(keys).slice(i, 1), []
                    if len(done) >= 500:
                        yield from flush()
                span = slice(offsets[i], offsets[i + 1])
                parts.append(Summary(flat["v"][span].copy(), flat["lo"][span].copy(), flat["hi"][span].copy(), n[i], err[i], level[i]))
        if parts:
            done.append((named, merge_all(parts, epsilon)))
        yield from flush()

    spread = summaries.repartition(*keys).sortWithinPartitions(*keys) if keys else summaries.coalesce(1)
    return spread.select(*keys, "v", "lo", "hi", "n", "err", "level").mapInArrow(run, ", ".join(f"`{k}` string" for k in keys) + (", " if keys else "") + FIELDS)


def combined(rows: DataFrame, keys: list[str], value: str, epsilon: float = EPSILON) -> DataFrame:
    """Summary per key of all rows, merged hierarchically."""
    return combine(summarise(rows, keys, value, epsilon), keys, epsilon)


def percentiles(summaries: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """(keys, q, value, n, rank_error, rank_bound): rank_error is what this value may be off at most as a share of n,
    rank_bound what the accumulated prunings permit (err / n plus half a rank)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                s = Summary(np.asarray(r.v), np.asarray(r.lo), np.asarray(r.hi), int(r.n), float(r.err), int(r.level))
                for q in quantiles:
                    value, _, _, off = s.at(q)
                    out.append((*[getattr(r, k) for k in keys], q, value, s.n, off / s.n, (s.err + 0.5) / s.n))
            yield pd.DataFrame(out, columns=[*keys, "q", "value", "n", "rank_error", "rank_bound"])

    return summaries.mapInPandas(run, ", ".join(f"`{k}` string" for k in keys) + (", " if keys else "") + "q double, value double, n bigint, rank_error double, rank_bound double")
