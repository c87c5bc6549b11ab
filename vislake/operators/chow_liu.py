"""A Chow-Liu dependency tree over categorical fields, and posteriors of missing fields by message passing.

Training is one pass: pair counts of all field pairs are summed per input batch with bincount, then across batches; only
the pair tables (their size is bounded by the fields' category counts, not by the rows) reach the driver, where the
maximum spanning tree over mutual information is built. Inference runs per Arrow batch with the tables closed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No more cells than this in all pair tables together may reach the driver (8 MB).
MOST_CELLS = 1_000_000


def pair_counts(rows: DataFrame, fields: dict[str, int], singles: dict[str, int] | None = None) -> dict[tuple[str, ...], np.ndarray]:
    """Counts of every pair of fields over all rows; fields: name -> number of categories (codes 0..n-1).

    singles: further fields of which only the own counts are wanted, by (name,); they come from the same pass. A row counts
    for a pair if both codes are present (not NULL). Empty input: all counts are 0.
    """
    pairs = [*combinations(fields, 2), *[(f, "") for f in singles or {}]]
    width = {**fields, **(singles or {}), "": 1}
    sizes = [width[a] * width[b] for a, b in pairs]
    if sum(sizes) > MOST_CELLS:
        raise ValueError(f"{sum(sizes)} cells in the pair tables; at most {MOST_CELLS}")
    named = [f for f in width if f]
    bases = np.append(0, np.cumsum(sizes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bases[-1], np.int64)
        for batch in batches:
            codes = {f: batch.column(f).fill_null(-1).to_numpy(zero_copy_only=False) for f in named} | {"": np.zeros(batch.num_rows, np.int64)}
            for (a, b), base, size in zip(pairs, bases, sizes):
                both = (codes[a] >= 0) & (codes[b] >= 0)
                total[base : base + size] += np.bincount(codes[a][both].astype(np.int64) * width[b] + codes[b][both], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    summed = rows.select(*[F.col(f).cast("int").alias(f) for f in named]).mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    flat = np.zeros(bases[-1], np.int64)
    for cell, n in summed.collect():  # at most MOST_CELLS rows
        flat[cell] = n
    cells = {p: flat[base : base + size] for p, base, size in zip(pairs, bases, sizes)}
    return {(p if p[1] else p[:1]): x.reshape(width[p[0]], width[p[1]]) if p[1] else x for p, x in cells.items()}


def mutual_information(counts: np.ndarray) -> float:
    """Of the two fields of a count table, in nats; 0 for an empty table."""
    total = counts.sum()
    if not total:
        return 0.0
    p = counts / total
    outer = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    seen = p > 0
    return float((p[seen] * np.log(p[seen] / outer[seen])).sum())


@dataclass(frozen=True)
class Tree:
    """Fields, their category counts and the tree's edges with joint probabilities (smoothed)."""

    fields: dict[str, int]
    edges: list[tuple[str, str, np.ndarray]]

    @staticmethod
    def learn(rows: DataFrame, fields: dict[str, int], smoothing: float = 0.05) -> Tree:
        """Maximum spanning tree over the mutual information of all pairs."""
        return Tree.of(pair_counts(rows, fields), fields, smoothing)

    @staticmethod
    def of(counts: dict[tuple[str, ...], np.ndarray], fields: dict[str, int], smoothing: float = 0.05) -> Tree:
        """The tree of given pair counts."""
        counts = {p: n for p, n in counts.items() if len(p) == 2}
        ranked = sorted(counts, key=lambda p: (-mutual_information(counts[p]), p))
        home = {f: f for f in fields}

        def root(f: str) -> str:
            while home[f] != f:
                f = home[f]
            return f

        edges = []
        for a, b in ranked:
            if root(a) != root(b):
                home[root(a)] = root(b)
                joint = counts[a, b] + smoothing / max(fields[a], fields[b])
                edges.append((a, b, joint / joint.sum()))
        return Tree(dict(fields), edges)

    def _links(self) -> dict[str, list[tuple[str, np.ndarray]]]:
        """Per field its neighbours with P(neighbour | field) as a (field, neighbour) table."""
        links: dict[str, list[tuple[str, np.ndarray]]] = {f: [] for f in self.fields}
        for a, b, joint in self.edges:
            links[a].append((b, joint / joint.sum(1, keepdims=True)))
            links[b].append((a, joint.T / joint.T.sum(1, keepdims=True)))
        return links

    def prior(self, name: str) -> np.ndarray:
        """Marginal of a field."""
        for a, b, joint in self.edges:
            if name in (a, b):
                return joint.sum(1 if name == a else 0)
        return np.full(self.fields[name], 1 / self.fields[name])

    def posterior(self, target: str, evidence: dict[str, np.ndarray], extra: np.ndarray | None = None) -> np.ndarray:
        """P(target | evidence) for every row: codes per field, -1 where unknown. Messages go from the leaves to target.

        extra: the message of one further neighbour of the target that is no field of the tree (rows x categories; 0 rules
        a category out). Rows whose message is all 0 have a posterior of 0.
        """
        links = self._links()
        n = len(next(iter(evidence.values())))

        def message(node: str, parent: str, given: np.ndarray) -> np.ndarray:
            """Likelihood of what lies beyond node for each category of parent; given is P(node | parent)."""
            likely = np.ones((n, self.fields[node]))
            codes = evidence.get(node)
            if codes is not None:
                known = codes >= 0
                likely[known] = 0.0
                likely[np.flatnonzero(known), codes[known]] = 1.0
            for other, table in links[node]:
                if other != parent:
                    likely *= message(other, node, table)
            out = likely @ given.T
            return out / np.maximum(out.max(1, keepdims=True), 1e-300)

        belief = np.tile(self.prior(target), (n, 1))
        for other, table in links[target]:
            belief *= message(other, target, table)
        if extra is not None:
            # What the message allows stays possible, however unlikely the rest makes it.
            belief = np.maximum(belief / np.maximum(belief.sum(1, keepdims=True), 1e-300), 1e-12) * extra
        return belief / np.maximum(belief.sum(1, keepdims=True), 1e-300)
