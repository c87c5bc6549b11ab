"""Items into containers of fixed capacity by best-fit decreasing (problem 7).

Inside a shard the open containers hang on a segment tree over remaining capacities: leaf r counts the open containers
with r left, and the smallest leaf at or above an item's length is found in log2(capacity) steps. Shards hold about
ITEMS_PER_SHARD documents each, so their number grows with the corpus and a task's work doesn't; a shard leaves at most
a few containers with room, which is the price of packing shards on their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vislake.session import cut

#: Documents that are packed together.
ITEMS_PER_SHARD = 50_000
#: Different container sizes in one call.
MOST_SPECS = 100


class Capacities:
    """Segment tree over remaining capacities 0..capacity; a leaf keeps the containers with exactly that much left."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: dict[int, list[int]] = {}

    def add(self, left: int, container: int) -> None:
        """A container with `left` tokens of room."""
        self.stacks.setdefault(left, []).append(container)
        i = left + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (container, its room) for the smallest room that holds `need`; None if there is none."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            # Up until a right neighbour holds something, then down its left side.
            while True:
                if i == 1:
                    return None
                if not i & 1 and count[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.leaves:
                i <<= 1
                if not count[i]:
                    i += 1
        left = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return self.stacks[left].pop(), left


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, part, container, place, length) for items in the given order of lengths (any order; sorted here, stably).

    An item longer than the capacity is cut into full containers and a rest; no other item is cut. Items of length 0
    take no room and are not in the result.
    """
    out, pieces, containers = [], [], 0
    for item, length in enumerate(lengths.tolist()):
        part = 0
        while length > capacity:
            out.append((item, part, containers, 0, capacity))
            containers, part, length = containers + 1, part + 1, length - capacity
        if length:
            pieces.append((length, item, part))
    pieces.sort(key=lambda p: (-p[0], p[1]))
    tree = Capacities(capacity)
    for length, item, part in pieces:
        found = tree.take(length)
        if found is None:
            found = (containers, capacity)
            containers += 1
        container, left = found
        out.append((item, part, container, capacity - left, length))
        if left > length:
            tree.add(left - length, container)
    return out


def pack(sizes: DataFrame, specs: dict[str, int], items_per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """(spec_id, doc_id, part, container, place, n_tokens): where each document's tokens go, for every container size.

    sizes: doc_id, n_tokens. place is the first token's position in the container; part counts the pieces of a document
    longer than the capacity (0 for all others). Documents without tokens (empty or NULL text) come out once per spec
    with container and place NULL, so the result is whole. Repeated rows are items of their own. No documents: no rows.
    A capacity below 1 is an error.
    """
    if len(specs) > MOST_SPECS or any(c < 1 for c in specs.values()):
        raise ValueError(f"between 0 and {MOST_SPECS} specs with a capacity of at least 1")
    sizes = cut(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")))
    shards = max(1, -(-sizes.count() // items_per_shard))
    if not specs:
        sizes = sizes.where("false")
    names = F.array(*[F.struct(F.lit(k).alias("spec_id"), F.lit(c).alias("capacity")) for k, c in sorted(specs.items())] or [F.struct(F.lit("").alias("spec_id"), F.lit(1).alias("capacity"))])
    items = sizes.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), F.explode(names).alias("s")).select("s.spec_id", "s.capacity", "shard", "doc_id", "n_tokens")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable", ignore_index=True)
        ids, spec, shard = group["doc_id"].to_numpy(), group["spec_id"].iloc[0], int(group["shard"].iloc[0])
        rows = best_fit_decreasing(group["n_tokens"].to_numpy(), int(group["capacity"].iloc[0]))
        at, part, container, place, length = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.array([], np.int64),) * 5
        return pd.DataFrame({"spec_id": spec, "doc_id": ids[at], "part": part, "container": container + (shard << 32), "place": place, "n_tokens": length})

    placed = items.where(F.col("n_tokens") > 0).groupBy("spec_id", "shard").applyInPandas(run, "spec_id string, doc_id bigint, part int, container bigint, place int, n_tokens bigint")
    nothing = items.where(F.col("n_tokens") <= 0).select("spec_id", "doc_id", F.lit(0).alias("part"), F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("int").alias("place"), "n_tokens")
    return placed.unionByName(nothing)
