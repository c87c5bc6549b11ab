"""References to records that do not exist (problem 4).

Direct orphans are rows whose key has no registered record at the row's time. Registries are reduced to one row per key
with the list of its validity stretches, so a lookup never multiplies rows and a hot key stays one row on that side.
Inherited orphans come from a fixpoint over the foreign-key graph: in each round the children of the rows found in
the round before are found by semi-joins on the keys of that frontier, until a round finds none. A table that has parents
is written once with its id, time and keys; found rows carry their keys, so no round goes back to a parent's table.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vislake.session import bounded, micros, stored

#: Characters that count as outer blanks of a text key.
BLANKS = " \t\r\n 　"

MISSING, DELETED, LATER, INHERITED = "missing", "deleted", "later", "inherited"
DIRECT_KIND, INHERITED_KIND = "direct", "inherited"


def text_key(c: Column) -> Column:
    """A text key without outer blanks and case; NULL if nothing is left."""
    key = F.upper(F.trim(c, F.lit(BLANKS)))
    return F.when(key != "", key)


@dataclass(frozen=True)
class Registry:
    """Records that others refer to: key columns (any of them names the record) and validity [added, removed).

    Without added the records hold at all times."""

    rows: DataFrame
    keys: list[Column]
    added: str | None = "added_at"
    removed: str | None = "removed_at"

    def by_key(self) -> DataFrame:
        """One row per key with the list of its validity stretches in microseconds."""
        always = F.lit(-(1 << 62)).cast("bigint")
        added = micros(F.col(self.added)) if self.added else always
        removed = micros(F.col(self.removed)) if self.removed and self.added else F.lit(None).cast("bigint")
        each = self.rows.select(F.array_distinct(F.array(*self.keys)).alias("keys"), added.alias("added"), removed.alias("removed"))
        each = each.select(F.explode("keys").alias("ref_key"), "added", "removed").where(F.col("ref_key").isNotNull())
        return each.groupBy("ref_key").agg(F.collect_set(F.struct("added", "removed")).alias("valid"))


@dataclass(frozen=True)
class Child:
    """A table whose rows refer to records: row id, time, the key into a registry, and its links to parent tables.

    parents: name of the parent table -> (columns of this table, columns of the parent) that must be equal. more: further
    (registry, key) references of the row.
    """

    rows: DataFrame
    row_id: str
    time: str
    registry: str | None = None
    key: Column | None = None
    parents: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)
    more: tuple[tuple[str, Column], ...] = ()

    def references(self) -> list[tuple[str, Column]]:
        return ([(self.registry, self.key)] if self.registry else []) + list(self.more)


def _judged(child: Child, registries: dict[str, Registry], carried: list[str]) -> DataFrame:
    """(row_id, t_us, reason, k_... carried columns) of the rows with a key that is not registered at their time: one scan,
    one look-up per reference; of several reasons the first of missing, deleted, later."""
    refs = [(registries[name].by_key(), key) for name, key in child.references()]
    rows = child.rows.select(
        F.col(child.row_id).alias("row_id"), micros(F.col(child.time)).alias("t_us"), *[F.col(c).alias(f"k_{c}") for c in carried],
        *[key.cast(known.schema["ref_key"].dataType).alias(f"ref{i}") for i, (known, key) in enumerate(refs)],
    )
    rows = rows.where(reduce(or_, [F.col(f"ref{i}").isNotNull() for i in range(len(refs))]))
    t, rank = F.col("t_us"), []
    for i, (known, _) in enumerate(refs):
        rows = rows.join(bounded(known.select(F.col("ref_key").alias(f"ref{i}"), F.col("valid").alias(f"valid{i}"))), f"ref{i}", "left")
        valid = F.col(f"valid{i}")
        there = F.exists(valid, lambda v: (v["added"] <= t) & (v["removed"].isNull() | (t < v["removed"])))
        before = F.exists(valid, lambda v: v["added"] <= t)
        held = t.isNull() | F.coalesce(there, F.lit(False))
        rank.append(F.when(F.col(f"ref{i}").isNull(), 3).when(valid.isNull(), 0).when(held, 3).when(F.coalesce(before, F.lit(False)), 1).otherwise(2))
    worst = F.least(*rank) if len(rank) > 1 else rank[0]
    reason = F.element_at(F.array(*[F.lit(x) for x in (MISSING, DELETED, LATER)]), F.col("worst") + 1)
    return rows.withColumn("worst", worst).where(F.col("worst") < 3).select("row_id", "t_us", reason.alias("reason"), *[f"k_{c}" for c in carried])


def direct_orphans(child: Child, registry: Registry) -> DataFrame:
    """(row_id, t_us, reason) of the rows whose key is not registered at their time.

    A NULL key refers to nothing and is no case. reason: missing = the key has no record at all; deleted = a record of
    the key was added at or before the time; later = all were added after it. A row with a NULL time is a case only if
    its key is missing; records with a NULL added time never hold. Repeated rows give repeated cases.
    """
    return _judged(replace(child, registry="r", more=()), {"r": registry}, [])


def cascade(children: dict[str, Child], registries: dict[str, Registry], most_rounds: int = 64) -> DataFrame:
    """(tab, row_id, t_us, kind, reason, depth): direct orphans at depth 0, rows orphaned through a parent deeper.

    A row is inherited if a parent row that it refers to is an orphan and it is none itself; it has the least depth at
    which it was reached. Cycles in the graph end because a round only keeps rows not found before; most_rounds guards
    against a graph that is deeper than anyone means (error, nothing is dropped). Empty tables give no rows.
    """
    named = lambda df, tab, kind, reason, depth: df.select(F.lit(tab).alias("tab"), "row_id", "t_us", F.lit(kind).alias("kind"), reason.alias("reason"), F.lit(depth).alias("depth"))
    # Columns by which a table's rows hang on parents or are hung on.
    links: dict[str, list[str]] = {n: [] for n in children}
    for n, c in children.items():
        for parent, (own, theirs) in c.parents.items():
            links[n] += [x for x in own if x not in links[n]]
            links[parent] += [x for x in theirs if x not in links[parent]]
    frontier = {n: stored(_judged(c, registries, links[n])) for n, c in children.items() if c.references()}
    found = {n: [df.select("row_id")] for n, df in frontier.items()}
    results = [named(df, n, DIRECT_KIND, F.col("reason"), 0) for n, df in frontier.items()]
    tables = {n: stored(c.rows.select(F.col(c.row_id).alias("row_id"), micros(F.col(c.time)).alias("t_us"), *[F.col(x).alias(f"k_{x}") for x in links[n]])) for n, c in children.items() if c.parents}
    for depth in range(1, most_rounds + 1):
        frontier = {n: df for n, df in frontier.items() if not df.isEmpty()}
        new = {}
        for n, c in children.items():
            hits = []
            for parent, (own, theirs) in c.parents.items():
                if parent in frontier:
                    # No hints: the frontier grows with the data, so Spark chooses by its measured size.
                    keys = frontier[parent].select(*[F.col(f"k_{y}").alias(f"k_{x}") for x, y in zip(own, theirs)]).distinct()
                    hits.append(tables[n].join(keys, [f"k_{x}" for x in own], "left_semi").select(tables[n].columns))
            if hits:
                reached = _all(hits).distinct()
                known = _all(found[n]) if n in found else None
                new[n] = stored(reached.join(known, "row_id", "left_anti") if known is not None else reached)
        if not new:
            return _all(results)
        frontier = new
        for n, df in new.items():
            found.setdefault(n, []).append(df.select("row_id"))
            results.append(named(df, n, INHERITED_KIND, F.lit(INHERITED), depth))
    raise ValueError(f"the foreign-key graph is deeper than {most_rounds}")


def _all(parts: list[DataFrame]) -> DataFrame:
    """Union of frames with the same columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
