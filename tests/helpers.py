"""Comparison of a Spark query with its SQL, as the driver does it: columns by name, rows in any order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def rows_of(names: list[str], records: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else float(f"{x:.10g}")
        return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x

    return Counter(tuple(plain(r[i]) for i in order) for r in records)


def differences(spark, name: str, query, sql: str, folder: str) -> tuple[int, int, list, list]:
    """Rows of either side and up to five rows that only one of them has."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else p / '*.parquet'}'")
    df = query(spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rows_of(names, rel.fetchall())
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    return sum(ours.values()), sum(theirs.values()), list((ours - theirs).items())[:5], list((theirs - ours).items())[:5]
