"""Streaming forms of batch operators; additions, the batch side has no streams (N-rows of the survey)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vislake.functions.complexmath import present


def scans(stream: DataFrame, keys: list[str], gap: str, lateness: str) -> DataFrame:
    """(keys, start, end, n) of gap-bounded scans, emitted once the watermark passes them (twin of scans_by_gap)."""
    s = stream.withWatermark("datetime", lateness).groupBy(*keys, F.session_window("datetime", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def averages(stream: DataFrame, keys: list[str], length: str, lateness: str) -> DataFrame:
    """Weighted means per (keys, fixed time cell) (twin of average with fixed cells)."""
    w = F.when(present(F.col("w")), F.col("w")).otherwise(0.0)
    on = lambda c: F.sum(F.when(present(F.col("w")), F.col("w") * F.col(c)).otherwise(0.0))
    g = stream.withWatermark("datetime", lateness).groupBy(*keys, F.window("datetime", length).alias("c")).agg(on("re").alias("sre"), on("im").alias("sim"), F.sum(w).alias("w"), F.count("*").alias("n"))
    mean = lambda c: F.when(F.col("w") > 0, F.try_divide(F.col(c), F.col("w"))).otherwise(F.lit(float("nan")))
    return g.select(*keys, F.col("c.start").alias("start"), mean("sre").alias("re"), mean("sim").alias("im"), "w", "n")


def unflagged(stream: DataFrame, flags: DataFrame, lateness: str) -> DataFrame:
    """Rows of a stream that touch no flag of a static table (twin of the interval anti-join): row_key, antenna, lo, hi
    against antenna, r_lo, r_hi. A left join on the antenna's list of flags, so no state is kept."""
    lists = flags.groupBy("antenna").agg(F.collect_list(F.struct("r_lo", "r_hi")).alias("f"))
    hit = F.coalesce(F.exists("f", lambda x: (x["r_lo"] <= F.col("hi")) & (F.col("lo") <= x["r_hi"])), F.lit(False))
    return stream.withWatermark("datetime", lateness).join(lists, "antenna", "left").where(~hit).drop("f")


def unwrapped(stream: DataFrame, lateness: str) -> DataFrame:
    """(antenna, t, phase, unwrapped): phases continued over batches per antenna (twin of unwrapped); state is the last phase
    and its turns. Rows of one batch are taken in time order; batches must come in time order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, turns = state.get if state.exists else (None, 0.0)
        pdf = pd.concat(list(batches)).sort_values("t", ignore_index=True)
        out = []
        for t, phase in zip(pdf["t"], pdf["phase"]):
            if last is not None:
                turns -= round((phase - last) / 6.283185307179586)
            last = phase
            out.append((key[0], t, phase, phase + 6.283185307179586 * turns))
        state.update((float(last), float(turns)))
        yield pd.DataFrame(out, columns=["antenna", "t", "phase", "unwrapped"])

    return stream.withWatermark("datetime", lateness).groupBy("antenna").applyInPandasWithState(step, "antenna string, t double, phase double, unwrapped double", "last double, turns double", "append", GroupStateTimeout.NoTimeout)
