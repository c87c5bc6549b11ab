"""Bandpass and amplitude solves (C17, C18, A15): condensed by group-bys, iterated on small arrays.

The sums a solve needs are a distributed aggregate of fixed size per cell (antennas^2 x slots x cells); the iteration is a
grouped kernel per bandpass time cell and set of coupled channels, so cells run in parallel and none holds visibilities; for
few, long cells the same iteration runs with distributed sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vislake.functions.complexmath import present
from vislake.session import bounded, cut

KEY = ["source", "p", "q", "i", "j", "hcell", "acell"]


def weighted_quantile(x: np.ndarray, w: np.ndarray, q: float) -> float:
    """Mean of the samples under a window about q of the cumulated weights; its width is sum w^2 / (sum w)^2."""
    order = np.argsort(x, kind="stable")
    x, w = np.asarray(x, float)[order], np.asarray(w, float)[order]
    upper = np.cumsum(w) / w.sum()
    half = (w**2).sum() / w.sum() ** 2 / 2
    overlap = np.clip(np.minimum(upper, q + half) - np.maximum(np.append(0.0, upper[:-1]), q - half), 0, None)
    return float((overlap * x).sum() / overlap.sum())


def weighted_quantile_column(rows: DataFrame, by: list[str], x: str, w: str, q: float) -> DataFrame:
    """(by, value): the same as window sums, for groups too large for one kernel call."""
    o = Window.partitionBy(*by).orderBy(x, w)
    a = Window.partitionBy(*by)
    s = rows.withColumn("hi", F.sum(w).over(o.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(w).over(a))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(o), F.lit(0.0))).withColumn("half", F.sum(F.col(w) * F.col(w)).over(a) / F.sum(w).over(a) ** 2 / 2)
    ov = F.greatest(F.least(F.col("hi"), q + F.col("half")) - F.greatest(F.col("lo"), q - F.col("half")), F.lit(0.0))
    return s.groupBy(*by).agg((F.sum(ov * F.col(x)) / F.sum(ov)).alias("value"))


def condense(vis: DataFrame) -> DataFrame:
    """Sums of w V and w per (KEY, tcell, k): hcell, acell are the coherence cells, tcell and k those of the bandpass (C17)."""
    return vis.where(present(F.col("w"))).groupBy(*KEY, "tcell", "k").agg(F.sum(F.col("w") * F.col("re")).alias("sre"), F.sum(F.col("w") * F.col("im")).alias("sim"), F.sum("w").alias("sw"))


def solve_bandpass(sums: DataFrame, iterations: int, regularization: float, reference: tuple[int, int] | None = None) -> DataFrame:
    """(tcell, p, i, k, phase, log_amp) of the bandpass (C17).

    Every coherence group has its own unknown coherency, taken out by its weighted mean; all node gains are updated at once
    with the penalty regularization times the 0.9 weighted quantile of |sum w V|^2 / sum w. With a reference node its phase
    is 0 in every channel; a reference without data is an error.
    """

    # Channels are coupled only through the coherence cells they share, so each coupled set is solved by a task of its own,
    # under the penalty of the whole time cell. The pairs are as many as channels.
    pairs = [tuple(r) for r in sums.select("acell", "k").distinct().collect()]
    home: dict = {}

    def root(x):
        while home.setdefault(x, x) != x:
            x = home[x]
        return x

    for a, k in pairs:
        home[root(("k", k))] = root(("a", a))
    sets = {r: n for n, r in enumerate(sorted({root(("k", k)) for _, k in pairs}))}
    of_k = {k: sets[root(("k", k))] for _, k in pairs}
    part = F.create_map(*[F.lit(x) for item in of_k.items() for x in item])[F.col("k")] if of_k else F.lit(0)
    size = sums.select("tcell", ((F.col("sre") ** 2 + F.col("sim") ** 2) / F.col("sw")).alias("__x"), F.col("sw").alias("__w"))
    limit = weighted_quantile_column(size, ["tcell"], "__x", "__w", 0.9).withColumnRenamed("value", "limit")
    sums = sums.join(bounded(limit), "tcell").withColumn("part", part)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*KEY, "k"], ignore_index=True)
        d, w = pdf["sre"].to_numpy() + 1j * pdf["sim"].to_numpy(), pdf["sw"].to_numpy()
        nodes = pd.MultiIndex.from_arrays([np.r_[pdf["p"], pdf["q"]], np.r_[pdf["i"], pdf["j"]], np.r_[pdf["k"], pdf["k"]]])
        code, names = pd.factorize(nodes)
        lp, lq = code[: len(pdf)], code[len(pdf) :]
        group = pdf.groupby(KEY, sort=False).ngroup().to_numpy()
        penalty = regularization * float(pdf["limit"].iloc[0])
        n, b = len(names), np.ones(len(names), complex)
        add = lambda at, z: np.bincount(at, z.real, n) + 1j * np.bincount(at, z.imag, n)
        for it in range(1, iterations + 1):
            old = b
            bp, bq = old[lp], old[lq]
            up = np.conj(bp) * bq * d
            top = np.bincount(group, up.real) + 1j * np.bincount(group, up.imag)
            low = np.bincount(group, np.abs(bp) ** 2 * np.abs(bq) ** 2 * w)
            c = np.where(low > 0, top / np.where(low > 0, low, 1), 0)[group]
            zp, zq = c * np.conj(bq), np.conj(c) * np.conj(bp)
            num = penalty + add(lp, np.conj(zp) * d) + add(lq, np.conj(zq) * np.conj(d))
            den = penalty + np.bincount(lp, w * np.abs(zp) ** 2, n) + np.bincount(lq, w * np.abs(zq) ** 2, n)
            b = num / den
            if it % 2 == 0:
                b = (b + old) / 2
        out = pd.DataFrame({"tcell": int(pdf["tcell"].iloc[0]), "p": [x[0] for x in names], "i": [x[1] for x in names], "k": [x[2] for x in names], "b": b})
        if reference is not None:
            ref = out[(out["p"] == reference[0]) & (out["i"] == reference[1])].set_index("k")["b"]
            if ref.empty:
                raise ValueError(f"reference node {reference} has no data")
            turn = out["k"].map(ref).fillna(1.0 + 0j).to_numpy()
            out["b"] = out["b"].to_numpy() * np.conj(turn / np.abs(turn))
        z = out["b"].to_numpy()
        return out.assign(phase=np.angle(z), log_amp=np.log(np.abs(z)))[["tcell", "p", "i", "k", "phase", "log_amp"]]

    return sums.groupBy("tcell", "part").applyInPandas(run, "tcell int, p int, i int, k int, phase double, log_amp double")


#: Unknowns of one wide solve (antennas x slots x channels x time cells) that may reach the driver: 16 MB.
MOST_UNKNOWNS = 1_000_000


def solve_bandpass_wide(sums: DataFrame, iterations: int, regularization: float, reference: tuple[int, int] | None = None) -> DataFrame:
    """solve_bandpass for few, long time cells, whose condensed sums no task could hold: the same iteration with distributed sums.

    The condensed sums are laid out once by coherence group and stay where they are; an iteration sends the gains to the tasks
    and brings one sum per unknown back. Only the unknowns must fit the driver (more than MOST_UNKNOWNS is an error).
    """
    group = [*KEY, "tcell"]
    ends = sums.select("tcell", F.explode(F.array(F.struct("p", "i"), F.struct(F.col("q").alias("p"), F.col("j").alias("i")))).alias("e"), "k").select("tcell", "e.p", "e.i", "k").distinct()
    unknowns = ends.orderBy("tcell", "p", "i", "k").limit(MOST_UNKNOWNS + 1).toPandas()
    n = len(unknowns)
    if n > MOST_UNKNOWNS:
        raise ValueError(f"more than {MOST_UNKNOWNS} unknowns")
    out_schema = "tcell int, p int, i int, k int, phase double, log_amp double"
    spark = sums.sparkSession
    if not n:
        return spark.createDataFrame([], out_schema)
    index = spark.createDataFrame(unknowns.assign(node=np.arange(n)))
    side = lambda end, slot, name: bounded(index.select("tcell", F.col("p").alias(end), F.col("i").alias(slot), "k", F.col("node").alias(name)))
    placed = sums.join(side("p", "i", "lp"), ["tcell", "p", "i", "k"]).join(side("q", "j", "lq"), ["tcell", "q", "j", "k"])
    # A checkpoint keeps partitions and their order, so no iteration exchanges rows.
    held = cut(placed.select(F.xxhash64(*group).alias("g"), *group, "lp", "lq", "sre", "sim", "sw").repartition(*group).sortWithinPartitions(*group).select("g", "lp", "lq", "sre", "sim", "sw"))
    size = sums.select("tcell", ((F.col("sre") ** 2 + F.col("sim") ** 2) / F.col("sw")).alias("x"), F.col("sw").alias("w"))
    limits = {r["tcell"]: r["value"] for r in weighted_quantile_column(size, ["tcell"], "x", "w", 0.9).collect()}  # one row per time cell
    penalty = regularization * unknowns["tcell"].map(limits).to_numpy(float)

    def sums_of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def add(t: dict[str, np.ndarray], num: np.ndarray, den: np.ndarray) -> None:
            d, w = t["sre"] + 1j * t["sim"], t["sw"]
            new = np.append(True, t["g"][1:] != t["g"][:-1])
            of = np.cumsum(new) - 1
            bp, bq = b[t["lp"]], b[t["lq"]]
            up = np.conj(bp) * bq * d
            top = np.bincount(of, up.real) + 1j * np.bincount(of, up.imag)
            low = np.bincount(of, np.abs(bp) ** 2 * np.abs(bq) ** 2 * w)
            c = np.where(low > 0, top / np.where(low > 0, low, 1), 0)[of]
            for at, z, v in ((t["lp"], c * np.conj(bq), d), (t["lq"], np.conj(c) * np.conj(bp), np.conj(d))):
                np.add.at(num, at, np.conj(z) * v)
                np.add.at(den, at, w * np.abs(z) ** 2)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            num, den, rest = np.zeros(n, complex), np.zeros(n), None
            for batch in batches:
                t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "lp", "lq", "sre", "sim", "sw")}
                t = t if rest is None else {c: np.concatenate([rest[c], t[c]]) for c in t}
                cut_at = int(np.argmax(t["g"] == t["g"][-1])) if len(t["g"]) else 0  # the last group may go on
                rest = {c: x[cut_at:] for c, x in t.items()}
                if cut_at:
                    add({c: x[:cut_at] for c, x in t.items()}, num, den)
            if rest is not None and len(rest["g"]):
                add(rest, num, den)
            at = np.flatnonzero((num != 0) | (den != 0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(num.real[at]), pa.array(num.imag[at]), pa.array(den[at])], names=["node", "re", "im", "den"])

        got = held.mapInArrow(run, "node bigint, re double, im double, den double").groupBy("node").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.sum("den").alias("den")).toPandas()
        num, den = np.zeros(n, complex), np.zeros(n)
        num[got["node"]], den[got["node"]] = got["re"].to_numpy() + 1j * got["im"].to_numpy(), got["den"]
        return num, den

    b = np.ones(n, complex)
    for it in range(1, iterations + 1):
        num, den = sums_of(b)
        new = (penalty + num) / (penalty + den)
        b = (new + b) / 2 if it % 2 == 0 else new
    out = unknowns.assign(b=b)
    if reference is not None:
        ref = out[(out["p"] == reference[0]) & (out["i"] == reference[1])]
        if set(ref["tcell"]) != set(out["tcell"]):
            raise ValueError(f"reference node {reference} has no data")
        turn = out[["tcell", "k"]].merge(ref[["tcell", "k", "b"]], how="left", on=["tcell", "k"])["b"].fillna(1.0 + 0j).to_numpy()
        out["b"] = out["b"].to_numpy() * np.conj(turn / np.abs(turn))
    z = out["b"].to_numpy()
    return spark.createDataFrame(out.assign(phase=np.angle(z), log_amp=np.log(np.abs(z)))[["tcell", "p", "i", "k", "phase", "log_amp"]].astype(dict.fromkeys(["tcell", "p", "i", "k"], "int32")), out_schema)


def condense_amplitudes(vis: DataFrame, weight_scale: float, min_snr: float, floor: float) -> DataFrame:
    """(i, tcell, fcell, p < q, sw, sr, sq, n) of log|V| - log|M| with weights w |M|^2.

    vis: diagonal products with model_re, model_im and model_flux (total flux of the source's model). Data near a model null,
    below min_snr or with a zero or non-finite value are left out.
    """
    m = F.hypot("model_re", "model_im")
    a = F.hypot("re", "im")
    good = present(F.col("w")) & (F.col("i") == F.col("j")) & (m >= floor * F.col("model_flux")) & (m * F.sqrt(weight_scale * F.col("w")) >= min_snr) & F.coalesce((a > 0) & ~F.isnan(a) & (a < float("inf")), F.lit(False))
    d = vis.where(good).select("i", "tcell", "fcell", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), (F.ln(a) - F.ln(m)).alias("r"), (F.col("w") * m * m).alias("wt"))
    return d.groupBy("i", "tcell", "fcell", "p", "q").agg(F.sum("wt").alias("sw"), F.sum(F.col("wt") * F.col("r")).alias("sr"), F.sum(F.col("wt") * F.col("r") * F.col("r")).alias("sq"), F.count("*").alias("n"))


def solve_amplitudes(sums: DataFrame, regularization: float) -> DataFrame:
    """(i, tcell, fcell, p, a, info, n_antennas, rms_before, rms_after): log|V/M| = a_p + a_q by ridge least squares.

    A cell needs three antennas; one with fewer has no row.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p", "q"], ignore_index=True)
        ants = np.unique(np.r_[pdf["p"], pdf["q"]])
        n = len(ants)
        if n < 3:
            return pd.DataFrame(columns=["i", "tcell", "fcell", "p", "a", "info", "n_antennas", "rms_before", "rms_after"])
        x, y = np.searchsorted(ants, pdf["p"]), np.searchsorted(ants, pdf["q"])
        w, s, q = (pdf[c].to_numpy() for c in ("sw", "sr", "sq"))
        info = np.bincount(x, w, n) + np.bincount(y, w, n)
        mat = np.diag(info + regularization * info.mean())
        np.add.at(mat, (x, y), w)
        np.add.at(mat, (y, x), w)
        a = np.linalg.solve(mat, np.bincount(x, s, n) + np.bincount(y, s, n))
        g = a[x] + a[y]
        after = q - 2 * g * s + g * g * w
        head = {k: int(pdf[k].iloc[0]) for k in ("i", "tcell", "fcell")}
        return pd.DataFrame({**head, "p": ants, "a": a, "info": info, "n_antennas": n, "rms_before": np.sqrt(max(q.sum(), 0) / w.sum()), "rms_after": np.sqrt(max(after.sum(), 0) / w.sum())})

    return sums.groupBy("i", "tcell", "fcell").applyInPandas(run, "i int, tcell int, fcell int, p int, a double, info double, n_antennas int, rms_before double, rms_after double")


def normalized(solved: DataFrame, mode: str) -> DataFrame:
    """Mean log gain taken out, weighted by info: percell, global or none."""
    if mode == "none":
        return solved
    if mode == "percell":
        w = Window.partitionBy("i", "tcell", "fcell")
        return solved.withColumn("a", F.col("a") - F.sum(F.col("a") * F.col("info")).over(w) / F.sum("info").over(w))
    if mode == "global":
        mean = solved.agg(F.sum(F.col("a") * F.col("info")) / F.sum("info")).first()[0]  # one number
        return solved.withColumn("a", F.col("a") - F.lit(mean))
    raise ValueError(f"mode {mode!r}; one of percell, global, none")
