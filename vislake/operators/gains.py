"""Antenna gains from solved components, and their application.

components: kind, p, i, tcell, fcell, value - a missing row is 0 (identity). The gains of one visibility are looked up
twice (both ends), by joins on the cell numbers; per kind the phases and log amplitudes are summed before that, so a
lookup is one equi-join per end however many kinds there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vislake.functions.complexmath import TWO_PI, Complex, present
from vislake.session import bounded

#: Kind -> (is a phase, unit, response as a Column of value, t, nu, t_ref, nu_ref). Others may be registered.
KINDS: dict[str, tuple[bool, str, Callable[..., Column]]] = {
    "PhaseOffset": (True, "rad", lambda value, t, nu, t_ref, nu_ref: value),
    "Delay": (True, "s", lambda value, t, nu, t_ref, nu_ref: F.lit(TWO_PI) * value * (nu - nu_ref)),
    "Rate": (True, "Hz", lambda value, t, nu, t_ref, nu_ref: F.lit(TWO_PI) * value * (t - t_ref)),
    "PhaseBandpass": (True, "rad", lambda value, t, nu, t_ref, nu_ref: value),
    "LogAmplitudeBandpass": (False, "", lambda value, t, nu, t_ref, nu_ref: value),
}


#: Time cells of one stretch of install_static.
CELLS_AT_ONCE = 4096


def register_kind(name: str, phase: bool, unit: str, response: Callable[..., Column]) -> None:
    """Add a component kind (X3); calibrate, corrupt and the queries on solutions take it like the built-in ones. response: a
    Column of (value, t, nu, t_ref, nu_ref), odd in value so that corrupt inverts calibrate."""
    KINDS[name] = (phase, unit, response)


@dataclass(frozen=True)
class Solution:
    """Components with the cells they live on: tcells and fcells are (cell, ref) tables of one common partition."""

    components: DataFrame
    tcells: DataFrame
    fcells: DataFrame

    def kinds(self) -> list[str]:
        """Kinds that have a row, in canonical order."""
        have = {r[0] for r in self.components.select("kind").distinct().collect()}
        return [k for k in KINDS if k in have]

    def of(self, kind: str) -> DataFrame:
        return self.components.where(F.col("kind") == kind)

    def scaled(self, factor: float) -> Solution:
        """All values times a number."""
        return Solution(self.components.withColumn("value", F.col("value") * factor), self.tcells, self.fcells)

    def plus(self, more: DataFrame) -> Solution:
        """Values added to the installed ones."""
        total = self.components.unionByName(more.select(*self.components.columns)).groupBy("kind", "p", "i", "tcell", "fcell").agg(F.sum("value").alias("value"))
        return Solution(total, self.tcells, self.fcells)

    def replaced(self, more: DataFrame, kinds: list[str]) -> Solution:
        """Rows of the given kinds replaced where `more` has the cell."""
        key = ["kind", "p", "i", "tcell", "fcell"]
        kept = self.components.where(F.col("kind").isin(kinds)).join(more.select(*key), key, "left_anti")
        return Solution(self.components.where(~F.col("kind").isin(kinds)).unionByName(kept).unionByName(more.select(*self.components.columns)), self.tcells, self.fcells)


def terms_of(solution: Solution, kinds: list[str]) -> DataFrame:
    """(p, i, tcell, fcell, one column per kind): the summed values of every node and cell, one row each.

    Unknown or repeated kinds are errors.
    """
    if len(set(kinds)) != len(kinds) or any(k not in KINDS for k in kinds):
        raise ValueError(f"kinds must be known and different: {kinds}")
    c = solution.components.where(F.col("kind").isin(kinds))
    return c.groupBy("p", "i", "tcell", "fcell").agg(*[F.sum(F.when(F.col("kind") == k, F.col("value")).otherwise(0.0)).alias(k) for k in kinds])


def calibrate(vis: DataFrame, solution: Solution, kinds: list[str]) -> DataFrame:
    """V / (g_p conj g_q) and w |g_p|^2 |g_q|^2 for every product.

    A node's phase is the sum of the responses of the phase kinds, its log amplitude that of the others, each as registered
    in KINDS (own kinds included). vis needs tcell and fcell besides its own columns. No kinds: the rows pass unchanged.
    Weights that are not above 0 (or NaN) become 0; the value is divided all the same. A node without a component has gain 1.
    """
    if not kinds:
        return vis
    terms = terms_of(solution, kinds)
    # Broadcast where a count proves the look-ups small: the visibilities are not shuffled for them then.
    refs_t = bounded(solution.tcells.select(F.col("cell").alias("tcell"), F.col("ref").alias("__t_ref")))
    refs_f = bounded(solution.fcells.select(F.col("cell").alias("fcell"), F.col("ref").alias("__nu_ref")))
    side = lambda end, slot: bounded(terms.select(F.col("p").alias(end), F.col("i").alias(slot), "tcell", "fcell", *[F.col(f"`{k}`").alias(f"__{end}_{n}") for n, k in enumerate(kinds)]))
    full = vis.join(refs_t, "tcell", "left").join(refs_f, "fcell", "left").join(side("p", "i"), ["p", "i", "tcell", "fcell"], "left").join(side("q", "j"), ["q", "j", "tcell", "fcell"], "left")

    def total(end: str, phase: bool) -> Column:
        out = F.lit(0.0)
        for n, k in enumerate(kinds):
            if KINDS[k][0] == phase:
                out = out + KINDS[k][2](F.coalesce(F.col(f"__{end}_{n}"), F.lit(0.0)), F.col("t"), F.col("nu"), F.col("__t_ref"), F.col("__nu_ref"))
        return out

    amplitude = F.exp(total("p", False) + total("q", False))
    # 1 / (g_p conj g_q) = exp(-(a_p + a_q)) cis(-(phi_p - phi_q))
    z = Complex(F.col("re"), F.col("im")) * Complex.polar(1 / amplitude, -(total("p", True) - total("q", True)))
    w = F.when(present(F.col("w")), F.col("w") * amplitude * amplitude).otherwise(0.0)
    return full.select(*[z.re.alias("re") if c == "re" else z.im.alias("im") if c == "im" else w.alias("w") if c == "w" else F.col(c) for c in vis.columns])


def corrupt(vis: DataFrame, solution: Solution, kinds: list[str]) -> DataFrame:
    """The inverse of calibrate on the values: V = g_p C conj(g_q); weights stay."""
    inverse = Solution(solution.components.withColumn("value", -F.col("value")), solution.tcells, solution.fcells)
    out = calibrate(vis.withColumn("__w", F.col("w")), inverse, kinds)
    return out.withColumn("w", F.col("__w")).drop("__w")


def install_static(solution: Solution, alignment: DataFrame) -> Solution:
    """Static values (kind, p, i, fcell, value) added in every time cell (C14).

    Every value is wanted once per time cell: both sides get a stretch of cell numbers as key, so a task holds one stretch.
    """
    stretch = lambda c: F.floor(c / CELLS_AT_ONCE)
    cells = solution.tcells.select(F.col("cell").alias("tcell"), stretch(F.col("cell")).alias("__at"))
    top = solution.tcells.agg(F.max("cell")).first()[0]
    if top is None:
        return solution
    wide = alignment.withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(top // CELLS_AT_ONCE)))).withColumn("__at", F.col("__at").cast("bigint"))
    return solution.plus(wide.join(bounded(cells), "__at").select("kind", "p", "i", "tcell", "fcell", "value"))
