"""Schedules of calibration steps (C19, X4, U2, U8, N12): a fold over a solution, with captured products and timings."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vislake.functions.fringemath import Search
from vislake.operators.bandpass import condense, condense_amplitudes, normalized, solve_amplitudes, solve_bandpass
from vislake.operators.fringe import edges, fringe_fit, fringe_self, solve_nodes
from vislake.operators.gains import Solution, calibrate, install_static
from vislake.operators.instrument import pcal_init
from vislake.session import cut

#: A step takes (visibilities with cells, solution) and returns (solution, product or None).
Step = Callable[[DataFrame, Solution], tuple[Solution, DataFrame | None]]


@dataclass(frozen=True)
class Capture:
    """Keeps a step's product under a name."""

    name: str
    step: Step


@dataclass
class Run:
    """What a schedule made: solutions after every step, captured products, seconds per step."""

    solutions: list[Solution] = field(default_factory=list)
    products: dict[str, DataFrame] = field(default_factory=dict)
    seconds: list[float] = field(default_factory=list)


def flat(solution: Solution) -> Solution:
    """Components written to the shared folder: a step's lineage ends with it."""
    return Solution(cut(solution.components), solution.tcells, solution.fcells)


def run(vis: DataFrame, solution: Solution, steps: list[Step | Capture], cancelled: Callable[[], bool] = lambda: False) -> Run:
    """Apply the steps in order. cancelled is asked before each; what was made so far is returned then."""
    out = Run([solution])
    for step in steps:
        if cancelled():
            break
        began = time.time()
        solution, product = (step.step if isinstance(step, Capture) else step)(vis, solution)
        solution = flat(solution)
        if isinstance(step, Capture) and product is not None:
            out.products[step.name] = cut(product)
        out.solutions.append(solution)
        out.seconds.append(time.time() - began)
    return out


def fringe_step(width: float, search: Search, targets: list[str], min_snr: float, reference: int, kind: str = "snr", iterations: int = 50, strict: bool = True) -> Step:
    """Measure on calibrated data, solve every tile's graph, add to the targets."""

    def step(vis: DataFrame, solution: Solution) -> tuple[Solution, DataFrame]:
        fringes = cut(fringe_fit(calibrate(vis, solution, solution.kinds()), width, search, strict))
        nodes = solve_nodes(edges(fringes, min_snr), kind, iterations, reference)
        return fringe_self(solution, nodes, targets), fringes

    return step


def measure_step(width: float, search: Search, strict: bool = True) -> Step:
    """Measure only."""
    return lambda vis, solution: (solution, fringe_fit(calibrate(vis, solution, solution.kinds()), width, search, strict))


def pcal_step(tones: DataFrame, cable_apply: str, floor: float) -> Step:
    """Install tone delays and phases (C15). tones: p, i, tcell, band (= fcell), tone, freq, re, im, cable."""

    def step(vis: DataFrame, solution: Solution) -> tuple[Solution, None]:
        c = pcal_init(tones, ["p", "i"], cable_apply, floor).withColumnRenamed("band", "fcell")
        both = F.explode(F.array(F.struct(F.lit("Delay").alias("kind"), F.col("delay").alias("value")), F.struct(F.lit("PhaseOffset").alias("kind"), F.col("phase").alias("value")))).alias("c")
        new = c.select("p", "i", "tcell", "fcell", both).select("c.kind", "p", "i", "tcell", "fcell", "c.value")
        return solution.replaced(new, ["Delay", "PhaseOffset"]), None

    return step


def alignment_step(alignment: DataFrame) -> Step:
    """Install a static alignment: kind, p, i, fcell, value (C14)."""
    return lambda vis, solution: (install_static(solution, alignment), None)


def bandpass_step(iterations: int, regularization: float, reference: tuple[int, int] | None = None) -> Step:
    """Solve and install the bandpass of every (tcell, fcell = k) (C17). vis: hcell, acell besides its cells."""

    def step(vis: DataFrame, solution: Solution) -> tuple[Solution, DataFrame]:
        others = [k for k in solution.kinds() if k not in ("PhaseBandpass", "LogAmplitudeBandpass")]
        got = solve_bandpass(condense(calibrate(vis, solution, others).withColumn("k", F.col("fcell"))), iterations, regularization, reference)
        both = F.explode(F.array(F.struct(F.lit("PhaseBandpass").alias("kind"), F.col("phase").alias("value")), F.struct(F.lit("LogAmplitudeBandpass").alias("kind"), F.col("log_amp").alias("value")))).alias("c")
        new = got.select("p", "i", "tcell", F.col("k").alias("fcell"), both).select("c.kind", "p", "i", "tcell", "fcell", "c.value")
        return solution.replaced(new, ["PhaseBandpass", "LogAmplitudeBandpass"]), got

    return step


def amplitude_step(weight_scale: float, min_snr: float, floor: float, regularization: float, normalize: str) -> Step:
    """Amplitude self-calibration against models in the visibilities' model columns."""

    def step(vis: DataFrame, solution: Solution) -> tuple[Solution, DataFrame]:
        solved = cut(normalized(solve_amplitudes(condense_amplitudes(calibrate(vis, solution, solution.kinds()), weight_scale, min_snr, floor), regularization), normalize))
        new = solved.select(F.lit("LogAmplitudeBandpass").alias("kind"), "p", "i", "tcell", "fcell", F.col("a").alias("value"))
        return solution.plus(new), solved

    return step
