"""Session settings (Q1-Q4): frozen values with defaults, required ones first."""

from __future__ import annotations

from dataclasses import dataclass, field

from vislake.functions.fringemath import Search
from vislake.operators.estimate import DelayFit


@dataclass(frozen=True)
class PointSource:
    """Model set of unresolved sources."""

    label: str = "point"


@dataclass(frozen=True)
class ExternalModels:
    """Component models (and images) of other reductions, by path templates with {src} and {epoch}."""

    label: str
    model_pattern: str
    image_pattern: str | None = None
    epoch: str = ""


@dataclass(frozen=True)
class TsysCalibration:
    """Limits of the amplitude scale."""

    ceiling: float = 500.0
    quantization: float = 0.88
    reference_sefd: float = 1.0
    fallback_cap: float = 0.2


@dataclass(frozen=True)
class VisibilityAveraging:
    """Cells of averaged visibilities: seconds inside a scan, and frequency mode."""

    seconds: float = 10.0
    frequency: str = "window"


@dataclass(frozen=True)
class OwnImaging:
    """Settings of the own imaging run, and variants as (label, replaced settings)."""

    label: str = "own"
    npix: int = 128
    pixel: float = 0.2
    gain: float = 0.05
    niter: int = 2000
    sigmas: float = 4.0
    window_radius: float = 10.0
    hybrid_rounds: int = 2
    floor: float = 0.1
    significance: float = 5.0
    amp_interval: float = 3600.0
    amp_normalize: str = "percell"
    variants: tuple[tuple[str, dict], ...] = ()


@dataclass(frozen=True)
class SessionConfig:
    """One session: input, antennas, searches, fits, members (model sets) and products."""

    name: str
    visibilities: str
    reference_antenna: str
    work: str
    members: tuple[PointSource | ExternalModels | OwnImaging, ...] = (PointSource(),)
    min_gap: float = 30.0
    search: Search = field(default_factory=lambda: Search((-0.2, 0.2), (-5e-7, 5e-7)))
    min_snr: float = 7.0
    graph: str = "snr"
    graph_iterations: int = 50
    cable_antennas: tuple[str, ...] = ()
    cable_apply: str = "both"
    tone_floor: float = 0.3
    tsys: TsysCalibration = TsysCalibration()
    averaging: VisibilityAveraging = VisibilityAveraging()
    fit: DelayFit | None = None
    wrap_threshold: float = 1.5707963267948966
    iono_primary: str = ""
    iono_inflation: float = 1.5
    products: tuple[str, ...] = ("catalogue", "fit_tables", "wcs", "closure", "report", "manifest")

    def __post_init__(self) -> None:
        labels = [m.label for m in self.members]
        if len(set(labels)) != len(labels):
            raise ValueError(f"labels of model sets must differ: {labels}")
        if self.cable_apply not in ("both", "delay", "none"):
            raise ValueError(f"cable_apply {self.cable_apply!r}")

    def delay_fit(self) -> DelayFit:
        """Settings of the estimator."""
        return self.fit or DelayFit(self.reference_antenna, min_snr=self.min_snr)

    def external(self) -> list[ExternalModels]:
        """Members that come from outside (Q4)."""
        return [m for m in self.members if isinstance(m, ExternalModels)]

    def own_imaging(self) -> OwnImaging | None:
        """The own imaging member, if any (Q4); two are an error."""
        own = [m for m in self.members if isinstance(m, OwnImaging)]
        if len(own) > 1:
            raise ValueError("more than one own imaging member")
        return own[0] if own else None

    def model_sets(self) -> list[str]:
        """Labels of all model sets, own variants included."""
        out = []
        for m in self.members:
            out.append(m.label)
            if isinstance(m, OwnImaging):
                out += [f"{m.label}-{v}" for v, _ in m.variants]
        if len(set(out)) != len(out):
            raise ValueError(f"labels of model sets must differ: {out}")
        return out
