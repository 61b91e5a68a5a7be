"""Parameters of an experiment: defaults, and what each cytometer changes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Parameters:
    """Named defaults; derive others with dataclasses.replace."""

    cytometer: str = ""
    figures: bool = True
    # fixed values: channels
    scatter: tuple[str, str] = ("FSC-A", "SSC-A")
    time_channel: str = "Time"
    af_channel: str = ""
    saturation: float = 4194304.0
    non_spectral: str = r"FSC|SSC|Time|-H$|-W$|Event|Imag"
    spectral: str | None = None
    # fixed values: cleaning
    positivity: float = 0.99
    positivity_af: float = 0.95
    negative_n: int = 1000
    positive_n: int = 500
    min_cells_warning: int = 500
    min_cells_stop: int = 20
    similarity_warning: float = 0.95
    singlet_quantiles: tuple[float, float] = (0.85, 0.975)
    contaminant_cosine: float = 0.99
    cosine_fail: float = 0.90
    cosine_warn: float = 0.95
    # fixed values: gates
    gate_threshold: float = 0.05
    gate_share: float = 0.70
    gate_exclude: tuple[float, float] = (0.10, 0.05)
    gate_trim: tuple[float, float, float, float] = (0.01, 0.99, 0.01, 0.99)
    gate_grid: int = 100
    gate_reach: int = 3
    # fixed values: MADs around the median, bandwidth factors of both densities, for cells and beads
    gate_mads: tuple[float, float] = (2.0, 6.0)
    gate_bandwidths: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 1.0), (6.0, 1.0))
    large_gate: tuple[float, tuple[float, float]] = (0.25, (3.0, 6.0))
    # fixed values: background and variants
    som_dim: int = 10
    problem_quantile: float = 0.99
    variant_quantile: float = 0.995
    variant_cosine: float = 0.985
    noise_floor: float = 125.0
    folders: tuple[str, ...] = field(default=("figures", "tables", "spectra", "unmixed"))

    @property
    def scatter_max(self) -> float:
        return self.saturation


# Fixed values of the instruments: scatter channels, saturation, background channel.
_INSTRUMENTS = {
    "aurora": (("FSC-A", "SSC-A"), 4194304.0, "V7-A"),
    "auroraNL": (("FSC-A", "SSC-A"), 4194304.0, "V7-A"),
    "id7000": (("FSC-A", "SSC-A"), 1000000.0, "405CH7-A"),
    "a8": (("FSC-A", "SSC (Violet)-A"), 24140237.0, "V6 (515)-A"),
    "s8": (("FSC-A", "SSC (Violet)-A"), 24140237.0, "V6 (515)-A"),
    "a5se": (("FSC-A", "SSC-A"), 262144.0, "UV515-A"),
    "opteon": (("FSC-A", "VSSC-A"), 16777216.0, "UV508-A"),
    "mosaic": (("FSC-A", "BSSC-A"), 16777215.0, "V8-A"),
    "xenith": (("FSC51-A", "SSC52-A"), 100000.0, "FL13-A"),
}
# How far gates of large cells reach beyond the others, where it differs from the default.
_LARGE = {"aurora": (1.5, 4.5), "auroraNL": (1.5, 4.5), "a5se": (2.0, 6.0), "a8": (2.5, 6.0)}
#: Similarity to the library that fails or warns, where it differs from the default.
_SIMILARITY = {"id7000": (0.70, 0.85)}


def parameters(cytometer: str, figures: bool = True) -> Parameters:
    """Parameters of a cytometer; unknown names are an error."""
    if cytometer not in _INSTRUMENTS:
        raise ValueError(f"unknown cytometer {cytometer!r}; one of {', '.join(_INSTRUMENTS)}")
    scatter, top, af = _INSTRUMENTS[cytometer]
    fail, warn = _SIMILARITY.get(cytometer, (0.90, 0.95))
    include = r"^(UV|V|B|YG|R|IR)\d" if cytometer in ("a8", "s8") else None
    large = (0.25, _LARGE.get(cytometer, (3.0, 6.0)))
    p = replace(Parameters(), cytometer=cytometer, large_gate=large, figures=figures, scatter=scatter, saturation=top, af_channel=af, spectral=include, cosine_fail=fail, cosine_warn=warn)
    if cytometer == "id7000":
        import warnings

        warnings.warn("files of this cytometer hold no detector voltages: they cannot be compared", stacklevel=2)
    return p
