"""Tunable parameters of the flux pipeline, grouped in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass, field

# Physical constants and thresholds the results depend on.
EARTH_RADIUS_M = 6_371_000.0
BOLTZMANN = 1.380649e-23  # J K-1
STANDARD_PRESSURE_PA = 101325.0
J_NO2_OVERHEAD = 8.5e-3  # s-1
J_NO2_COSZ_POWER = 0.7
NO_O3_PREFACTOR = 3.0e-12  # cm3 molec-1 s-1
NO_O3_ACTIVATION_K = 1500.0
MW_NO2 = 46.0055  # g mol-1
MW_NO = 30.0061  # g mol-1
BOUNDARY_LAYER_M = 2.5e19  # molec cm-3
FALLBACK_TEMPERATURE_K = 298.0
AVOGADRO = 6.022e23
LB_TO_TONNE = 0.000453592
MOL_TO_UMOL = 1e6

GAUSS_PARAMS = ("a0", "a1", "a2", "a3", "a4")


def _default_bounds() -> dict[str, tuple[float, float]]:
    return {
        "a0": (0.0, 500.0),
        "a1": (-50.0, 50.0),
        "a2": (0.0, 1000.0),
        "a3": (-100.0, 100.0),
        "a4": (1.0, 40.0),
    }


def _default_quality() -> tuple[tuple[str, str, float], ...]:
    return (
        ("rsq_detrend", ">=", 0.0),
        ("d_gap", "<=", 50.0),
        ("d_left", ">=", -20.0),
        ("d_right", ">=", -20.0),
        ("d_center", "<=", 30.0),
        ("a2sigpct", "<=", 50.0),
        ("a4sigpct", "<=", 50.0),
        ("nobs", ">=", 5.0),
    )


@dataclass(frozen=True)
class FluxConfig:
    """All thresholds of the pipeline; pass a changed copy to override."""

    # clipping
    clip_buffer_deg: float = 2.0
    second_sensor_buffer_deg: float = 3.0
    map_buffer_deg: float = 2.5
    # pixel quality
    qa_min: float = 0.5
    second_sensor_quality_max: float = 0.5
    # transects
    half_km: float = 100.0
    step_km: float = 0.5
    radius_km: float = 6.5
    min_samples: int = 3
    sample_mode: str = "mean_within_range"
    # profile fit
    bounds: dict[str, tuple[float, float]] = field(default_factory=_default_bounds)
    quality: tuple[tuple[str, str, float], ...] = field(default_factory=_default_quality)
    # path optimisation
    path_method: str = "combined"
    snr_quantile: float = 0.75
    poly_degree: int = 3
    turn_deg: float = 45.0
    step_mad_k: float = 3.0
    greedy_floor_k: float = 0.5
    greedy_max_steps: int | None = None
    # chemistry
    decay_option: str = "A"
    residual_tol: float = 2.0
    # monitor matching
    lookback_hours: int = 6
    match_tol_hours: float = 0.5
    age_max_hours: float = 0.2
    trim_quantiles: tuple[float, float] = (0.0, 0.98)
    cuts: tuple[tuple[str, float, float], ...] = (
        ("nobs", 50.0, 9999.0),
        ("rsq_detrend", 0.6, 9999.0),
    )
    pair_max_hours: float = 6.0

    @property
    def radius_deg(self) -> float:
        from math import pi

        return self.radius_km / (pi / 180.0 * EARTH_RADIUS_M / 1e3)
