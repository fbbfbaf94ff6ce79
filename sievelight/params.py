"""Parameters of the operators, in one place; no operator has numbers of its own."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # fixed values: teaching and identity
    keep_percentile: float = 0.40
    min_kept: int = 8
    segments: int = 5
    k_min: int = 16
    k_max: int = 32
    kc_eps: float = 0.002
    bank_ratio: float = 0.10
    bank_min: int = 256
    bank_max: int = 2400
    tau_factor: float = 1.4
    coverage_cut: float = 0.5
    sensitivity: float = 1.0
    id_low: float = 0.05
    id_high: float = 0.99
    id_min_gap: float = 0.02
    mad_k: float = 3.0
    mad_scale: float = 1.4826
    # fixed values: scoring, voting, calibration
    core_threshold: float = 0.5
    top_fraction: float = 0.01
    top_k_views: int = 3
    vote_from: float = 1.0
    vote_to: float = 1.15
    confidence: float = 0.95
    # fixed values: geometry
    k_geo: float = 3.0
    area_factor: float = 2.5
    floor_fill: float = 0.04
    floor_aspect: float = 0.04
    floor_solidity: float = 0.03
    floor_hu1: float = 0.04
    # fixed values: fit gate
    fit_factor: float = 1.10
    # fixed values: background model
    k_sigma: float = 4.0
    sigma_min: float = 3.0
    beta: float = 0.02
    # fixed values: telemetry
    latency_window: int = 512
    rate_window_ms: int = 60_000
    idle_ms: int = 3_000
    match_ms: int = 150
    downsample_ms: int = 125
    cooldown_ms: int = 30_000


DEFAULT = Params()
#: The profile with the fit gate; its keyframes are fewer.
ACCURACY = Params(tau_factor=1.25, k_max=24)
