"""Parameters of the paired-venue analytics, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values of the domain: thresholds, rungs and tables that results depend on.
MATCH_TOLERANCE_NS = 5_000_000_000
FRESH_SECONDS = 60.0
FLAT_FEE = 0.02
FEE_LEVELS = (0.01, 0.015, 0.02, 0.03)
RUNGS_MS = (0, 25, 50, 100, 250, 500, 1000)
TIERS_MS = (1000, 500, 250, 100, 25)
SCORE_BY_TIER = {"survived_1000ms": 0.80, "survived_500ms": 0.50, "survived_250ms": 0.25, "expired_lt_250ms": 0.0}
FILL_BY_TIER = {"survived_1000ms": 0.80, "survived_500ms": 0.50, "survived_250ms": 0.25, "survived_100ms": 0.05, "survived_25ms": 0.0, "expired_lt_250ms": 0.0}
BASIS, TRANSIENT, UNUSABLE = "basis_suspect", "transient_candidate", "unusable"
DIRECTIONS = ("a_yes_b_no", "a_no_b_yes")
EPS = 1e-12


@dataclass(frozen=True)
class Gate:
    """The practical-edge gate and what is built on it. The defaults are fixed values of the domain."""

    min_edge: float = 0.01
    max_skew_ms: float = 250.0
    min_fill: float = 1.0
    gap_seconds: float = 45.0
    cutoff: float = 0.25


@dataclass(frozen=True)
class Executable:
    """Scenario of the executable edge. The defaults are fixed values of the domain."""

    max_skew_ms: float = 250.0
    depth_haircut: float = 0.5
    staleness_penalty: float = 0.001
    min_snapshots: int = 2


@dataclass(frozen=True)
class Value:
    """Expected-value model. The defaults are fixed values of the domain."""

    apr: float = 0.05
    leg_failure: float = 0.10
    fallback_spread: float = 0.02
    fee_base: float = 0.02
    unprobed_fill: float = 0.25
    hold_to_resolution: bool = False
    viable_per_day: float = 5.0
    viable_per_week: float = 5.0


def scenarios(document: dict) -> dict[str, Executable]:
    """Executable-edge parameters of each named scenario of a modelling document: shared knobs, and each one's skew bound."""
    shared = document.get("executable") or {}
    named = shared.get("scenarios") or {}
    if not named:
        raise ValueError("the modelling document defines no scenarios")
    return {
        str(name): Executable(float((own or {}).get("max_skew_ms", 50.0)), float(shared.get("depth_haircut", 0.5)), float(shared.get("staleness_penalty_per_s", 0.001)), int(shared.get("min_episode_snapshots", 2)))
        for name, own in named.items()
    }
