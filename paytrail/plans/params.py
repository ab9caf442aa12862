"""Tunables of the audit, validated when made and passed to every operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000

# The nine shapes, strongest claim first.
PRECEDENCE = ("structuring", "deposit_send", "cycle", "bipartite", "layered_fan", "gather_scatter", "scatter_gather", "fan_in", "fan_out")


@dataclass(frozen=True)
class Weights:
    tightness: float = 0.4
    member_count: float = 0.2
    compactness: float = 0.2
    aggregate: float = 0.2

    def __post_init__(self):
        if abs(self.tightness + self.member_count + self.compactness + self.aggregate - 1) > 1e-9:
            raise ValueError("confidence weights must add up to 1")


@dataclass(frozen=True)
class Params:
    """Windows are closed at both ends. Values are the audit's published defaults."""

    window_days: int = 14
    thresholds: tuple[int, ...] = (10_000, 3_000)
    band_fraction: float = 0.2
    structuring_min: int = 3
    aggregate_multiple: float = 1.0
    fan_min: int = 4
    cycle_min_hops: int = 3
    cycle_max_hops: int | None = 25  # None, here and below: unbounded
    overlap: float = 0.6
    retained: float = 0.5
    scatter_min: int = 3
    hub_min_in: int = 3
    hub_min_out: int = 3
    hub_days: int = 21
    conservation: tuple[float, float] = (0.5, 2.0)
    send_hours: int = 72
    send_tolerance: float = 0.05
    send_kinds: tuple[str, ...] = ("cross_border", "ach", "wire", "cheque")
    send_min_pairs: int = 1
    branch_min: int = 2
    branch_min_leaves: int = 2
    leaves_min: int = 4
    funnel_days: int = 28
    block_min_src: int = 2
    block_min_dst: int = 3
    block_density: float = 0.8
    block_days: int = 21
    max_depth: int = 3
    max_frontier: int | None = 200
    max_block_senders: int | None = None
    max_block_side: int | None = 50
    weights: Weights = field(default_factory=Weights)
    precedence: tuple[str, ...] = PRECEDENCE
    #: Shapes beyond the nine: name -> function of (edges, params); ``precedence`` must place them.
    extra: tuple[tuple[str, Callable], ...] = ()

    def __post_init__(self):
        if not 0 < self.band_fraction < 1:
            raise ValueError("band_fraction must lie between 0 and 1")
        if self.conservation[0] > self.conservation[1]:
            raise ValueError("the conservation band is upside down")
        if sorted(self.precedence) != sorted([*PRECEDENCE, *(k for k, _ in self.extra)]):
            raise ValueError("precedence must name each of the nine shapes, and each extra one, once")
        if min(self.window_days, self.hub_days, self.send_hours, self.funnel_days, self.block_days) <= 0:
            raise ValueError("windows must be positive")

    def band(self, threshold: int) -> tuple[float, float]:
        """Half-open band just under a threshold."""
        return threshold * (1 - self.band_fraction), float(threshold)

    @classmethod
    def from_yaml(cls, text: str) -> Params:
        """Overrides from YAML; unknown names are refused."""
        import yaml

        given = yaml.safe_load(text) or {}
        unknown = set(given) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        if "weights" in given:
            given["weights"] = Weights(**given["weights"])
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
