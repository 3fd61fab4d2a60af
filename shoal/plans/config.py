"""Parameters of the clustering plans, validated once."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Literal

Metric = Literal["euclidean", "pearson"]


@dataclass(frozen=True)
class ClusterConfig:
    """``alpha`` moves representatives towards the mean and is kept in [0.1, 0.9]; ``keep_fraction`` 0 or 1 keeps all points."""

    k: int = 5
    c: int = 5
    alpha: float = 0.3
    metric: Metric = "euclidean"
    keep_fraction: float = 0.0
    center: Literal["mean", "medoid"] = "mean"
    candidates: Literal["representatives", "all_points"] = "representatives"

    def __post_init__(self) -> None:
        if self.k < 1 or self.c < 1:
            raise ValueError("k and c must be at least 1")
        if self.metric not in ("euclidean", "pearson"):
            raise ValueError(f"metric must be euclidean or pearson, not {self.metric!r}")
        object.__setattr__(self, "alpha", min(0.9, max(0.1, self.alpha)))
        object.__setattr__(self, "keep_fraction", min(1.0, max(0.0, self.keep_fraction)))

    def with_(self, **changes: object) -> ClusterConfig:
        return replace(self, **changes)


@dataclass(frozen=True)
class ScalableConfig(ClusterConfig):
    sample_size: float = 0.1
    n_partitions: int = 5
    reduce_factor: int = 3
    outlier_threshold: int = 5
    seed: int = 42
    sample_size_auto: bool = False
    exponent: float = 0.33
    multiplier: float = 50.0
    sample_min: int = 500
    sample_max: int = 15_000
    centroid_sampling: bool = False

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.n_partitions < 1 or self.reduce_factor < 1:
            raise ValueError("n_partitions and reduce_factor must be at least 1")

    def points_sampled(self, n: int) -> int:
        """How many of ``n`` points are sampled: by a power law, as a fraction (up to 1), or as a number."""
        if self.sample_size_auto:
            s = int(self.multiplier * n**self.exponent + 0.5)
            return min(max(s, self.sample_min), self.sample_max, n)
        if self.sample_size <= 1.0:
            s = max(10 * self.k, max(self.sample_min, int(n * self.sample_size)))
            return min(s, self.sample_max, n)
        return min(max(int(self.sample_size), self.sample_min), n)


def kept_points(n: int, k: int, keep_fraction: float) -> int:
    """How many points the centroid-nearness sample keeps; ``n`` where it is off."""
    if keep_fraction <= 0 or n <= k:
        return n
    return min(n, max(k, int(n * keep_fraction)))
