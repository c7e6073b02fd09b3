"""Settings of a reduction run, with presets and checks."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace

from ..functions.scoring import HIGH, LEVELS, MEDIUM
from ..operators.cluster import ALIASES, CLUSTERERS

FORMATS = ("json", "yaml", "markdown", "md", "html")


@dataclass(frozen=True)
class Settings:
    algorithm: str = "kmeans"
    threshold: float = MEDIUM
    high_threshold: float = HIGH
    output_format: str = "json"
    max_clusters: int = 50
    min_cluster_size: int = 2
    min_samples: int = 5
    eps: float | None = None
    linkage: str = "ward"
    n_clusters: int | None = None
    distance_threshold: float | None = None
    semantic_weight: float = 0.7
    coverage_weight: float = 0.3
    semantic_dim: int = 128
    max_features: int = 5000
    validate_safety: bool = True
    entropy_damping: bool = False
    include_noise: bool = True
    exclude_paths: tuple[str, ...] = ("vendor", "bootstrap", "node_modules", "public", "storage")
    focus_paths: tuple[str, ...] = ("app", "src")
    levels: dict[str, float] = field(default_factory=lambda: dict(LEVELS))

    def __post_init__(self) -> None:
        if ALIASES.get(self.algorithm, self.algorithm) not in CLUSTERERS:
            raise ValueError(f"unknown algorithm {self.algorithm}")
        if not 0 <= self.threshold <= 1 or not 0 <= self.high_threshold <= 1:
            raise ValueError("thresholds lie between 0 and 1")
        if self.output_format not in FORMATS:
            raise ValueError(f"unknown format {self.output_format}")

    def with_overrides(self, overrides: dict) -> Settings:
        """With the given values; names that aren't settings are ignored."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in overrides.items() if k in known})

    def as_dict(self) -> dict:
        return asdict(self)


#: Presets by name: how similar tests must be for each level.
PRESETS = {
    "default": Settings(),
    "strict": Settings(threshold=0.9, high_threshold=0.97, levels={"very_high_redundancy": 0.95, "high_redundancy": 0.85, "moderate_redundancy": 0.7, "low_redundancy": 0.5}),
    "lenient": Settings(threshold=0.75, high_threshold=0.9, levels={"very_high_redundancy": 0.75, "high_redundancy": 0.6, "moderate_redundancy": 0.4, "low_redundancy": 0.2}),
}
