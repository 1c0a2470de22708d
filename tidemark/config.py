"""Parameters of the analytics, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

# Parameters that results depend on.
SUMMARY_FEATURES = ("cum_return", "volatility", "volume_ratio", "rsi", "macd", "sma_gap")


@dataclass(frozen=True)
class PatternConfig:
    window: int = 20
    horizon: int = 3
    down_threshold: float = 0.0


@dataclass(frozen=True)
class MinHashConfig:
    window: int = 20
    shingle: int = 2
    n_hashes: int = 100
    n_bands: int = 20
    seed: int = 42

    @property
    def rows_per_band(self) -> int:
        return self.n_hashes // self.n_bands

    @property
    def threshold(self) -> float:
        """Similarity at which a pair is as likely as not to share a band."""
        return (1 / self.n_bands) ** (1 / self.rows_per_band)


@dataclass(frozen=True)
class SimHashConfig:
    band_bits: int = 10
    n_bands: int = 12
    seed: int = 42
    top_k: int = 50


@dataclass(frozen=True)
class FusionConfig:
    z: float = 1.96
    target_priority: float = 1.5
    caution: float = 40.0
    strong: float = 65.0
    aligned_factor: float = 1.15
    conflict_factor: float = 0.8
    saturation: float = 10.0
    high_confidence: float = 0.6
    medium_confidence: float = 0.3


@dataclass(frozen=True)
class GraphConfig:
    corr_threshold: float = 0.5
    damping: float = 0.85
    max_iterations: int = 200
    tolerance: float = 1e-6
    min_periods: int = 100
    min_symbols_a_day: float = 0.5


@dataclass(frozen=True)
class AnomalyConfig:
    window: int = 20
    z_threshold: float = 3.0
    cusum_k: float = 0.5
    cusum_h: float = 5.0


@dataclass(frozen=True)
class ClusterConfig:
    variance: float = 0.90
    k: int = 6
    elbow: tuple[int, int] = (2, 10)
    max_iterations: int = 100
    tolerance: float = 1e-4
    representatives: int = 10
    shrink: float = 0.2
    seed: int = 42


@dataclass(frozen=True)
class QualityConfig:
    max_missing_percent: float = 20.0
    max_outlier_percent: float = 10.0
    iqr_factor: float = 1.5
    min_completeness: float = 80.0
    max_missing_in_row: int = 10


@dataclass(frozen=True)
class Config:
    pattern: PatternConfig = field(default_factory=PatternConfig)
    minhash: MinHashConfig = field(default_factory=MinHashConfig)
    simhash: SimHashConfig = field(default_factory=SimHashConfig)
    fusion: FusionConfig = field(default_factory=FusionConfig)
    graph: GraphConfig = field(default_factory=GraphConfig)
    anomaly: AnomalyConfig = field(default_factory=AnomalyConfig)
    cluster: ClusterConfig = field(default_factory=ClusterConfig)
    quality: QualityConfig = field(default_factory=QualityConfig)
    trading_days: int = 252


DEFAULT = Config()
