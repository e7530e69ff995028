"""Parameters of the engine, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Bars of one instrument and interval.
KEYS = ("symbol", "interval")


@dataclass(frozen=True)
class BacktestConfig:
    """Capital, costs a side, bars a year, walk-forward windows and resampling."""

    initial_capital: float = 10_000.0
    commission_rate: float = 0.001
    slippage_rate: float = 0.0005
    annualization_factor: float = 8760.0
    train_bars: int = 8760
    test_bars: int = 2160
    step_bars: int = 2160
    purge_bars: int = 24
    split_ratio: float = 0.70
    min_trades: int = 30
    random_seed: int = 42
    mc_runs: int = 2000
    mc_block_size: int = 24

    @property
    def cost_rate(self) -> float:
        return self.commission_rate + self.slippage_rate

    def with_costs(self, commission: float, slippage: float) -> BacktestConfig:
        return replace(self, commission_rate=commission, slippage_rate=slippage)


@dataclass(frozen=True)
class QualityConfig:
    fail_threshold: float = 0.01
    strict_threshold: float = 0.0001
    outlier_threshold: float = 0.02
    outlier_sigma: float = 4.0
    outlier_min_rows: int = 10


@dataclass(frozen=True)
class RegimeConfig:
    bull_threshold: float = 0.05
    bear_threshold: float = -0.05
    trend_window: int = 4800
    vol_window: int = 720
    vol_low_quantile: float = 0.33
    vol_high_quantile: float = 0.67
    trend_band: float = 0.02
    min_valid: int = 50


@dataclass(frozen=True)
class PatternConfig:
    forward_horizons: tuple[int, ...] = (1, 6, 24)
    momentum_windows: tuple[int, ...] = (3, 6, 24)
    context_window: int = 168
    short_vol_window: int = 24
    long_vol_window: int = 168
    low_quantile: float = 0.20
    high_quantile: float = 0.80
    bootstrap_runs: int = 500
    min_samples: int = 100
    random_seed: int = 42


@dataclass(frozen=True)
class CrisisConfig:
    top_n: int = 3
    min_depth: float = -0.15
    ruin_drawdown: float = -0.50


#: Cost scenarios as (name, commission, slippage): of the audit, and of the institutional check.
AUDIT_COSTS = (("base", 0.001, 0.0005), ("medium", 0.0015, 0.0010), ("high", 0.0020, 0.0015))
INSTITUTIONAL_COSTS = (("best_execution", 0.0004, 0.0006), ("realistic", 0.0008, 0.0012), ("stress", 0.0015, 0.0030))
TIMEZONE_SHIFTS = (-12, -6, -3, -1, 0, 1, 3, 6, 12)
