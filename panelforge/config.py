"""Settings of the engine with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # cleaning
    min_coverage: float = 0.80
    outlier_threshold: float = 0.25
    max_fills: int = 3
    calendar: str = "NYSE"
    # exploration
    moving_windows: tuple[int, ...] = (20, 50)
    volatility_window: int = 30
    days_per_year: int = 252
    top_correlations: int = 3
    top_moves: int = 10
    min_qq_rows: int = 30
    # metrics
    risk_free_rate: float = 0.04
    benchmark: str | None = None
    weights: dict[str, float] | None = None
    var_levels: tuple[float, ...] = (0.95, 0.99)
    cvar_levels: tuple[float, ...] = (0.95,)
    sharpe_window: int = 90
    beta_window: int = 60
    corr_window: int = 60
    exclude_benchmark: bool = True
    # forecasting
    train_initial: int = 252
    step: int = 30
    expanding: bool = True
    arima_max_p: int = 5
    arima_max_q: int = 5
    arima_max_d: int = 2
    min_observations: int = 100
    # simulation
    seed: int = 42
    block_size: int = 10
    drift: str = "historical"
    use_correlation: bool = True
    save_full_paths: bool = False
    percentiles: tuple[float, ...] = (1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0)
    thresholds: tuple[float, ...] = (-0.20, -0.10, 0.0, 0.10, 0.20)
    # export
    export_csv: bool = True
    export_excel: bool = True
    version: str = "1.0"
    extra: dict = field(default_factory=dict)


DEFAULTS = Settings()
