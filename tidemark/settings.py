"""Parameters of the feature pipeline, passed to operators as one frozen value."""

from __future__ import annotations

from dataclasses import dataclass

DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Settings:
    raw_data_dir: str = "data"
    expected_row_count: int = 1_852_394
    development_holdout_fraction: float = 0.75
    cold_start_prior: float = 0.005
    smoothing: float = 20.0
    history_days: int = 90
    min_history: int = 5
    review_cost: float = 25.0
    daily_budget: float = 10.0


# The ordered feature contracts of the three base models. Graph and serving columns stay out.
FEAT_M2 = ["amt", "distance_km", "night", "hour_sin", "hour_cos", "category_risk"]
FEAT_M3 = ["amt", "log_amt", "distance_km", "night", "hour", "day_of_week", "hour_sin", "hour_cos", "category_risk", "state_risk", "card_txn_cnt", "card_mean_amt", "card_std_amt"]
FEAT_M4 = [
    "amt", "log_amt", "distance_km", "night", "hour_sin", "hour_cos", "day_of_week", "is_online", "category_risk", "state_risk", "merchant_risk",
    "card_txn_cnt", "card_mean_amt", "card_std_amt", "txns_24h", "txns_7d", "amt_x_catRisk", "dist_x_online",
]
MONITORED = list(dict.fromkeys(FEAT_M2 + FEAT_M3 + FEAT_M4))
