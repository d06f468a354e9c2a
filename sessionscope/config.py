"""Settings of the session jobs, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

CATEGORICAL_MODES = ("independent", "joint", "status_given_url")
STATE_FIELDS = ("method", "url_group", "status_category")
MODELS = ("categorical", "markov")


@dataclass(frozen=True)
class SessionConfig:
    """Defaults are those of the saved configuration of the jobs this library rebuilds."""

    timeout_seconds: int = 60
    min_events: int = 3
    smoothing: float = 0.5
    model: str = "categorical"
    mode: str = "status_given_url"  # of the categorical model
    state_fields: tuple[str, ...] = ("url_group", "status_category")
    aep_quantile: float = 0.9
    density_quantile: float = 0.9
    bandwidth: str | float = "scott"
    epsilon: float = 1e-12
    alpha: float = 0.5
    warning_quantile: float = 0.9
    critical_quantile: float = 0.99
    training_ratio: float = 0.65
    validation_ratio: float = 0.15
    testing_ratio: float = 0.20
    session_control: bool = True
    apply_allowlist_to_validation: bool = True
    counting_unit: str = "session"

    def __post_init__(self) -> None:
        if self.timeout_seconds <= 0 or self.min_events < 1:
            raise ValueError("timeout_seconds and min_events must be positive")
        if self.smoothing <= 0:
            raise ValueError("smoothing must be positive")
        if self.mode not in CATEGORICAL_MODES:
            raise ValueError(f"mode must be one of {CATEGORICAL_MODES}")
        if self.model not in MODELS or self.counting_unit not in ("session", "request"):
            raise ValueError(f"model must be one of {MODELS}, counting_unit session or request")
        fields = self.state_fields
        if not fields or len(set(fields)) != len(fields) or set(fields) - set(STATE_FIELDS):
            raise ValueError(f"state_fields must be a non-empty unique subset of {STATE_FIELDS}")
        for q in (self.aep_quantile, self.density_quantile, self.warning_quantile, self.critical_quantile):
            if not 0 <= q <= 1:
                raise ValueError("quantiles lie between 0 and 1")
        if self.warning_quantile > self.critical_quantile:
            raise ValueError("warning_quantile may not exceed critical_quantile")
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha lies between 0 and 1")
        if self.epsilon <= 0:
            raise ValueError("epsilon must be positive")
        ratios = (self.training_ratio, self.validation_ratio, self.testing_ratio)
        if min(ratios) <= 0 or abs(sum(ratios) - 1) > 1e-9:
            raise ValueError("ratios must be positive and sum to 1")
        if isinstance(self.bandwidth, str):
            if self.bandwidth not in ("scott", "silverman"):
                raise ValueError("bandwidth is scott, silverman or a positive number")
        elif self.bandwidth <= 0:
            raise ValueError("bandwidth is scott, silverman or a positive number")
