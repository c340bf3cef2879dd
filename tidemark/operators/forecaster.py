"""One entry point for every forecasting backend (F1, F2, F6): ``Forecaster(backend=...)``.

Backends: ``seasonal_naive`` and ``trend_seasonal`` (joins and group-bys
only), ``linear`` and ``gbt`` (``pyspark.ml``).  ``level`` (80, 90, 95 %)
picks the band multiplier; ``z`` overrides it (the reference always used
1.96 whatever level was chosen).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.timefn import z_for_level
from ..session import SERIES
from .forecast import forecast_seasonal_naive, forecast_trend_seasonal
from .mlforecast import MLForecaster

BACKENDS = ("seasonal_naive", "trend_seasonal", "linear", "gbt")


class Forecaster:
    def __init__(
        self,
        backend: str = "trend_seasonal",
        horizon_days: int = 7,
        level: float = 90,
        z: float | None = None,
        step_seconds: int = 3600,
        test_size: float = 0.2,
        keys: Sequence[str] = (SERIES,),
        **ml_options,
    ):
        if backend not in BACKENDS:
            raise ValueError(f"backend must be one of {BACKENDS}")
        self.backend, self.horizon_days, self.step_seconds = backend, horizon_days, step_seconds
        self.z = float(z) if z is not None else z_for_level(level)
        self.test_size, self.keys, self.ml_options = test_size, list(keys), ml_options
        self._ml = None
        self._series = None

    def fit(self, series: DataFrame) -> Forecaster:
        """``series``: cleaned dense series with ``idx`` (e.g. from ``preprocess``)."""
        self._series = series
        if self.backend in ("linear", "gbt"):
            self._ml = MLForecaster(
                self.backend, self.horizon_days, self.step_seconds, self.test_size, self.z, self.keys, **self.ml_options
            ).fit(series)
        return self

    def forecast(self) -> tuple[DataFrame, DataFrame]:
        """``(forecast, metrics)``: test part with actual values and bands, future part with bands."""
        if self._series is None:
            raise RuntimeError("fit first")
        if self._ml is not None:
            return self._ml.forecast()
        fn = forecast_seasonal_naive if self.backend == "seasonal_naive" else forecast_trend_seasonal
        return fn(self._series, self.horizon_days, self.step_seconds, self.test_size, self.z, self.keys)

    def feature_importance(self) -> DataFrame | None:
        """``feature, importance`` for the learned backends; None for the seasonal ones (no inputs)."""
        return self._ml.feature_importance() if self._ml is not None else None
