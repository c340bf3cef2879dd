"""Learned forecasters on ``pyspark.ml`` (F1, F2, F7, F8): one model over all series.

Inputs of row ``t`` (no look-ahead): price lags of 1, 3, 6, 12, 24 hours and
7 days, the 1-day rolling mean and sample std of row ``t-1``, the calendar
of row ``t``, and the level and scale of the series' train part.  The
train part is the first ``n - ceil(test_size * n)`` rows of each series; the
test part is scored one step ahead from actual history; future rows take
lags from history clamped to its last row and rolling values of the window
that ends there (predictions are never fed back), so every row is
independent and scoring is one ``transform``.  After ``fit``, ``skipped`` holds
``(series_id, reason)`` of every series without a forecast, and ``loss_history`` has
the loss after every iteration.

With ``seq_len`` the inputs are instead the last ``seq_len`` rows of price and ``drivers`` as one vector (``sequences``:
rows are packed once per block, the vector is cut out of the block), beside the calendar and the level; future rows
take the last history rows, clamped.

Backends: ``linear`` (``LinearRegression``, standardised inputs) and ``gbt``
(``GBTRegressor`` with a validation split of the train part for early stop).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import gather, materialize
from ..plans.rolling import Lag, Roll, ordered_features
from ..session import IDX, PRICE, SERIES, TS
from .clean import flag_extreme
from .evaluate import forecast_metrics, future_bands, historical_bands
from .features import lag_rows, rows_in, temporal_features
from .forecast import combine_forecast
from .sequences import future_examples, last_rows, sequence_blocks, sequence_examples, sequence_names
from ..sources.grids import future_grid

CAL_INPUTS = ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos", "is_weekend", "is_business_hour"]
SERIES_INPUTS = ["series_level", "series_scale"]  # mean and deviation of a series' train part: identity for any number of series


def _lag_list(step_seconds: int) -> list[tuple[str, int]]:
    return [(f"lag_{name}", k) for name, k in lag_rows(step_seconds, days=[7])]


def _window_rows(step_seconds: int) -> int:
    """Rows of the 1-day rolling inputs; at least two, so that a deviation exists."""
    return max(2, rows_in(86400, step_seconds))


def model_inputs(step_seconds: int = 3600) -> list[str]:
    return [n for n, _ in _lag_list(step_seconds)] + ["roll_mean_1d", "roll_std_1d"] + CAL_INPUTS + SERIES_INPUTS


def history_frame(series: DataFrame, step_seconds: int = 3600, keys: Sequence[str] = (SERIES,), ts: str = TS, idx: str = IDX) -> DataFrame:
    """Inputs for every history row (one bucketed window pass, one shuffle)."""
    lags = [Lag(n, PRICE, k) for n, k in _lag_list(step_seconds)]
    d = ordered_features(
        series.select(*keys, ts, idx, PRICE),
        lags=lags,
        rolls=[Roll(PRICE, _window_rows(step_seconds), (("mean", "_rm"), ("std", "_rs")))],
        keys=keys,
        idx=idx,
        post_lags=[Lag("roll_mean_1d", "_rm", 1), Lag("roll_std_1d", "_rs", 1)],  # statistics of row t-1
    ).drop("_rm", "_rs")
    return temporal_features(d, ts)


def future_frame(series: DataFrame, horizon_days: int, step_seconds: int = 3600, keys: Sequence[str] = (SERIES,), ts: str = TS, idx: str = IDX) -> DataFrame:
    """Inputs for the future rows: clamped history lags, rolling values of the window before the first of them."""
    n = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(idx).alias("_last"))
    grid = future_grid(series, horizon_days, step_seconds, keys, ts).join(n, list(keys))
    lags = _lag_list(step_seconds)
    kmax = max(k for _, k in lags)
    tail = series.join(n, list(keys)).filter((F.col(idx) >= F.col("_n") - kmax) | (F.col(idx) == 0))
    clamped = lambda k: F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.col("_n") + F.col("h") - k))
    out = gather(grid, tail, [(name, PRICE, k) for name, k in lags], clamped, keys, idx)
    recent = series.join(n, list(keys)).filter(F.col(idx) > F.col("_last") - _window_rows(step_seconds))
    stats = recent.groupBy(*keys).agg(F.avg(PRICE).alias("roll_mean_1d"), F.stddev_samp(PRICE).alias("roll_std_1d"))
    out = out.join(stats, list(keys), "left").withColumn(idx, F.col("_n") + F.col("h")).drop("_n", "_last")
    return temporal_features(out, ts)


class MLForecaster:
    """``fit`` on the train part of every series, ``forecast`` test + future rows."""

    def __init__(self, backend: str = "linear", horizon_days: int = 7, step_seconds: int = 3600, test_size: float = 0.2,
                 z: float = 1.96, keys: Sequence[str] = (SERIES,), max_iter: int = 50, seed: int = 7, seq_len: int | None = None,
                 drivers: Sequence[str] = (), context: bool = True, reg: float = 1e-3):
        """``seq_len`` rows of price and ``drivers`` as inputs; ``context=False`` leaves out calendar and level; ``reg``: ridge weight."""
        if backend not in ("linear", "gbt"):
            raise ValueError(backend)
        if drivers and not seq_len:
            raise ValueError("drivers are inputs of sequences: give seq_len too")
        self.backend, self.horizon_days, self.step_seconds = backend, horizon_days, step_seconds
        self.test_size, self.z, self.keys, self.max_iter, self.seed = test_size, z, list(keys), max_iter, seed
        self.seq_len, self.columns, self.reg = seq_len, [PRICE, *drivers], reg
        self.model = None
        extra = CAL_INPUTS + SERIES_INPUTS if context else []
        # assembled columns, and the name of each place of the assembled vector
        self.inputs = ["sequence", *extra] if seq_len else model_inputs(step_seconds)
        self.names = [*sequence_names(self.columns, seq_len), *extra] if seq_len else list(self.inputs)

    def _history(self, series: DataFrame) -> DataFrame:
        """Inputs of every history row that has them."""
        if not self.seq_len:
            return history_frame(series, self.step_seconds, self.keys)
        blocks = sequence_blocks(series, self.columns, PRICE, self.seq_len, self.keys)
        rows = sequence_examples(blocks, self.seq_len, self.keys, flat=True).withColumnRenamed("y", PRICE)
        return temporal_features(self._vectors(rows), TS)

    def _future(self, series: DataFrame) -> DataFrame:
        """Inputs of the future rows."""
        if not self.seq_len:
            return future_frame(series, self.horizon_days, self.step_seconds, self.keys).fillna(0.0, subset=["roll_std_1d"])
        grid = future_grid(series, self.horizon_days, self.step_seconds, self.keys)
        rows = future_examples(grid, last_rows(series, self.columns, self.seq_len, self.keys), self.seq_len, self.keys)
        return temporal_features(self._vectors(rows), TS)

    def _vectors(self, rows: DataFrame) -> DataFrame:
        """Flat examples without a NULL as ML vectors."""
        whole = ~F.exists("X", lambda v: v.isNull() | F.isnan(v))
        return rows.filter(whole).withColumn("sequence", array_to_vector("X")).drop("X")

    def _stages(self):
        stages = [VectorAssembler(inputCols=list(self.inputs), outputCol="_raw", handleInvalid="error")]
        if self.backend == "linear":
            stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
            stages.append(LinearRegression(featuresCol="features", labelCol=PRICE, maxIter=self.max_iter, regParam=self.reg, elasticNetParam=0.0))
        else:
            stages.append(
                GBTRegressor(featuresCol="_raw", labelCol=PRICE, maxIter=self.max_iter, maxDepth=5, seed=self.seed,
                             validationIndicatorCol="_val", validationTol=0.01)
            )
        return stages

    def _split(self, frame: DataFrame, series: DataFrame) -> DataFrame:
        n = series.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"))
        return frame.join(n, self.keys).withColumn("_m", F.col("_n") - F.ceil(F.col("_n") * self.test_size))

    def _levels(self, series: DataFrame) -> DataFrame:
        """Level and scale of each series' train part."""
        train = self._split(series.select(*self.keys, IDX, PRICE), series).filter(F.col(IDX) < F.col("_m"))
        return train.groupBy(*self.keys).agg(F.avg(PRICE).alias("series_level"), F.stddev_pop(PRICE).alias("series_scale"))

    def fit(self, series: DataFrame) -> MLForecaster:
        # series with |price| > 1e10 are flagged and left out of the fit (never replaced by invented values)
        extreme = flag_extreme(series, keys=self.keys).filter(F.col("is_extreme")).select(*self.keys).distinct()
        every = series.select(*self.keys).distinct()
        series = series.join(extreme, self.keys, "left_anti")
        frame = self._split(self._history(series), series)
        self._level_table = materialize(self._levels(series))  # one row per series
        frame = frame.join(self._level_table, self.keys)
        train = frame.filter((F.col(IDX) < F.col("_m")) & F.col(PRICE).isNotNull()).dropna(subset=self._scalars())
        reasons = extreme.withColumn("reason", F.lit("extreme_price")).unionByName(
            every.join(extreme, self.keys, "left_anti").join(train.select(*self.keys).distinct(), self.keys, "left_anti").withColumn("reason", F.lit("no_complete_train_row"))
        )
        if self.seq_len:  # the last rows are the input of every future row
            tails = last_rows(series, self.columns, self.seq_len, self.keys)
            holes = tails.filter(F.exists("tail", lambda row: F.exists(row, lambda v: v.isNull() | F.isnan(v)))).select(*self.keys)
            reasons = reasons.unionByName(holes.join(reasons.select(*self.keys), self.keys, "left_anti").withColumn("reason", F.lit("gap_in_last_rows")))
        self.skipped = materialize(reasons)
        if self.backend == "gbt":
            # last tenth of each series' train part validates (early stop)
            train = train.withColumn("_val", F.col(IDX) >= F.col("_m") - F.ceil((F.col("_m")) * 0.1))
        self.model = Pipeline(stages=self._stages()).fit(train)
        self._train = train
        # a series that no complete row teaches is not forecast either; ``skipped`` names it
        self._series = series.join(self.skipped.select(*self.keys), self.keys, "left_anti")
        return self

    def _scalars(self) -> list[str]:
        """Assembled columns that are numbers (a sequence has no NULL)."""
        return [c for c in self.inputs if c != "sequence"]

    def forecast(self) -> tuple[DataFrame, DataFrame]:
        """``(forecast table, metrics)`` as the seasonal backends return them."""
        scored = self.model.transform(self._test()).select(*self.keys, TS, F.col(PRICE).alias("actual"), F.col("prediction").alias("predicted"))
        fut = self._future(self._series).join(self._level_table, self.keys)
        fut = fut.dropna(subset=self._scalars())
        fpred = self.model.transform(fut).select(*self.keys, TS, F.col("prediction").alias("predicted"))
        tested = historical_bands(scored, self.z, self.keys)
        future = future_bands(fpred, self.z)
        fc = combine_forecast(
            tested.select(*self.keys, TS, "actual", "predicted", "lower", "upper"),
            future.select(*self.keys, TS, "predicted", "lower", "upper"),
        ).withColumn("model", F.lit(self.backend))
        metrics = forecast_metrics(tested, self.keys).withColumn("model", F.lit(self.backend))
        return fc, metrics

    def _test(self) -> DataFrame:
        """Complete rows of the test part of every series."""
        frame = self._split(self._history(self._series), self._series).join(self._level_table, self.keys)
        return frame.filter(F.col(IDX) >= F.col("_m")).dropna(subset=self._scalars())

    def loss_history(self) -> DataFrame:
        """``backend, part, iteration, loss, best``: mean squared error after every iteration, from 1.

        Parts: ``train`` (rows that are fitted), ``validation`` (``gbt``: rows that stop it) and ``test``.  The ``gbt`` model ends at
        the iteration with the lowest validation loss; ``linear`` solves the normal equations in one.  ``best`` marks the lowest loss
        of a part, ties to the earliest; a part without rows has none.  Each part is read once, whatever the number of iterations.
        """
        parts = {"train": self._train, "test": self._test().filter(F.col(PRICE).isNotNull())}
        if self.backend == "gbt":
            parts |= {"train": self._train.filter(~F.col("_val")), "validation": self._train.filter("_val")}
        last, rows = self.model.stages[-1], []
        for part, frame in parts.items():
            if self.backend == "gbt":
                ready = PipelineModel(self.model.stages[:-1]).transform(frame)
                losses = [] if ready.isEmpty() else last.evaluateEachIteration(ready, "squared")
            else:
                mean = self.model.transform(frame).agg(F.avg((F.col("prediction") - F.col(PRICE)) ** 2)).first()[0]
                losses = [] if mean is None else [mean]
            rows += [(self.backend, part, i, float(x), i == losses.index(min(losses)) + 1) for i, x in enumerate(losses, 1)]  # a number per iteration
        return self._series.sparkSession.createDataFrame(rows, "backend string, part string, iteration long, loss double, best boolean")

    def feature_importance(self) -> DataFrame:
        """``feature, importance``: GBT split importances, or |standardised coefficient| shares."""
        spark = self._series.sparkSession
        last = self.model.stages[-1]
        names = self.names
        if self.backend == "gbt":
            vals = last.featureImportances.toArray().tolist()
        else:
            coef = [abs(c) for c in last.coefficients.toArray().tolist()]
            tot = sum(coef) or 1.0
            vals = [c / tot for c in coef]
        rows = list(zip(names, vals[: len(names)]))
        return spark.createDataFrame(rows, "feature string, importance double")

    def coefficients(self) -> DataFrame:
        """``feature, coefficient`` of the linear backend in the inputs' own units, with the ``intercept``."""
        if self.backend != "linear":
            raise ValueError("only the linear backend has coefficients")
        scaler, last = self.model.stages[-2], self.model.stages[-1]
        slopes = [c / s if s else 0.0 for c, s in zip(last.coefficients.toArray().tolist(), scaler.std.toArray().tolist())]
        shift = sum(b * m for b, m in zip(slopes, scaler.mean.toArray().tolist()))
        rows = [*zip(self.names, slopes), ("intercept", float(last.intercept) - shift)]
        return self._series.sparkSession.createDataFrame(rows, "feature string, coefficient double")
