"""Random frames, buckets and gaps: bucketed lags/rolling equal pandas."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.plans.rolling import Lag, Roll, ordered_features


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    n=st.integers(1, 260),
    k=st.integers(1, 90),
    extra=st.integers(0, 60),
    null_frac=st.sampled_from([0.0, 0.3, 0.9]),
    method=st.sampled_from(["ladder", "frame", "auto"]),
    seed=st.integers(0, 10_000),
)
def test_bucketed_rolling_matches_pandas(spark, n, k, extra, null_frac, method, seed):
    rng = np.random.default_rng(seed)
    vals = rng.normal(100, 30, n) * (10 ** rng.integers(0, 4))
    vals[rng.random(n) < null_frac] = np.nan
    pdf = pd.DataFrame({"series_id": "s", "idx": np.arange(n, dtype="int64"), "price": vals})
    df = spark.createDataFrame(pdf)
    outs = (("mean", "m"), ("std", "sd"), ("min", "lo"), ("max", "hi"))
    got = ordered_features(df, [Lag("lag", "price", k)], [Roll("price", k, outs)], bucket_rows=k + extra, method=method)
    got = got.orderBy("idx").toPandas()
    r = pdf["price"].rolling(k, min_periods=1)
    want = {"m": r.mean(), "sd": r.std(), "lo": r.min(), "hi": r.max(), "lag": pdf["price"].shift(k)}
    for c, w in want.items():
        np.testing.assert_allclose(got[c].astype(float), w.astype(float), rtol=1e-9, atol=1e-9 * np.nanmax(np.abs(vals)) if np.isfinite(vals).any() else 0, err_msg=c)
