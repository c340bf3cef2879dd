"""Random irregular stamps, gaps and tiny carry buckets: the fill equals pandas."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.fill import fill_time_linear


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    n=st.integers(1, 200),
    null_frac=st.sampled_from([0.0, 0.5, 0.95]),
    carry_rows=st.integers(1, 40),
    with_idx=st.booleans(),
    seed=st.integers(0, 10_000),
)
def test_fill_matches_pandas(spark, n, null_frac, carry_rows, with_idx, seed):
    rng = np.random.default_rng(seed)
    gaps = rng.integers(1, 7200, n)  # irregular seconds between rows
    ts = pd.Timestamp("2024-03-01") + pd.to_timedelta(np.cumsum(gaps), unit="s")
    vals = rng.normal(10, 3, n)
    vals[rng.random(n) < null_frac] = np.nan
    pdf = pd.DataFrame({"series_id": "s", "ts": ts, "price": vals, "idx": np.arange(n, dtype="int64")})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    if not with_idx:
        df = df.drop("idx")
    got = fill_time_linear(df, carry_rows=carry_rows).orderBy("ts").toPandas()["price"].astype(float).values
    s = pd.Series(vals, index=ts)
    want = s.interpolate(method="time").ffill().bfill().values if s.notna().any() else s.values
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)
