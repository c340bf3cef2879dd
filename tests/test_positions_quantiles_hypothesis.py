"""Random densities and value distributions: time positions and exact quantiles."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans.ordered import time_position

HS = dict(deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@settings(max_examples=6, **HS)
@given(n=st.integers(1, 400), per_bucket=st.integers(1, 50), burst=st.booleans(), seed=st.integers(0, 9999))
def test_time_position_equals_row_number(spark, n, per_bucket, burst, seed):
    rng = np.random.default_rng(seed)
    gaps = rng.exponential(60, n) * (rng.random(n) < 0.1 if burst else 1) + 1
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(gaps).round(), unit="s")
    pdf = pd.DataFrame({"series_id": rng.choice(["a", "b"], n), "ts": ts, "k": np.arange(n)})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = time_position(df, "ts", tie=["k"], rows_per_bucket=per_bucket).select("k", "idx")
    w = Window.partitionBy("series_id").orderBy("ts", "k")
    want = df.select("k", (F.row_number().over(w) - 1).alias("idx"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@settings(max_examples=6, **HS)
@given(
    n=st.integers(1, 3000),
    ties=st.booleans(),
    accuracy=st.sampled_from([20, 100, 100_000]),
    seed=st.integers(0, 9999),
)
def test_bracket_quantiles_equal_pandas(spark, n, ties, accuracy, seed):
    rng = np.random.default_rng(seed)
    vals = rng.lognormal(2, 1, n)
    if ties:
        vals = np.round(vals)
    pdf = pd.DataFrame({"series_id": "s", "price": vals})
    got = exact_quantiles(spark.createDataFrame(pdf), "price", [0.1, 0.25, 0.75], accuracy=accuracy).first()
    for p, c in ((0.1, "q10"), (0.25, "q25"), (0.75, "q75")):
        assert abs(getattr(got, c) - pdf.price.quantile(p)) <= 1e-9 * max(1.0, abs(pdf.price.quantile(p)))
