"""Sequence tensors, their use by the learned backends, and future inputs with drivers."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.forecast import future_features
from tidemark.operators.mlforecast import MLForecaster
from tidemark.operators.sequences import future_examples, last_rows, sequence_blocks, sequence_examples, sequence_names
from tidemark.plans.ordered import gather
from tidemark.sources.grids import future_grid

T0 = dt.datetime(2024, 1, 1)


def hourly(spark, lengths, holes=0.0, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s, n in lengths.items():
        load = 100 + 10 * np.sin(np.arange(n) / 7) + rng.normal(0, 1, n)
        price = 50 + 0.3 * np.roll(load, 3) + rng.normal(0, 1, n)
        for i in range(n):
            gone = rng.random(2) < holes
            rows.append((s, T0 + dt.timedelta(hours=i), i, None if gone[0] else float(price[i]), None if gone[1] else float(load[i])))
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, idx long, price double, load double"), pd.DataFrame(rows, columns=["series_id", "ts", "idx", "price", "load"])


@pytest.mark.parametrize("seq_len,block_rows", [(5, 8), (72, None), (1, 1)])
def test_examples_equal_plain_slices(spark, seq_len, block_rows):
    df, pdf = hourly(spark, {"long": 333, "as_long": seq_len, "one_more": seq_len + 1}, holes=0.2)
    blocks = sequence_blocks(df, ["price", "load"], "price", seq_len, block_rows=block_rows)
    got = {(r["series_id"], r["idx"]): r for r in sequence_examples(blocks, seq_len).collect()}
    n = 0
    for s, own in pdf.groupby("series_id"):
        x = own[["price", "load"]].astype(object).where(own[["price", "load"]].notna(), None).values.tolist()
        for i in range(seq_len, len(own)):
            r = got[s, i]
            assert r["X"] == x[i - seq_len : i] and r["y"] == x[i][0] and r["ts"] == T0 + dt.timedelta(hours=i)
            n += 1
    assert len(got) == n
    flat = sequence_examples(blocks, seq_len, flat=True).filter("series_id = 'one_more'").first()
    assert len(flat["X"]) == 2 * seq_len == len(sequence_names(["price", "load"], seq_len))


def test_a_row_is_stored_once_beside_the_halo(spark):
    df, _ = hourly(spark, {"a": 3000})
    blocks = sequence_blocks(df, ["price"], seq_len=72)
    per = blocks.select(F.size("rows").alias("n"), F.size(F.filter("rows", lambda r: r["own"])).alias("own")).collect()
    assert sum(r["own"] for r in per) == 3000 and max(r["n"] for r in per) <= 9 * 72 and sum(r["n"] for r in per) <= 3000 * 9 / 8 + 72


def test_future_examples_clamp_to_the_last_row(spark):
    df, pdf = hourly(spark, {"a": 40, "short": 3})
    out = future_examples(future_grid(df, 1, 3600), last_rows(df, ["price", "load"], 5), 5, flat=False).collect()
    x = pdf[pdf["series_id"] == "a"][["price", "load"]].values.tolist()
    assert {r["series_id"] for r in out} == {"a"} and len(out) == 24
    for r in out:
        assert r["X"] == [x[min(39, 40 + r["h"] - 5 + j)] for j in range(5)]


def test_gather_brings_many_columns_at_clamped_positions(spark):
    df, pdf = hourly(spark, {"a": 30, "b": 50})
    rows = spark.createDataFrame([(s, h) for s in ("a", "b", "none") for h in range(6)], "series_id string, h long")
    out = gather(rows, df, [("p3", "price", 3), ("l3", "load", 3), ("p60", "price", 60)], lambda k: F.greatest(F.lit(0), F.col("h") + 10 - k)).collect()
    at = {(r.series_id, r.idx): r for r in pdf.itertuples()}
    assert len(out) == 18
    for r in out:
        if r["series_id"] == "none":
            assert r["p3"] is r["l3"] is r["p60"] is None
        else:
            i = r["h"] + 7
            assert (r["p3"], r["l3"], r["p60"]) == (at[r["series_id"], i].price, at[r["series_id"], i].load, at[r["series_id"], 0].price)


def test_future_features_use_the_drivers_own_history(spark):
    df, pdf = hourly(spark, {"a": 60, "b": 200})
    out = future_features(df, 2, 3600, carry_cols=["load"]).toPandas()
    for s, own in pdf.groupby("series_id"):
        load, price, n = own["load"].values, own["price"].values, len(own)
        for r in out[out["series_id"] == s].itertuples():
            assert r.load_lag_24h == load[max(0, min(n - 1, n + r.h - 24))]
            assert r.price_lag_7d == price[max(0, min(n - 1, n + r.h - 168))]
            assert r.load == load[-1]
            np.testing.assert_allclose([r.load_rolling_mean_1d, r.load_rolling_std_1d], [load[-100:].mean(), load[-100:].std()])


def test_linear_backend_over_sequences_equals_least_squares(spark):
    df, pdf = hourly(spark, {"a": 300, "b": 260})
    m = MLForecaster("linear", 1, 3600, seq_len=6, drivers=["load"], context=False, reg=0.0).fit(df)
    rows, want, future = [], [], {}
    for s, own in pdf.groupby("series_id"):
        x, n = own[["price", "load"]].values, len(own)
        cut = n - int(np.ceil(n * 0.2))
        rows += [(x[i - 6 : i].ravel(), x[i, 0]) for i in range(6, cut)]
        want += [(s, i, x[i - 6 : i].ravel()) for i in range(cut, n)]
        future[s] = [np.array([x[min(n - 1, n + h - 6 + j)] for j in range(6)]).ravel() for h in range(24)]
    a = np.array([np.append(r, 1.0) for r, _ in rows])
    beta, *_ = np.linalg.lstsq(a, np.array([y for _, y in rows]), rcond=None)
    got = {r["feature"]: r["coefficient"] for r in m.coefficients().collect()}
    np.testing.assert_allclose([got[f] for f in [*sequence_names(["price", "load"], 6), "intercept"]], beta, rtol=1e-5, atol=1e-7)
    fc, metrics = m.forecast()
    out = {(r["series_id"], r["ts"]): r for r in fc.collect()}
    for s, i, x in want:
        np.testing.assert_allclose(out[s, T0 + dt.timedelta(hours=i)]["predicted"], np.append(x, 1.0) @ beta, rtol=1e-6)
    for s, xs in future.items():
        n = len(pdf[pdf["series_id"] == s])
        for h, x in enumerate(xs):
            r = out[s, T0 + dt.timedelta(hours=n + h)]
            assert r["actual"] is None
            np.testing.assert_allclose(r["predicted"], np.append(x, 1.0) @ beta, rtol=1e-6)
    assert len(out) == len(want) + 48 and {r["n"] for r in metrics.collect()} == {60, 52}
    assert m.feature_importance().count() == 12


def test_sequences_name_series_they_cannot_forecast(spark):
    df, _ = hourly(spark, {"a": 200, "b": 200, "short": 4})
    hole = df.withColumn("load", F.when((F.col("series_id") == "b") & (F.col("idx") == 198), None).otherwise(F.col("load")))
    m = MLForecaster("gbt", 1, 3600, seq_len=5, drivers=["load"], max_iter=3).fit(hole)
    assert {(r["series_id"], r["reason"]) for r in m.skipped.collect()} == {("b", "gap_in_last_rows"), ("short", "no_complete_train_row")}
    fc, _ = m.forecast()
    assert {r["series_id"] for r in fc.select("series_id").distinct().collect()} == {"a"}
    assert m.feature_importance().count() == len(m.names) == 10 + 8 + 2
    with pytest.raises(ValueError, match="seq_len"):
        MLForecaster("linear", drivers=["load"])
