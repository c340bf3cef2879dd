"""Rank correlation against pandas, walk-forward folds against a refit per fold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.backtest import fold_metrics, walk_forward, with_folds
from tidemark.operators.selection import average_ranks, select_features, spearman


def table(spark, seed=3, n=700):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(0, 1, n)
    pdf = pd.DataFrame({"series_id": np.where(np.arange(n) % 3, "a", "b"), "price": np.round(x * 4) / 4, "same": 1.0, "ties": rnd.integers(0, 4, n).astype(float)})
    pdf["monotone"] = np.exp(pdf["price"])
    pdf["noisy"] = x + rnd.normal(0, 1, n)
    pdf.loc[::7, "noisy"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("noisy", F.when(~F.isnan("noisy"), F.col("noisy")))
    return pdf, df


def test_spearman_equals_pandas_with_ties_and_gaps(spark):
    pdf, df = table(spark)
    features = ["same", "ties", "monotone", "noisy"]
    got = {(r["series_id"], r["feature"]): (r["n"], r["rho"]) for r in spearman(df, features).collect()}
    assert len(got) == 8
    for (series, feature), (n, rho) in got.items():
        g = pdf[pdf["series_id"] == series][[feature, "price"]].dropna()
        assert n == len(g)
        if feature == "same":
            assert rho is None
        else:  # the correlation of average ranks is Spearman's coefficient
            r = g.rank(method="average")
            assert rho == pytest.approx(np.corrcoef(r[feature], r["price"])[0, 1], abs=1e-12)


def test_average_ranks_over_many_cuts(spark):
    rnd = np.random.default_rng(1)
    values = pd.Series(np.concatenate([rnd.normal(0, 1, 3000), np.zeros(1500), [-0.5] * 200]))
    counts = values.value_counts().reset_index()
    counts.columns = ["value", "n"]
    got = average_ranks(spark.createDataFrame(counts.assign(g="g")), ["g"]).toPandas().set_index("value")["rank"]
    want = values.rank(method="average").groupby(values).first()
    assert len(got) == len(want) and np.array_equal(got.sort_index().to_numpy(), want.sort_index().to_numpy())


def test_selection_orders_by_strength_then_name(spark):
    _, df = table(spark)
    df = df.withColumn("also", -F.col("monotone"))
    rows = select_features(df, ["same", "ties", "monotone", "also", "noisy"], least=0.3, top=2).filter("series_id = 'a'").orderBy("place").collect()
    assert [r["feature"] for r in rows] == ["also", "monotone", "noisy", "ties", "same"]
    assert [r["selected"] for r in rows] == [True, True, False, False, False]
    assert select_features(df.limit(0), ["ties"]).count() == 0


def series(spark, sizes, seed=5):
    rnd = np.random.default_rng(seed)
    pdf = pd.concat([pd.DataFrame({"series_id": s, "idx": np.arange(n), "price": 1e6 + np.arange(n) * 0.3 + rnd.normal(0, 2, n)}) for s, n in sizes.items()])
    pdf.loc[pdf["idx"] % 11 == 5, "price"] = np.nan
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf["idx"], unit="h")
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return pdf, df.withColumn("price", F.when(~F.isnan("price"), F.col("price")))


def test_folds_are_the_last_equal_blocks(spark):
    _, df = series(spark, {"a": 23, "tiny": 4, "even": 24})
    got = with_folds(df, 5).groupBy("series_id", "fold").count().toPandas()
    sizes = lambda s: got[got["series_id"] == s].sort_values("fold")["count"].tolist()
    assert sizes("a") == [8, 3, 3, 3, 3, 3] and sizes("even") == [4] * 6 and sizes("tiny") == []


@pytest.mark.parametrize("model", ["line", "phase"])
def test_merged_statistics_equal_a_refit_per_fold(spark, model):
    pdf, df = series(spark, {"a": 400, "b": 77})
    scored = walk_forward(df, 4, model, period=24).toPandas()
    folds = with_folds(df, 4).toPandas()
    for (s, k), g in scored.groupby(["series_id", "fold"]):
        train = folds[(folds["series_id"] == s) & (folds["fold"] < k)].dropna(subset=["price"])
        if model == "line":
            b, a = np.polyfit(train["idx"] - 200.0, train["price"], 1)
            want = a + b * (g["idx"] - 200.0)
        else:
            want = g["idx"].mod(24).map(train.groupby(train["idx"] % 24)["price"].mean())
        np.testing.assert_allclose(g["predicted"].to_numpy(float), want.to_numpy(float), rtol=1e-9)
    assert scored["actual"].notna().all()
    m = fold_metrics(walk_forward(df, 4, model, period=24)).toPandas()
    one = scored[(scored["series_id"] == "a") & (scored["fold"] == 2)]
    row = m[(m["series_id"] == "a") & (m["fold"] == 2)].iloc[0]
    assert row["n"] == len(one) and row["MAE"] == pytest.approx((one["predicted"] - one["actual"]).abs().mean())
    with pytest.raises(ValueError):
        walk_forward(df, 4, "other")
    assert walk_forward(df.limit(0), 4, model).count() == 0
