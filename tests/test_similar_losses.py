"""Similar days against numpy and planted shapes; losses per iteration against sums of trees."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tests.test_sequences import hourly
from tidemark.operators.mlforecast import MLForecaster
from tidemark.operators.similar import cluster_days, day_vectors, similar_days

SCHEMA = "series_id string, ts timestamp_ntz, price double"
T0 = dt.datetime(2024, 1, 1)


def shapes(n_days, seed=4):
    """Days of three courses at different levels and scales, two rows an hour, some hours absent."""
    rnd = np.random.default_rng(seed)
    h = np.arange(24)
    course = [np.sin(h / 24 * 2 * np.pi), np.cos(h / 12 * 2 * np.pi), np.where(h < 8, -1.0, 0.5)]
    rows, kind, hours = [], {}, {}
    for d in range(n_days):
        kind[d] = int(rnd.integers(0, 3))
        v = 50 + 20 * rnd.random() + (1 + 9 * rnd.random()) * (course[kind[d]] + rnd.normal(0, 0.03, 24))
        hours[d] = np.where(rnd.random(24) < 0.04, np.nan, v)
        for j in range(24):
            if not np.isnan(hours[d][j]):
                rows += [("a", T0 + dt.timedelta(days=d, hours=j, minutes=m), float(hours[d][j] + (m - 15) / 100)) for m in (0, 30)]
    return rows, kind, hours


def shape_of(v):
    z = (v - np.nanmean(v)) / np.nanstd(v)
    return np.nan_to_num(z)


def test_vectors_and_nearest_days_equal_numpy(spark):
    rows, _, hours = shapes(60)
    days = day_vectors(spark.createDataFrame(rows, SCHEMA))
    for r in days.collect():
        v = hours[(r["day"] - T0.date()).days]
        assert r["n_present"] == np.sum(~np.isnan(v)) and r["level"] == pytest.approx(np.nanmean(v)) and r["spread"] == pytest.approx(np.nanstd(v))
        np.testing.assert_allclose(r["shape"], shape_of(v), atol=1e-9)
        assert [x is None for x in r["vector"]] == np.isnan(v).tolist()
    got = similar_days(days, 7).orderBy("place").collect()
    far = sorted((round(float(np.linalg.norm(shape_of(hours[d]) - shape_of(hours[59]))), 9), -d) for d in range(59))
    assert [(T0.date() + dt.timedelta(days=-d)) for _, d in far[:7]] == [r["day"] for r in got]
    np.testing.assert_allclose([r["distance"] for r in got], [x for x, _ in far[:7]], atol=2e-9)


def test_given_targets_and_ties(spark):
    rows = [(s, T0 + dt.timedelta(days=d, hours=j), float(j % 5)) for s in "ab" for d in range(6) for j in range(24)]
    days = day_vectors(spark.createDataFrame(rows, SCHEMA))
    day = lambda d: T0.date() + dt.timedelta(days=d)
    targets = spark.createDataFrame([("a", day(3)), ("a", day(0)), ("b", day(2)), ("c", day(2))], "series_id string, target date")
    got = {(r["series_id"], r["target"], r["day"], r["place"]) for r in similar_days(days, 2, targets).collect()}
    assert got == {("a", day(3), day(2), 1), ("a", day(3), day(1), 2), ("b", day(2), day(1), 1), ("b", day(2), day(0), 2)}


def test_clusters_are_the_planted_courses_and_every_day_has_one(spark):
    rows, kind, _ = shapes(120)
    empty = [("a", T0 + dt.timedelta(days=500), None), ("a", T0 + dt.timedelta(days=501), float("nan"))]
    got = cluster_days(day_vectors(spark.createDataFrame(rows + empty, SCHEMA)), k=3).collect()
    assert len(got) == 122 and [r["cluster"] for r in got if not r["n_present"]] == [None, None]
    pairs = {(r["cluster"], kind[(r["day"] - T0.date()).days]) for r in got if r["n_present"]}
    assert len(pairs) == 3 and len({c for c, _ in pairs}) == 3
    centre = {c: np.mean([r["shape"] for r in got if r["cluster"] == c], axis=0) for c, _ in pairs}
    for r in got:
        if r["n_present"]:
            assert r["cluster"] == min(centre, key=lambda c: np.linalg.norm(np.array(r["shape"]) - centre[c]))


def test_flat_days_and_no_rows(spark):
    rows = [("a", T0 + dt.timedelta(hours=j), 0.1) for j in range(24)]
    one = day_vectors(spark.createDataFrame(rows, SCHEMA)).first()
    assert one["n_present"] == 24 and one["shape"] == [0.0] * 24
    none = spark.createDataFrame([], SCHEMA)
    assert day_vectors(none).count() == 0 and cluster_days(day_vectors(none)).count() == 0 and similar_days(day_vectors(none)).count() == 0


def test_losses_of_the_tree_backend_are_those_of_its_first_trees(spark):
    df, _ = hourly(spark, {"a": 500, "b": 420})
    m = MLForecaster("gbt", 1, 3600, max_iter=6).fit(df)
    got = m.loss_history().collect()
    last = m.model.stages[-1]
    assert {r["part"] for r in got} == {"train", "validation", "test"}
    ready = PipelineModel(m.model.stages[:-1]).transform(m._train.filter("_val")).select("_raw", "price").collect()
    sums = np.zeros(len(ready))
    for i, (tree, w) in enumerate(zip(last.trees, last.treeWeights), 1):
        sums += w * np.array([tree.predict(r["_raw"]) for r in ready])
        loss = next(r["loss"] for r in got if r["part"] == "validation" and r["iteration"] == i)
        assert loss == pytest.approx(np.mean((sums - np.array([r["price"] for r in ready])) ** 2))
    held = {r["iteration"]: r for r in got if r["part"] == "validation"}
    assert len(held) == last.getNumTrees and [i for i, r in held.items() if r["best"]] == [min(held, key=lambda i: (held[i]["loss"], i))]
    assert held[len(held)]["best"]  # the model ends where the validation loss is lowest


def test_losses_of_the_linear_backend(spark):
    df, _ = hourly(spark, {"a": 300})
    m = MLForecaster("linear", 1, 3600).fit(df)
    got = {r["part"]: r for r in m.loss_history().collect()}
    fc, _ = m.forecast()
    tested = fc.filter(F.col("actual").isNotNull()).agg(F.avg((F.col("actual") - F.col("predicted")) ** 2)).first()[0]
    assert set(got) == {"train", "test"} and got["test"]["loss"] == pytest.approx(tested) and all(r["best"] for r in got.values())
