import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk_search as K


def brute(rows, k, every, scale=64.0):
    ok = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, tuple(math.floor(scale * x) for x in v)))
    out = set()
    asked = {}
    for i, v in ok:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, a in asked.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 3, 1) for i, v in rows], "vec_id long, embedding array<double>, score int, d int")


def run(spark, rows, k, every, **o):
    got = K.top_k(table(spark, rows), F.col("vec_id") % every == 0, k, **o).collect()
    out = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got}
    assert len(out) == len(got)
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(12)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(120)]  # one vector very often: ties
    rows += [(500, None), (501, []), (502, [None] * 12), (503, [math.nan] + [0.1] * 11), (504, [math.inf] + [0.1] * 11), (None, [0.1] * 12), (505, [0.1, 0.2]), (510, [0.3, 0.4]), (520, [-0.3, 0.4]), (530, [1.0] * 5)]
    want = brute(rows, 7, 10)
    assert run(spark, rows, 7, 10) == want
    monkeypatch.setattr(K, "BLOCK", 50)
    monkeypatch.setattr(K, "QUERY_BLOCK", 8)
    assert run(spark, rows, 7, 10, slices=3) == want


def test_large_components_are_exact_and_few_candidates_give_all(spark):
    rows = [(i, [float(2**19 - i), float(-(2**18)), 3.7]) for i in range(5)]
    assert run(spark, rows, 20, 2) == brute(rows, 20, 2)


def test_no_vector_is_left_out_for_its_size(spark):
    rnd = random.Random(8)
    rows = [(0, [1.0, 0.5]), (1, [2e6, 1.0]), (2, [0.25, -3.0]), (20, [1e7, -1e7])]
    want = brute(rows, 20, 20)
    assert run(spark, rows, 20, 20) == want and len(want) == 6
    # sums that doubles, or partial sums that longs, do not hold
    rows += [(i, [rnd.choice([1, -1]) * rnd.uniform(1e5, 6e6), rnd.uniform(-6e6, 6e6)]) for i in range(21, 90)]
    assert run(spark, rows, 5, 3) == brute(rows, 5, 3)
    rows = [(0, [1e9, 1e9, 3.0])] + [(i, [x, -x + rnd.randint(-5, 5), rnd.uniform(-9, 9)]) for i in range(1, 30) for x in [rnd.uniform(1e8, 1e9)]]
    assert run(spark, rows, 5, 1000) == brute(rows, 5, 1000)


def test_what_no_long_holds_is_an_error(spark):
    with pytest.raises(Exception, match="does not fit into a long"):
        run(spark, [(0, [1e300]), (1, [1.0])], 3, 2)
    with pytest.raises(Exception, match="does not fit into a long"):
        run(spark, [(0, [1e12]), (1, [1e12])], 3, 2)


def test_empty(spark):
    assert run(spark, [], 5, 2) == set()
