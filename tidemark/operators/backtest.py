"""Walk-forward evaluation: expanding folds scored from fold statistics that merge.

The last ``folds`` blocks of ``n div (folds + 1)`` rows of a series are tested one after the other, each by a model of
all rows before it.  No fold is fitted from raw rows: every block of rows is reduced once to statistics, and the
model of a fold is the merge of the blocks before it.

* ``line``: least-squares line over the row position, from count, means and centred sums of a block;
* ``phase``: mean of the rows of the same phase (``idx % period``), from sum and count per phase.

Defined cases: a series of fewer than ``folds + 1`` rows has no folds; rows without a price neither teach nor are
scored; a phase that no row before taught is not predicted and not scored; a line needs two positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import materialize
from ..session import IDX, PRICE, SERIES, TS
from .evaluate import EPS


def with_folds(df: DataFrame, folds: int, keys: Sequence[str] = (SERIES,), idx: str = IDX) -> DataFrame:
    """Add ``fold``: 0 for the rows that no fold tests, 1..folds for the others; ``idx`` is the dense row position."""
    if folds < 1:
        raise ValueError("at least one fold")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > folds)
    size = F.expr(f"_n div {folds + 1}")
    start = F.col("_n") - folds * size
    block = F.floor((F.col(idx) - start) / size) + 1
    return df.join(n, list(keys)).withColumn("fold", F.greatest(F.lit(0), block).cast("int")).drop("_n")


def _line_models(rows: DataFrame, folds: int, keys: Sequence[str], idx: str, col: str) -> DataFrame:
    """``keys, fold, _slope, _mx, _my``: the lines through all blocks before a fold."""
    x, y = F.col(idx).cast("double"), F.col(col)
    blocks = rows.filter(y.isNotNull()).groupBy(*keys, "fold").agg(
        F.count(y).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        (F.var_pop(x) * F.count(y)).alias("sxx"), (F.covar_pop(x, y) * F.count(y)).alias("sxy"),
    )
    later = F.explode(F.sequence(F.col("fold") + 1, F.lit(folds)))
    parts = blocks.filter(F.col("fold") < folds).select(*keys, later.alias("for"), F.struct("n", "mx", "my", "sxx", "sxy").alias("b"))
    parts = parts.groupBy(*keys, F.col("for").alias("fold")).agg(F.collect_list("b").alias("bs"))  # at most one block per earlier fold
    total = lambda f: F.aggregate("bs", F.lit(0.0), lambda acc, b: acc + f(b))
    merged = parts.withColumn("_k", total(lambda b: b["n"])).select(
        "*", (total(lambda b: b["n"] * b["mx"]) / F.col("_k")).alias("_mx"), (total(lambda b: b["n"] * b["my"]) / F.col("_k")).alias("_my")
    )
    sxx = total(lambda b: b["sxx"] + b["n"] * (b["mx"] - F.col("_mx")) * (b["mx"] - F.col("_mx")))
    sxy = total(lambda b: b["sxy"] + b["n"] * (b["mx"] - F.col("_mx")) * (b["my"] - F.col("_my")))
    merged = merged.withColumn("_sxx", sxx).withColumn("_sxy", sxy)
    return merged.select(*keys, "fold", F.when(F.col("_sxx") > 0, F.col("_sxy") / F.col("_sxx")).alias("_slope"), "_mx", "_my")


def _phase_models(rows: DataFrame, folds: int, keys: Sequence[str], col: str) -> DataFrame:
    """``keys, fold, _phase, predicted``: the phase means over all blocks before a fold."""
    blocks = rows.filter(F.col(col).isNotNull() & (F.col("fold") < folds)).groupBy(*keys, "fold", "_phase").agg(F.sum(col).alias("s"), F.count(col).alias("n"))
    later = F.explode(F.sequence(F.col("fold") + 1, F.lit(folds)))
    merged = blocks.select(*keys, "_phase", "s", "n", later.alias("for")).groupBy(*keys, F.col("for").alias("fold"), "_phase")
    return merged.agg((F.sum("s") / F.sum("n")).alias("predicted"))


def walk_forward(
    df: DataFrame, folds: int = 5, model: str = "line", period: int = 168, keys: Sequence[str] = (SERIES,), ts: str = TS, idx: str = IDX, col: str = PRICE
) -> DataFrame:
    """``keys, ts, idx, fold, actual, predicted, model`` of every tested row that has a price and a prediction."""
    if model not in ("line", "phase"):
        raise ValueError(model)
    rows = materialize(with_folds(df.select(*keys, ts, idx, col), folds, keys, idx))
    tested = rows.filter((F.col("fold") > 0) & F.col(col).isNotNull())
    if model == "line":
        scored = tested.join(_line_models(rows, folds, keys, idx, col), [*keys, "fold"])
        scored = scored.withColumn("predicted", F.col("_my") + F.col("_slope") * (F.col(idx) - F.col("_mx")))
    else:
        phase = F.pmod(F.col(idx), F.lit(period))
        models = _phase_models(rows.withColumn("_phase", phase), folds, keys, col)
        scored = tested.withColumn("_phase", phase).join(models, [*keys, "fold", "_phase"])
    scored = scored.filter(F.col("predicted").isNotNull())
    return scored.select(*keys, ts, idx, F.col("fold").cast("long").alias("fold"), F.col(col).alias("actual"), "predicted", F.lit(model).alias("model"))


def fold_metrics(scored: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """``keys, model, fold, n, MAE, RMSE, MAPE`` (%) of the rows of :func:`walk_forward`."""
    e = F.col("predicted") - F.col("actual")
    return scored.groupBy(*keys, "model", "fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("MAE"),
        F.sqrt(F.avg(e * e)).alias("RMSE"),
        (F.avg(F.abs(e) / F.greatest(F.abs(F.col("actual")), F.lit(EPS))) * 100.0).alias("MAPE"),
    )
