"""Lags and trailing rolling statistics over row frames, in one bucketed pass and one window order.

``rows between k-1 preceding and current row`` with ``min_periods = 1``
(pandas ``rolling(window=k, min_periods=1)``): mean, sample or population
std, min, max over the present values of the last ``k`` rows.

Two physical methods give the same numbers:

* ``frame``: Spark's sliding frame.  Spark re-aggregates the frame for each
  row, O(k) per row; fine for short frames.
* ``ladder``: O(log k) per row.  A unit frame (the largest common divisor of the frame lengths up to
  ``UNIT_MAX`` rows) is a sliding frame; each rung merges ``RADIX`` of the one below, a row's own and those of
  the rows one and more rung lengths before; a frame is the merge of the rungs in its length's form to the base ``RADIX``.
  A rung holds count, mean, sum of squared deviations, min and max, merged with the
  parallel-variance formula, so no sum is ever subtracted: precision is that of a direct frame
  aggregate, whatever a series holds elsewhere.  All of it - lags too - is ``lag`` over one
  ``(series_id, bucket) order by idx``, so rows are sorted once for all columns and lengths.

``auto`` takes the ladder for a column with a frame over ``FRAME_MAX`` rows.  Everything runs
per ``(series_id, bucket)`` with halo rows (see :mod:`.ordered`), so a long
series is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import IDX, SERIES
from .ordered import BUCKET, bucket_rows_for, drop_halo, with_halo

STATS = ("mean", "std", "min", "max")


@dataclass(frozen=True)
class Lag:
    out: str
    col: str
    k: int


@dataclass(frozen=True)
class Roll:
    """Trailing frame of ``k`` rows over ``col``; ``outs`` maps stat -> column name."""

    col: str
    k: int
    outs: tuple  # tuple of (stat, out_name)
    ddof: int = 1


# ``auto``: Spark's frame where no frame of the column is longer, the ladder beyond.
FRAME_MAX = 64
UNIT_MAX = 8
# Rungs that the next one is made of.  With more, the generated method of a step outgrows the 8,000 bytes that the JVM compiles.
RADIX = 3


def ordered_features(
    df: DataFrame,
    lags: Sequence[Lag] = (),
    rolls: Sequence[Roll] = (),
    keys: Sequence[str] = (SERIES,),
    idx: str = IDX,
    bucket_rows: int | None = None,
    method: str = "auto",
    post_lags: Sequence[Lag] = (),
) -> DataFrame:
    """Add lag and rolling columns; ``idx`` must be the dense row position.

    ``post_lags`` lag columns computed in this pass (e.g. a rolling mean of the
    previous row) inside the same buckets: the halo reaches that much further
    back, and no second shuffle is needed.
    """
    post = max([lg.k for lg in post_lags] + [0])
    back = max([lg.k for lg in lags] + [r.k + post for r in rolls] + [1 + post])
    B = bucket_rows or bucket_rows_for(back)
    d = with_halo(df, back, 0, B, idx)
    w = Window.partitionBy(*keys, BUCKET).orderBy(idx)

    longest = {r.col: max([x.k for x in rolls if x.col == r.col]) for r in rolls}
    by_ladder = lambda r: method == "ladder" or (method == "auto" and longest[r.col] > FRAME_MAX)
    frames = [
        _frame_stat(stat, F.col(r.col), r.ddof).over(w.rowsBetween(-(r.k - 1), 0)).alias(out)
        for r in rolls if not by_ladder(r) for stat, out in r.outs
    ]
    lagged = [F.lag(lg.col, lg.k).over(w).alias(lg.out) for lg in lags]
    # lags and frames come after the ladder: a window step between its merges and the caller's columns keeps the generated
    # method of either short enough to be compiled
    d = _ladder(d, [r for r in rolls if by_ladder(r)], w).select("*", *lagged, *frames)
    if post_lags:
        d = d.select("*", *[F.lag(lg.col, lg.k).over(w).alias(lg.out) for lg in post_lags])
    return drop_halo(d)


def _frame_stat(stat: str, c, ddof: int):
    if stat == "mean":
        return F.avg(c)
    if stat == "std":
        return F.stddev_samp(c) if ddof == 1 else F.stddev_pop(c)
    if stat == "min":
        return F.min(c)
    if stat == "max":
        return F.max(c)
    if stat == "sum":
        return F.sum(c)
    if stat == "count":
        return F.count(c)
    raise ValueError(stat)


def _ladder(d: DataFrame, rolls: Sequence[Roll], w: WindowSpec) -> DataFrame:
    """``d`` with the columns of ``rolls``, merged from rungs.

    One window step per rung: it looks up the rungs before that make the next one and those that the frames need; the merges
    follow at once.  The statistics lie in plain columns (``_r<column>_<part>``, ``_f<frame>_<part>``), for a lag copies a plain
    number much faster than a struct.
    """
    cols = list(dict.fromkeys(r.col for r in rolls))
    units: dict[str, int] = {}
    for c in cols:
        common = reduce(gcd, [r.k for r in rolls if r.col == c])
        units[c] = max(u for u in range(1, min(common, UNIT_MAX) + 1) if common % u == 0)
    parts = {c: _parts({stat for r in rolls if r.col == c for stat, _ in r.outs}) for c in cols}
    rung = {c: f"_r{j}" for j, c in enumerate(cols)}
    kept = d.columns
    d = d.select("*", *[e.alias(f"{rung[c]}_{p}") for c in cols for p, e in _unit(c, units[c], w, parts[c]).items()])
    digits = [_digits(r.k // units[r.col]) for r in rolls]
    top = {c: max(len(digits[i]) for i, r in enumerate(rolls) if r.col == c) - 1 for c in cols}
    reach = [0] * len(rolls)  # rows that a frame holds so far, from the row itself backwards
    for level in range(max([-1, *top.values()]) + 1):
        at = lambda c, back: f"{rung[c]}_at{back}" if back else rung[c]
        merged: dict[str, tuple[str, list[str]]] = {}  # what the step makes: column and the pieces
        looked: dict[tuple[str, int], None] = {}
        for c in cols:
            if level < top[c]:
                steps = [j * units[c] * RADIX**level for j in range(RADIX)]
                merged[f"_up_{rung[c]}"] = c, [at(c, back) for back in steps]
                looked |= dict.fromkeys((c, back) for back in steps if back)
        for i, r in enumerate(rolls):
            own = digits[i][level] if level < len(digits[i]) else 0
            length = units[r.col] * RADIX**level
            steps = [reach[i] + j * length for j in range(own)]
            if steps:
                before = [f"_f{i}"] if reach[i] else []
                merged[f"_new_f{i}"] = r.col, before + [at(r.col, back) for back in steps]
                looked |= dict.fromkeys((r.col, back) for back in steps if back)
                reach[i] += own * length
        d = d.select("*", *[F.lag(f"{rung[c]}_{p}", back).over(w).alias(f"{at(c, back)}_{p}") for c, back in looked for p in parts[c]])
        d = _merge(d, merged, parts)
        stay = [x for x in d.columns if x in kept]
        for i, r in enumerate(rolls):
            name = f"_new_f{i}" if f"_new_f{i}" in merged else f"_f{i}"
            stay += [F.col(f"{name}_{p}").alias(f"_f{i}_{p}") for p in parts[r.col] if reach[i]]
        stay += [F.col(f"_up_{rung[c]}_{p}").alias(f"{rung[c]}_{p}") for c in cols if level < top[c] for p in parts[c]]
        d = d.select(*stay)
    return d.select(*kept, *[_ladder_stat(stat, r.ddof, f"_f{i}").alias(name) for i, r in enumerate(rolls) for stat, name in r.outs])


def _digits(n: int) -> list[int]:
    """``n`` in base RADIX, the smallest place first."""
    return [n % RADIX, *(_digits(n // RADIX) if n >= RADIX else [])]


def _parts(stats: set[str]) -> list[str]:
    """What a rung must hold for these statistics."""
    moments = ["n", "mean"] if stats & {"mean", "std", "sum", "count"} else []
    return moments + (["m2"] if "std" in stats else []) + [p for p, stat in (("lo", "min"), ("hi", "max")) if stat in stats]


def _unit(c: str, rows: int, w: WindowSpec, parts: Sequence[str]) -> dict[str, Column]:
    """Count, mean, sum of squared deviations, min and max of the last ``rows`` rows; all NULL where no value is present."""
    x = F.col(c)
    if rows == 1:
        one = F.when(x.isNotNull(), F.lit(1.0))
        return {p: {"n": one, "m2": one - 1.0}.get(p, x) for p in parts}
    over = lambda e: e.over(w.rowsBetween(-(rows - 1), 0))
    n = over(F.count(x)).cast("double")
    made = {"n": F.when(n > 0, n), "mean": over(F.avg(x)), "m2": over(F.var_pop(x)) * n, "lo": over(F.min(x)), "hi": over(F.max(x))}
    return {p: made[p] for p in parts}


def _merge(d: DataFrame, merged: dict[str, tuple[str, list[str]]], parts: dict[str, list[str]]) -> DataFrame:
    """Add the statistics of neighbouring frames as one, for each new name; a frame without values (or before the series)
    is NULL and counts for nothing.

    The mean is the first piece's plus weighted differences and the squares are taken about the new mean, so pieces of
    equal means add no deviation.
    """
    total = lambda terms: reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0.0)) for t in terms])
    first, second, third = [], [], []
    for name, (c, pieces) in merged.items():
        col = lambda p: [F.col(f"{x}_{p}") for x in pieces]  # noqa: E731, B023
        alone = len(pieces) == 1
        first += [(col(p)[0] if alone else (F.least if p == "lo" else F.greatest)(*col(p))).alias(f"{name}_{p}") for p in ("lo", "hi") if p in parts[c]]
        if alone:
            first += [col(p)[0].alias(f"{name}_{p}") for p in ("n", "mean", "m2") if p in parts[c]]
        elif "n" in parts[c]:
            n, mean = F.col(f"{name}_n"), F.col(f"{name}_mean")
            first += [total(col("n")).alias(f"{name}_n0"), F.coalesce(*col("mean")).alias(f"{name}_base")]
            base = F.col(f"{name}_base")
            second += [F.when(F.col(f"{name}_n0") > 0, F.col(f"{name}_n0")).alias(f"{name}_n")]
            shift = total([(m - base) * k for m, k in zip(col("mean"), col("n"), strict=True)])
            second += [(base + shift / F.when(F.col(f"{name}_n0") > 0, F.col(f"{name}_n0"))).alias(f"{name}_mean")]
            if "m2" in parts[c]:
                squares = [m2 + k * (m - mean) * (m - mean) for m2, k, m in zip(col("m2"), col("n"), col("mean"), strict=True)]
                third += [F.when(n.isNotNull(), total(squares)).alias(f"{name}_m2")]
    for new in (first, second, third):
        if new:
            d = d.select("*", *new)
    return d


def _ladder_stat(stat: str, ddof: int, f: str) -> Column:
    if stat in ("min", "max"):
        return F.col(f"{f}_lo" if stat == "min" else f"{f}_hi")
    n = F.col(f"{f}_n")
    if stat == "count":
        return F.coalesce(n, F.lit(0.0)).cast("long")
    if stat == "mean":
        return F.col(f"{f}_mean")
    if stat == "sum":
        return F.col(f"{f}_mean") * n
    if stat == "std":
        return F.when(n > ddof, F.sqrt(F.col(f"{f}_m2") / (n - ddof)))
    raise ValueError(stat)
