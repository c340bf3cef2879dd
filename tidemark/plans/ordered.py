"""Skew-proof building blocks for ordered (time-series) work.

A plain ``Window.partitionBy('series_id')`` puts a whole series on one task.
With one series holding a third of all rows that task would hold a third of
the data, so every operator here splits a series into buckets of consecutive
rows and works per ``(series_id, bucket)``:

* :func:`row_position` - dense 0-based position of each row in its series,
  computed with a range partition (a hot series spreads over many tasks), a
  per-partition row id and a small offsets table.
* :func:`with_halo` - copies the few rows a bounded frame needs from the
  neighbouring buckets ("halo"), so windows over ``(series_id, bucket)`` give
  exactly the answer of the whole-series window.
* :func:`carry_present` - for unbounded look-back / look-ahead (gap fills):
  nearest present value before/after each row, found inside the bucket and
  carried across buckets through a small per-bucket table.

All three are built from DataFrame operations only (no UDF, no collect).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import IDX, SERIES

# Rows per bucket: large enough that the halo copy (at most one frame length)
# is a small fraction, small enough that one bucket sorts in memory.
DEFAULT_BUCKET_ROWS = 8192
# Buckets for the unbounded carry: in-bucket work is linear, so they can be big.
DEFAULT_CARRY_ROWS = 1 << 16

BUCKET = "_bucket"
HALO = "_halo"


def bucket_rows_for(back: int, fwd: int = 0, base: int = DEFAULT_BUCKET_ROWS) -> int:
    """Bucket size for a frame reaching ``back`` rows behind and ``fwd`` ahead.

    At least four frame lengths, so the copied halo is at most a quarter of
    the bucket.
    """
    return int(max(base, 4 * max(back, fwd, 1)))


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def row_position(
    df: DataFrame,
    order: Sequence[str | Column],
    keys: Sequence[str] = (SERIES,),
    name: str = IDX,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``name``: 0-based position of each row within ``keys`` by ``order``.

    Equivalent to ``row_number() over (partition by keys order by order) - 1``
    but never places a whole key on one task: rows are range-partitioned on
    ``keys + order``, numbered inside each partition, and shifted by the
    count of the key's rows in earlier partitions (a table with at most
    ``#keys + #partitions`` rows).  Ties in ``order`` are numbered in an
    arbitrary but gap-free way; pass a tie-breaker column to make it exact.
    """
    n = num_partitions or _shuffle_partitions(df)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    cols = [F.col(k) for k in keys] + order_cols
    s = (
        df.repartitionByRange(n, *cols)
        .sortWithinPartitions(*cols)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright(F.col("_mid"), 33))
        # Both branches below must see the same partitions: the range bounds
        # are sampled from the input, so two separately planned exchanges
        # may cut differently.  One persisted relation is shared (recomputed
        # from the same shuffle, hence the same partitions, if a block is lost).
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    stats = s.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (
        s.join(stats.select(*keys, "_pid", "_off", "_m0"), [*keys, "_pid"])
        .withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long"))
        .drop("_mid", "_pid", "_off", "_m0")
    )


def with_halo(df: DataFrame, back: int, fwd: int, bucket_rows: int, idx: str = IDX) -> DataFrame:
    """Assign ``_bucket = idx div bucket_rows`` and copy halo rows.

    A row is also emitted (``_halo = true``) into the next bucket when it lies
    in the last ``back`` rows of its bucket, and into the previous bucket when
    it lies in the first ``fwd`` rows.  A frame ``rows between back preceding
    and fwd following`` evaluated per ``(key, _bucket)`` on the non-halo rows
    then equals the frame over the whole key, provided ``idx`` is dense.
    """
    if back > bucket_rows or fwd > bucket_rows:
        raise ValueError("bucket_rows must be at least the frame reach")
    b = F.floor(F.col(idx) / F.lit(bucket_rows)).cast("long")
    r = F.pmod(F.col(idx), F.lit(bucket_rows))
    if back <= 0 and fwd <= 0:
        return df.withColumn(BUCKET, b).withColumn(HALO, F.lit(False))
    # the offsets of the buckets that hold a row, as one of at most four constant arrays: none is built per row
    offsets = lambda *more: F.array(*[F.lit(k).cast("long") for k in (0, *more)])
    late, early = r >= bucket_rows - back, r < fwd
    place = offsets()
    if fwd > 0:
        place = F.when(early, offsets(-1)).otherwise(place)
    if back > 0:
        place = F.when(late, offsets(1)).otherwise(place)
    if back > 0 and fwd > 0:
        place = F.when(late & early, offsets(1, -1)).otherwise(place)
    placed = df.select("*", b.alias("_hb"), F.explode(place).alias("_ho"))
    return placed.select("*", (F.col("_hb") + F.col("_ho")).alias(BUCKET), (F.col("_ho") != 0).alias(HALO)).drop("_hb", "_ho")


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(BUCKET, HALO)


def bucket_window(keys: Sequence[str] = (SERIES,), idx: str = IDX):
    """Window over one bucket of one series, in row order."""
    return Window.partitionBy(*keys, BUCKET).orderBy(idx)


def carry_present(
    df: DataFrame,
    cols: Sequence[str],
    time_col: str,
    keys: Sequence[str] = (SERIES,),
    idx: str = IDX,
    bucket_rows: int = DEFAULT_CARRY_ROWS,
) -> DataFrame:
    """Nearest present value at-or-before and at-or-after each row, per column.

    Adds ``_p_<c>`` and ``_n_<c>``: structs ``(t, v)`` of the nearest row with
    ``c`` not NULL (``t`` = ``time_col``).  Rows are ordered by ``time_col``;
    ``idx`` (non-decreasing in time, need not be dense) only picks the bucket.
    Work per bucket is linear; the carry across buckets runs over a table with
    one row per bucket.
    """
    b = F.floor(F.col(idx) / F.lit(bucket_rows)).cast("long")
    d = df.withColumn(BUCKET, b)
    order = Window.partitionBy(*keys, BUCKET).orderBy(F.col(time_col).asc())
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    aggs, found = [], []
    for i, c in enumerate(cols):
        key_i = F.when(F.col(c).isNotNull(), F.col(time_col))
        d = d.withColumn(f"_pt{i}", key_i).withColumn(f"_pv{i}", F.col(c)).withColumn(f"_nv{i}", F.when(F.col(time_col).isNotNull(), F.col(c)))
        # one order serves both sides, and plain columns (no struct) keep the running state small
        found += [F.last(f"_p{x}{i}", True).over(so_far).alias(f"_in_p{x}{i}") for x in "tv"]
        following = lambda x: F.call_function("lead", F.col(x), F.lit(1), F.lit(None), F.lit(True)).over(order)
        found += [following(f"_pt{i}").alias(f"_in_nt{i}"), following(f"_nv{i}").alias(f"_in_nv{i}")]
        # fixed-width buffers (no struct) keep this a hash aggregation
        aggs += [
            F.max(key_i).alias(f"_blt_{c}"),
            F.max_by(F.col(c), key_i).alias(f"_blv_{c}"),
            F.min(key_i).alias(f"_bft_{c}"),
            F.min_by(F.col(c), key_i).alias(f"_bfv_{c}"),
        ]
    d = d.select("*", *found)
    per_bucket = df.withColumn(BUCKET, b).groupBy(*keys, BUCKET).agg(*aggs)
    for c in cols:
        per_bucket = per_bucket.select(
            "*",
            F.when(F.col(f"_blt_{c}").isNotNull(), F.struct(F.col(f"_blt_{c}").alias("t"), F.col(f"_blv_{c}").alias("v"))).alias(f"_bl_{c}"),
            F.when(F.col(f"_bft_{c}").isNotNull(), F.struct(F.col(f"_bft_{c}").alias("t"), F.col(f"_bfv_{c}").alias("v"))).alias(f"_bf_{c}"),
        ).drop(f"_blt_{c}", f"_blv_{c}", f"_bft_{c}", f"_bfv_{c}")
    wb_up = Window.partitionBy(*keys).orderBy(F.col(BUCKET).asc()).rowsBetween(Window.unboundedPreceding, -1)
    wb_dn = Window.partitionBy(*keys).orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    for c in cols:
        per_bucket = per_bucket.withColumn(f"_cp_{c}", F.last(f"_bl_{c}", True).over(wb_up))
        per_bucket = per_bucket.withColumn(f"_cn_{c}", F.last(f"_bf_{c}", True).over(wb_dn))
        carry_cols += [f"_cp_{c}", f"_cn_{c}"]
    out = d.join(per_bucket.select(*keys, BUCKET, *carry_cols), [*keys, BUCKET], "left")
    point = lambda t, v: F.struct(F.col(t).alias("t"), F.col(v).alias("v"))
    for i, c in enumerate(cols):
        before = F.when(F.col(f"_in_pv{i}").isNotNull(), point(f"_in_pt{i}", f"_in_pv{i}")).otherwise(F.col(f"_cp_{c}"))
        # rows without a stamp lie before all others and have the same neighbour on both sides, or the first stamped one
        unstamped = F.col(time_col).isNull() & F.col(f"_in_pv{i}").isNotNull()
        after = F.when(F.col(f"_in_nv{i}").isNotNull(), point(f"_in_nt{i}", f"_in_nv{i}")).otherwise(F.col(f"_cn_{c}"))
        after = F.when(unstamped, point(f"_in_pt{i}", f"_in_pv{i}")).otherwise(after)
        out = out.withColumn(f"_p_{c}", before).withColumn(f"_n_{c}", F.when(F.col(c).isNotNull(), point(time_col, c)).otherwise(after))
        out = out.drop(f"_cp_{c}", f"_cn_{c}", *[f"_{x}{i}" for x in ("pt", "pv", "nv", "in_pt", "in_pv", "in_nt", "in_nv")])
    return out.drop(BUCKET)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a multi-step composition with a reliable checkpoint.

    Operators use their input more than once (carry tables, bounds, ranks);
    without a cut, a chain of them recomputes its first steps many times over.
    The data are written to the shared folder named by ``spark.checkpoint.dir``
    (so a lost executor does not lose them), never to a machine-local one.
    """
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


TIME_BUCKET = "_tb"


# One level of equi-depth cuts: edges per crowded group, and the sketch's accuracy (rank error rows / _SKETCH).
_EDGES = 255
_SKETCH = 2048
_MOST_LEVELS = 6


def with_time_buckets(
    df: DataFrame, ts: str, keys: Sequence[str] = (SERIES,), rows_per_bucket: int = DEFAULT_BUCKET_ROWS, name: str = TIME_BUCKET
) -> DataFrame:
    """Add ``name``: a bucket of consecutive time per series, holding about ``rows_per_bucket`` rows however the stamps
    are spread (never over four times that, but for equal stamps, which stay together).

    The edges are quantiles of the series' own stamps: a mergeable sketch gives up to 255 of them per series, and a group
    that is still crowded is cut again by a sketch of its own, so a series of ``n`` rows needs about
    ``log(n / rows_per_bucket) / log(256)`` passes and one of up to twice the target none.  An edge that many rows share
    gets a bucket of its own.  Monotone in time, so per-bucket work plus a small carry table covers a whole series;
    bucket numbers have gaps.  NULL stamps lie in the first bucket.
    """
    return _time_buckets(df, ts, keys, rows_per_bucket, name)[0]


def _time_buckets(df: DataFrame, ts: str, keys: Sequence[str], rows_per_bucket: int, name: str) -> tuple[DataFrame, bool]:
    """The rows with their bucket, and whether any series has more than one."""
    from ..functions.timefn import epoch_micros

    t = epoch_micros(ts)
    group = [*keys, name]
    out, cut = df.withColumn(name, F.lit(0).cast("long")), False
    for _ in range(_MOST_LEVELS):
        counts = out.groupBy(*group).agg(F.count(F.lit(1)).alias("_tn"), F.min(t).alias("_t0"), F.max(t).alias("_t1"))
        crowded = counts.filter((F.col("_tn") > 2 * rows_per_bucket) & (F.col("_t1") > F.col("_t0")))
        crowded = materialize(crowded.select(*group, "_tn"))  # fewer rows than the data by rows_per_bucket
        if crowded.isEmpty():
            break
        quantiles = F.percentile_approx(t, [i / (_EDGES + 1) for i in range(1, _EDGES + 1)], _SKETCH)
        edges = out.join(crowded, group).groupBy(*group, "_tn").agg(quantiles.alias("_q"))
        wanted = F.least(F.lit(_EDGES + 1), F.ceil(F.col("_tn") / rows_per_bucket)).cast("int")
        picked = F.transform(F.sequence(F.lit(1), wanted - 1), lambda j: F.get("_q", F.floor(j * (_EDGES + 1) / wanted).cast("int") - 1))
        edges = materialize(edges.select(*group, F.array_distinct(picked).alias("_edges")))
        out = out.join(edges, group, "left")
        below = _edges_below(F.col("_edges"), t)
        at_edge = F.coalesce((F.get("_edges", below) == t).cast("long"), F.lit(0).cast("long"))
        out = out.withColumn(name, F.col(name) * (2 * (_EDGES + 1)) + 2 * below + at_edge).drop("_edges")
        cut = True
    return out, cut


def _edges_below(edges: Column, value: Column) -> Column:
    """How many of the ascending ``edges`` (at most _EDGES) lie below ``value``, by halving; 0 for a NULL."""
    steps = F.array(*[F.lit(1 << i) for i in range(_EDGES.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(edges, n + step - 1) < value, n + step).otherwise(n))


def time_position(
    df: DataFrame,
    ts: str,
    keys: Sequence[str] = (SERIES,),
    name: str = IDX,
    tie: Sequence[str] = (),
    rows_per_bucket: int = DEFAULT_CARRY_ROWS,
) -> DataFrame:
    """``row_number() - 1`` over ``(keys) order by ts`` without a whole-series window.

    Rows are numbered inside time buckets of about equal row counts and shifted by the
    row count of the earlier buckets (a table with one row per bucket).
    Deterministic: nothing depends on how the input happens to be ordered.
    """
    d, cut = _time_buckets(df, ts, keys, rows_per_bucket, TIME_BUCKET)
    if not cut:  # every series fits into one bucket
        w = Window.partitionBy(*keys).orderBy(F.col(ts), *[F.col(c) for c in tie])
        return d.withColumn(name, (F.row_number().over(w) - 1).cast("long")).drop(TIME_BUCKET)
    counts = d.groupBy(*keys, TIME_BUCKET).agg(F.count(F.lit(1)).alias("_bn"))
    wb = Window.partitionBy(*keys).orderBy(TIME_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_boff", F.coalesce(F.sum("_bn").over(wb), F.lit(0))).drop("_bn")
    w = Window.partitionBy(*keys, TIME_BUCKET).orderBy(F.col(ts), *[F.col(c) for c in tie])
    d = d.withColumn("_rn", F.row_number().over(w))
    return d.join(counts, [*keys, TIME_BUCKET]).withColumn(name, (F.col("_boff") + F.col("_rn") - 1).cast("long")).drop(
        "_boff", "_rn", TIME_BUCKET
    )


def previous_time(df: DataFrame, ts: str, keys: Sequence[str] = (SERIES,), name: str = "_prev_ts", rows_per_bucket: int = DEFAULT_CARRY_ROWS) -> DataFrame:
    """Add ``name``: the stamp of the row before in time order (NULL on the first row of a series).

    Inside a time bucket it is a lag; the first row of a bucket takes the last stamp of the bucket before, from a table
    with one row per bucket.  No positions are needed.
    """
    d, cut = _time_buckets(df, ts, keys, rows_per_bucket, TIME_BUCKET)
    w = Window.partitionBy(*keys, TIME_BUCKET).orderBy(ts)
    if not cut:
        return d.withColumn(name, F.lag(ts, 1).over(w)).drop(TIME_BUCKET)
    before = Window.partitionBy(*keys).orderBy(TIME_BUCKET)
    last = d.groupBy(*keys, TIME_BUCKET).agg(F.max(ts).alias("_last")).withColumn("_last", F.lag("_last", 1).over(before))
    d = d.withColumn("_own", F.lag(ts, 1).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    d = d.join(last, [*keys, TIME_BUCKET])
    return d.withColumn(name, F.when(F.col("_first"), F.col("_last")).otherwise(F.col("_own"))).drop("_own", "_first", "_last", TIME_BUCKET)


def gather(
    rows: DataFrame,
    source: DataFrame,
    wanted: Sequence[tuple[str, str, int]],
    position: Callable[[int], Column],
    keys: Sequence[str] = (SERIES,),
    idx: str = IDX,
) -> DataFrame:
    """``rows`` with a column per ``(name, column, k)`` of ``wanted``: ``column`` of the ``source`` row at ``position(k)``.

    The positions of a row are dealt out as rows (one per distinct ``k``), met with ``source`` in a single join on
    ``(keys, idx)`` that brings all its columns, and put side by side again by name.  ``position`` is an expression over
    ``rows``; a position that ``source`` lacks gives NULL.  Rows must differ in some column.
    """
    if not wanted:
        return rows
    offsets = sorted({k for _, _, k in wanted})
    columns = list(dict.fromkeys(c for _, c, _ in wanted))
    points = F.explode(F.array(*[F.struct(F.lit(i).alias("_slot"), position(k).cast("long").alias("_pos")) for i, k in enumerate(offsets)]))
    points = rows.select("*", points.alias("_at")).select(*rows.columns, "_at.*")
    there = source.select(*keys, F.col(idx).alias("_pos"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    found = points.join(there, [*keys, "_pos"], "left")
    value = lambda c, k: F.max(F.when(F.col("_slot") == offsets.index(k), F.col(f"_v{columns.index(c)}")))
    return found.groupBy(*rows.columns).agg(*[value(c, k).alias(name) for name, c, k in wanted])
