"""Exact top-k by inner product with a three-phase uniform threshold.

A score is a sum over ``slices`` of the dimensions; each slice is a list of local scores, kept by every shard for its
own candidates.

1. Gather: each shard sends, per query and slice, the ``k`` best entries of its local list; an entry
   carries the candidate's whole score, which the shard knows.  The k-th best distinct candidate among
   them gives a safe cutoff: the true k-th score is not below it.
2. Broadcast the cutoff with the query blocks.  A candidate that reaches it has a local score of at least
   cutoff / slices in some list (the uniform threshold), so each shard collects just those entries and drops
   candidates whose collected scores plus the threshold for the lists they are missing from stay below the cutoff.
3. The remaining candidates are scored exactly; what reaches the cutoff is sent (never more than a shard's k best), and
   the k best of all shards are the result, ties to the smaller id.

Vectors are packed in blocks of a fixed number of rows; query blocks are dealt to the candidate shards by an equi-join
on the shard, so a task holds one block of each and nothing is broadcast whole.  The work is queries times candidates,
as the contract of the search asks.

Components become floor(scale * x), a long.  Products are sums of doubles where these hold every partial sum exactly, else of longs,
else of integers without bound; a component of 2 ** 62 or more after scaling, or a score that no long holds, is an error and never
leaves a row out.  Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part; queries meet only candidates of their own length; a query's own id is no candidate, and
neither is a null id; rows that repeat an id are scored each, as often as they occur, and ask once, with the smallest vector; fewer than k candidates give all; empty
tables give an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK = 2048  # candidates in a block
QUERY_BLOCK = 256  # queries in a block
LARGEST = float(2**62)


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v array<long>, d): the vectors that take part."""
    v = F.transform(F.col(vector), lambda x: F.lit(scale) * x.cast("double"))
    ok = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = lambda x: F.when(F.abs(x) < F.lit(LARGEST), F.floor(x).cast("long")).otherwise(F.raise_error(F.lit("a scaled component does not fit into a long")).cast("long"))
    return (
        df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(ok, F.lit(False)))
        .select(F.col(key).cast("long").alias("vec_id"), v.alias("__v"))
        .select("vec_id", F.transform("__v", whole).alias("v"), F.size("__v").alias("d"))
    )


def _pack(df: DataFrame, rows: int) -> DataFrame:
    """(d, block, ids binary, m binary): blocks of about ``rows`` vectors of one length."""
    counts = {r["d"]: r["n"] for r in df.groupBy("d").agg(F.count("*").alias("n")).collect()}  # one row per vector length
    if not counts:
        counts = {0: 1}
    blocks = F.coalesce(*[F.when(F.col("d") == d, F.lit(max(1, -(-n // rows)))) for d, n in counts.items()], F.lit(1))
    # the row number keeps an id that repeats without end from filling one block
    keyed = df.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), blocks).cast("long"))

    def pack(pdf):
        import pandas as pd

        ids = pdf["vec_id"].to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        m = np.stack(pdf["v"].to_numpy()).astype(np.int64)[order]
        if np.abs(m).max(initial=0) < 2**31:
            m = m.astype(np.int32)  # read back by the number of bytes
        out = []
        for i in range(0, len(ids), rows):  # a block is never larger, whatever repeats
            out.append((int(pdf["d"].iloc[0]), int(pdf["block"].iloc[0]) * 1_000_003 + i // rows, ids[order][i : i + rows].tobytes(), m[i : i + rows].tobytes()))
        return pd.DataFrame(out, columns=["d", "block", "ids", "m"])

    return stored(keyed.groupBy("d", "block").applyInPandas(pack, "d int, block long, ids binary, m binary"))


def _pairs(cands: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query block with every candidate block of its vector length, one row each, dealt evenly."""
    shards = cands.select("d", "block").groupBy("d").agg(F.collect_list("block").alias("blocks"))  # block numbers only
    dealt = queries.join(shards, "d").withColumn("block", F.explode("blocks")).drop("blocks")
    parts = max(1, min(20_000, cands.count() * 3 // 2))  # a task per candidate block or so
    c = cands.select("d", "block", F.col("ids").alias("c_ids"), F.col("m").alias("c_m")).repartition(parts, "d", "block")
    return c.hint("shuffle_hash").join(dealt.repartition(parts, "d", "block"), ["d", "block"])


def _matrix(data: bytes, rows: int, d: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * rows * d else np.int64).reshape(rows, d)


def _scores(row: dict, slices: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Ids of queries and candidates, local scores per slice (exact integers), and which pairs are no candidates."""
    d = row["d"]
    q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
    q, c = _matrix(row["q_m"], len(q_ids), d), _matrix(row["c_m"], len(c_ids), d)
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * d
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object  # doubles hold the sums exactly, and use the fast product
    cuts = np.linspace(0, d, min(slices, d) + 1).astype(int)
    local = [q[:, a:b].astype(kind) @ c[:, a:b].astype(kind).T for a, b in zip(cuts, cuts[1:])]
    return q_ids, c_ids, local, q_ids[:, None] == c_ids[None, :]


def _rows(batches):
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            yield {n: batch.column(j)[i].as_py() for j, n in enumerate(names)}


#: Below every score of the kind (double, long, integer without bound).
_LEAST = {"f": -np.inf, "i": np.iinfo(np.int64).min // 2, "O": -(10**60)}
_OUT = "query_id long, vec_id long, score long"


def _longs(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and any(abs(x) >= 2**63 for x in scores):
        raise OverflowError("a score does not fit into a long")
    return scores.astype(np.int64)


def _batch(q, v, s):
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])


def _best(total: np.ndarray, alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest entries of each row among ``alive``; columns ascend by id, so ties go to the left."""
    rows, cols = [], []
    for i in range(total.shape[0]):
        at = np.flatnonzero(alive[i])
        if len(at) > k:
            s = total[i, at]
            edge = np.partition(s, len(s) - k)[len(s) - k]
            above = at[s > edge]
            at = np.concatenate([above, at[s == edge][: k - len(above)]])
        rows.append(np.full(len(at), i))
        cols.append(at)
    return np.concatenate(rows), np.concatenate(cols)


def _gather(k: int, slices: int):
    def run(batches):
        for row in _rows(batches):
            q_ids, c_ids, local, own = _scores(row, slices)
            total = sum(local)
            seen = np.zeros(total.shape, bool)
            for part in local:
                part = np.where(own, _LEAST[part.dtype.kind], part)
                n = min(k, part.shape[1])
                seen[np.arange(len(q_ids))[:, None], np.argpartition(part, part.shape[1] - n, axis=1)[:, part.shape[1] - n :]] = True
            # of the entries in the local lists those k that can move the cutoff
            r, c = _best(total, seen & ~own, k)
            yield _batch(q_ids[r], c_ids[c], _longs(total[r, c]))

    return run


def _resolve(k: int, slices: int):
    def run(batches):
        for row in _rows(batches):
            q_ids, c_ids, local, own = _scores(row, slices)
            none = np.frombuffer(row["q_none"], bool)[:, None]
            cutoff = np.frombuffer(row["q_cut"], np.int64)[:, None].astype(local[0].dtype)
            threshold = cutoff.astype(np.float64) / len(local)
            bound, some, error = np.zeros(own.shape), np.zeros(own.shape, bool), 1 + 1e-6 * np.abs(cutoff.astype(np.float64))
            for part in local:  # collected entries count as they are, missing ones at most the threshold
                part = part.astype(np.float64)
                has = part >= threshold - error
                some |= has
                bound += np.where(has, part, threshold)
                if local[0].dtype.kind != "f":  # the doubles of the bound are rounded
                    error = error + 1e-9 * np.abs(part)
            alive = ((some & (bound >= cutoff.astype(np.float64) - error)) | none) & ~own
            total = sum(local)
            r, c = _best(total, alive & (none | (total >= cutoff).astype(bool)), k)
            yield _batch(q_ids[r], c_ids[c], _longs(total[r, c]))

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, slices: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row that satisfies ``is_query``."""
    packed_from = integer_vectors(vectors, key, vector, scale)
    asked = integer_vectors(vectors.where(is_query), key, vector, scale).groupBy("vec_id").agg(F.min(F.struct("d", "v")).alias("q")).select("vec_id", "q.v", "q.d")
    cands = _pack(packed_from, BLOCK)
    queries = _pack(asked, QUERY_BLOCK).select("d", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    gathered = _pairs(cands, queries).mapInArrow(_gather(k, slices), _OUT)
    cut = gathered.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("cut"))
    # the cutoffs go back into the query blocks
    ids = queries.select("d", "q_block", "q_ids").mapInArrow(_unpack, "d int, q_block long, place int, query_id long")
    cuts = ids.join(cut, "query_id", "left").groupBy("d", "q_block").agg(F.sort_array(F.collect_list(F.struct("place", "cut"))).alias("cuts"))  # a block of queries
    packed = cuts.select("d", "q_block", F.transform("cuts", lambda x: x["cut"]).alias("cuts")).mapInArrow(_pack_cuts, "d int, q_block long, q_cut binary, q_none binary")
    with_cut = stored(queries.join(packed, ["d", "q_block"]))

    found = _pairs(cands, with_cut).mapInArrow(_resolve(k, slices), _OUT)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _unpack(batches):
    for row in _rows(batches):
        ids = np.frombuffer(row["q_ids"], np.int64)
        n = len(ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, row["d"]), pa.int32()), pa.array(np.full(n, row["q_block"]), pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(ids, pa.int64())], ["d", "q_block", "place", "query_id"]
        )


def _pack_cuts(batches):
    for row in _rows(batches):
        cut = np.array([x or 0 for x in row["cuts"]], np.int64).tobytes()
        none = np.array([x is None for x in row["cuts"]], bool).tobytes()  # fewer than k candidates: no cutoff
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["d"]], pa.int32()), pa.array([row["q_block"]], pa.int64()), pa.array([cut], pa.binary()), pa.array([none], pa.binary())], ["d", "q_block", "q_cut", "q_none"]
        )


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the 20 best of all vectors for every vector whose id is divisible by 20."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def oracle() -> str:
    return """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""
