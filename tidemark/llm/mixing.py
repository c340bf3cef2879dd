"""Mixing sources to target weights (DataFrame functions only).

Every document gets a hash-random key.  Within a source the keys are cut into even ranges (the range a key falls
in is its leading bits, so ranges need no sampling and agree between reruns), each range is sorted, and distributed
prefix sums of the word counts follow from the sums of earlier ranges plus a running sum inside the range.
The source's budget is then cut exactly: every full epoch takes all documents, the last epoch takes documents in key
order up to the budget, the one at the cut in part.

Budgets: ``share`` times all sizes, divided by weight; a source stops at ``most`` times its size and its excess goes to
the others by weight, until none is above.  Weights go to the sources in code-point order, null last, repeating.

Defined cases: null text has size 0; documents of size 0 and sources without words take 0; a null source is a source;
repeated rows are separate documents; an empty table gives an empty result.  Extra columns pass through whatever their names
(``mix`` replaces those it returns itself, ``mixed_rows`` returns the caller's).
One row per source is sorted in one task; documents never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, n_words_of, named, shelter, stored, text_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
RANGE_ROWS = 20_000
KEY_BITS = 60
RESULTS = ["size", "source_size", "target", "taken"]


def hash_key(key: Column, seed: int) -> Column:
    """A random-looking key of 60 bits that any engine with MD5 can compute."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(by_source: DataFrame, source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs) -> the same with ``target`` (double)."""
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    df = by_source.withColumn("__w", w).withColumn("__cap", most * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    df = df.withColumn("__budget", share * F.sum("source_size").over(everything).cast("double"))
    # in the order of cap per weight the capped sources come first
    order = Window.orderBy(F.col("__cap") / F.col("__w"), F.col(source).asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("__budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after)
    df = df.withColumn("__capped", level * F.col("__w") > F.col("__cap"))
    spent = F.sum(F.when(F.col("__capped"), F.col("__cap")).otherwise(0.0)).over(everything)
    left = F.sum(F.when(F.col("__capped"), 0.0).otherwise(F.col("__w"))).over(everything)
    target = F.when(F.col("__capped"), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.try_divide((F.col("__budget") - spent), left) * F.col("__w")))
    return df.withColumn("target", target).drop("__w", "__cap", "__budget", "__capped")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42, **budget) -> DataFrame:
    """``docs`` (without the text, unless it is asked for in ``keep``) with size, source_size, target and taken."""
    keep = [c for c in budget.pop("keep", [c for c in docs.columns if c != text]) if c.lower() not in RESULTS]
    kept, back = shelter(docs.select(*[named(c) for c in docs.columns if c in keep or c in (key, text, source)]), key, text, source)
    base = kept.select(
        "*",
        F.col(source).alias("__src"),
        n_words_of(text_of(text)).alias("size"),
        hash_key(F.col(key), seed).alias("__key"),
        F.xxhash64(text_of(text)).alias("__tie"),
    )
    sums = base.select("__src", "size").groupBy("__src").agg(F.sum("size").alias("source_size"), F.count("*").alias("__n"))
    sums = stored(targets(sums, "__src", **budget))
    largest = sums.agg(F.max("__n")).first()[0] or 0
    bits = max(4, min(30, (largest // RANGE_ROWS).bit_length()))
    base = base.withColumn("__range", F.shiftright("__key", KEY_BITS - bits))
    per_range = base.groupBy("__src", "__range").agg(F.sum("size").alias("__sum"))
    earlier = Window.partitionBy("__src").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** bits rows a source
    per_range = per_range.withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0).cast("long"))).drop("__sum")
    per_range = attach(stored(per_range), sums.drop("__n"), ["__src"])
    renamed = per_range.withColumnRenamed("__src", "__src2").withColumnRenamed("__range", "__range2")
    running = Window.partitionBy("__src", "__range").orderBy("__key", key, "size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    out = base.withColumn("__in", F.coalesce(F.sum("size").over(running), F.lit(0).cast("long")))
    out = out.join(renamed, out["__src"].eqNullSafe(renamed["__src2"]) & (out["__range"] == renamed["__range2"]))
    whole = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    rest = whole - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("__before") - F.col("__in")))
    out = out.withColumn("taken", epochs * F.col("size") + part)
    return back(out, *RESULTS).select(*[named(c) for c in keep], *RESULTS)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken (a part of half a document or more counts as one)."""
    used = [options.get(n, n if n != "key" else "doc_id") for n in ("key", "text", "source")]
    work, back = shelter(docs, *used)
    out = mix(work, keep=work.columns, **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(0).cast("int")
    return back(out.withColumn("__epoch", F.explode(F.array_repeat(F.lit(1), times))))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document with its size, its source's size and target, and the words the mix takes of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "source", "text"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def oracle() -> str:
    return """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size::DOUBLE AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget FROM s),
o AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * w > cap AS capped
  FROM c),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, (budget - sum(CASE WHEN capped THEN cap ELSE 0.0 END) OVER ())
              / sum(CASE WHEN capped THEN 0.0 ELSE w END) OVER () * w) END::DOUBLE AS target
  FROM o),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN whole // source_size * size + greatest(0, least(size, whole % source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM r"""
