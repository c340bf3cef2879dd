"""Helpers shared by the text operators: word columns, document keys, joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words; a word is a run of anything else.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: A joined side with at most so many rows is broadcast (its rows are counted first); above, the join is salted.
BROADCAST_ROWS = 20_000
SALTS = 32


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text in order, as an array."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != F.lit(""))


def n_words_of(text: Column) -> Column:
    """Number of words as long, without building more than the split."""
    return F.regexp_count(text, F.lit(WORD_CLASS + "+")).cast("long")


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def shelter(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``df`` with every column but ``used`` under a name no operator works with, and the way back.

    The way back takes a result that still holds those columns and returns the caller's columns by their own names and in
    their own order, and any ``more`` columns after them; what an operator added beside them goes.
    """
    names = {c: f"__caller{i}" for i, c in enumerate(df.columns) if c not in used}

    def back(out: DataFrame, *more: str) -> DataFrame:
        return out.select(*[named(names.get(c, c)).alias(c) for c in df.columns if c not in more], *more)

    return df.select(*[named(c).alias(names.get(c, c)) for c in df.columns]), back


def attach(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salt_on: Column | None = None) -> DataFrame:
    """Join ``small`` (at most one row per key) to ``big`` on null-safe equal keys.

    ``small`` is counted first: up to BROADCAST_ROWS rows it is broadcast, beyond that both sides get a
    salt, so that a key holding a third of ``big`` is dealt over SALTS tasks.  ``small`` is read twice, so
    callers pass a stored (checkpointed) table.
    """
    renamed = small.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    cond = None
    for i, k in enumerate(keys):
        c = big[k].eqNullSafe(renamed[f"__k{i}"])
        cond = c if cond is None else cond & c
    drop = [f"__k{i}" for i in range(len(keys))]
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(renamed), cond, how).drop(*drop)
    salted = big.withColumn("__salt", F.pmod(salt_on if salt_on is not None else F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(SALTS)).cast("int"))
    renamed = renamed.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cond = (salted["__salt"] == renamed["__s"])
    for i, k in enumerate(keys):
        cond = cond & salted[k].eqNullSafe(renamed[f"__k{i}"])
    return salted.join(renamed, cond, how).drop(*drop, "__salt", "__s")


def scratch(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; raises if the session names none."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)
