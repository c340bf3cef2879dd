"""Large JSON values read in pieces, so that one file is dealt over many tasks.

A file is read as text cut at a separator; Spark splits it as any text file.  A separator inside a string is told by the number of
quotes before it: every split counts its own, and one row per split carries the counts of the earlier ones.  Pieces of a cut
string are put together again.  Places are (start of the split, row in the split), so no split needs to know another's length.

A record array is cut at ``}`` and a column object at ``,``.  Its columns are told in the same way as quotes: the last column
name at or before an entry, carried over splits.  Rows of a column object meet by row name in one shuffle.

Defined cases: an empty file, an empty array and empty columns give no rows; a record or entry that is no flat JSON is an error;
rows of a column object without an entry for the time stamp are left out; columns that nobody asked for are skipped unread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ordered import materialize

_SPLIT = ["_file", "_block"]
_STRING = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
_HEAD = r"(?s)^[\s{\x{FEFF}]*" + _STRING + r"\s*:\s*\{"
_ENTRY = r"(?s)^\s*" + _STRING + r"\s*:\s*(.*?)[\s}]*$"


def _carried(df: DataFrame, value: Column, merge, name: str) -> DataFrame:
    """``df`` with ``name``: ``merge`` of ``value`` over the rows of the split before this one, and ``_carry``: that of the earlier splits."""
    inside = Window.partitionBy(*_SPLIT).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    splits = df.groupBy(*_SPLIT).agg(merge(value).alias("_m")).select(*_SPLIT, merge("_m").over(earlier).alias("_carry"))
    return df.withColumn(name, merge(value).over(inside)).join(splits, _SPLIT)


def json_items(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``_file, _block, _row, item``: the text of ``path`` cut at every ``sep`` that lies in no string."""
    raw = spark.read.option("lineSep", sep).text(path)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")]
    pieces = materialize(raw.select(*place, "value"))
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    d = pieces.withColumn("_q", F.char_length(F.regexp_replace(bare, '[^"]+', "")))
    d = _carried(d, F.col("_q"), F.sum, "_before")
    before = F.coalesce("_before", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    d = d.withColumns({"_inside": before % 2 == 1, "_open": (before + F.col("_q")) % 2 == 1}).drop("_before", "_carry", "_q")
    whole = d.filter(~F.col("_inside") & ~F.col("_open")).select(*_SPLIT, "_row", F.col("value").alias("item"))
    cut = d.filter(F.col("_inside") | F.col("_open"))
    start = F.when(~F.col("_inside"), F.struct("_block", "_row"))
    cut = _carried(cut, start, F.max, "_first")
    cut = cut.withColumn("_at", F.coalesce(start, "_first", "_carry"))
    parts = F.sort_array(F.collect_list(F.struct("_block", "_row", "value")))  # of one string
    again = cut.groupBy("_file", "_at").agg(F.array_join(F.transform(parts, lambda x: x["value"]), sep).alias("item"))
    return whole.unionByName(again.select("_file", F.col("_at._block").alias("_block"), F.col("_at._row").alias("_row"), "item"))


def _name(c: Column) -> Column:
    return F.lower(F.trim(c))


def _found(df: DataFrame, name: Column, wanted: Sequence[str]) -> list[str]:
    """Which of the ``wanted`` columns occur."""
    seen = df.select(name.alias("c")).filter(F.col("c").isin(*wanted)).distinct().collect()  # no more than ``wanted``
    return [c for c in wanted if c in {r["c"] for r in seen}]


def read_records(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """The ``wanted`` fields, as text, of an array of flat objects (or of objects one after the other)."""
    body = F.regexp_replace("item", r"^[\s,\[\]\x{FEFF}]+", "")
    items = json_items(spark, path, "}").select(body.alias("body")).filter(F.col("body") != "")
    fields = F.from_json(F.concat("body", F.lit("}")), "map<string,string>")
    fields = F.when(F.col("body").startswith("{") & fields.isNotNull(), fields).otherwise(F.raise_error(F.concat(F.lit("no flat JSON object: "), F.substring("body", 1, 80))))
    rows = materialize(items.select(fields.alias("f")))
    there = _found(rows.select(F.explode(F.map_keys("f")).alias("k")), _name(F.col("k")), wanted)
    value = lambda c: F.get(F.map_values(F.map_filter("f", lambda k, _: _name(k) == c)), F.lit(0))
    return rows.select(*[value(c).alias(c) for c in there])


def read_columns(spark: SparkSession, path: str, wanted: Sequence[str], key: str = "timestamp") -> DataFrame:
    """The ``wanted`` columns, as text, of an object of ``{column: {row: value}}`` maps; rows are those of column ``key``."""
    items = json_items(spark, path, ",")
    name = F.when(F.col("item").rlike(_HEAD), F.regexp_extract("item", _HEAD, 1))
    items = items.withColumn("_head", name)
    mark = F.when(F.col("_head").isNotNull(), F.struct("_block", "_row", "_head"))
    items = _carried(items, mark, F.max, "_last").withColumn("_column", _name(F.coalesce(F.col("_head"), F.col("_last._head"), F.col("_carry._head"))))
    entry = F.regexp_replace("item", _HEAD, "")
    items = items.select("_file", "_column", entry.alias("entry")).filter(F.col("_column").isin(*wanted) & ~F.col("entry").rlike(r"^[\s}]*$"))
    text = F.concat(F.lit('{"k":"'), F.regexp_extract("entry", _ENTRY, 1), F.lit('","v":'), F.regexp_extract("entry", _ENTRY, 2), F.lit("}"))
    parsed = F.when(F.col("entry").rlike(_ENTRY), F.from_json(text, "k string, v string"))
    bad = F.raise_error(F.concat(F.lit("no entry of a JSON column: "), F.substring("entry", 1, 80)))
    entries = materialize(items.select("_file", "_column", F.when(parsed["k"].isNotNull(), parsed).otherwise(bad).alias("e")))
    there = _found(entries, F.col("_column"), wanted)
    cells = [F.max(F.when(F.col("_column") == c, F.col("e.v"))).alias(c) for c in there]
    rows = entries.groupBy("_file", F.col("e.k").alias("_k")).agg(F.count_if(F.col("_column") == key).alias("_n"), *cells)
    return rows.filter("_n > 0").select(*there)
