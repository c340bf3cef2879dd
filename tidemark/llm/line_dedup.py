"""Cross-site line removal by distinct-site spread (DataFrame functions only).

Per line hash a HyperLogLog sketch of the sites that carry the line is merged by aggregation (map-side first).
Lines whose estimate lies clearly above ``min_sites`` are boilerplate, lines clearly below are not, and lines near
the threshold get an exact distinct count.  A boilerplate line stays once, where (document id, place) is
smallest, and goes everywhere else, so no content is lost.

A line is compared without white space at its ends.  Every line with a word takes part, however short (a line of a script
without spaces is one word); a caller who asks for more ``min_words`` spares shorter lines.  Defined cases: null text has no lines and stays null; a null site counts as one site; a null id is an
id of its own (the smallest); repeated rows get equal results and keep what the first of them keeps; lines keep
their order and bytes; a text without removed lines is returned unchanged.  Extra columns pass through whatever their names
(``remove_boilerplate`` replaces one named ``lines_removed``, ``cleaned_rows`` returns the caller's).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, attach, shelter, stored

LG_K = 12  # relative standard error 1.04 / sqrt(2 ** 12) = 1.6 %
BAND = 0.10  # six standard errors: estimates within it of the threshold are counted exactly


def _lines(docs: DataFrame, key: str, text: str, site: str, min_words: int) -> DataFrame:
    """(__id, __th, __site, __pos, __h): one row per line that can be boilerplate."""
    # anchored and possessive, so that a very long word is read once
    enough = f"^{SPACE_CLASS}*+({WORD_CLASS}++{SPACE_CLASS}++){{{max(0, min_words - 1)}}}{WORD_CLASS}"
    hashes = F.transform(F.split(F.col(text), "\n"), lambda x: F.when(x.rlike(enough), F.xxhash64(F.btrim(x, F.lit(" \t\x0b\f\r")))))
    return (
        docs.where(F.col(text).isNotNull())
        .select(F.col(key).alias("__id"), F.xxhash64(text).alias("__th"), F.coalesce(F.col(site).cast("string"), F.lit("\x00")).alias("__site"), F.posexplode(hashes).alias("__pos", "__h"))
        .where(F.col("__h").isNotNull())
    )


def spread(lines: DataFrame, min_sites: int) -> DataFrame:
    """Boilerplate lines: __h and __first, the (id, text hash, place) where the line stays."""
    per_line = (
        lines.groupBy("__h")
        .agg(F.count("*").alias("n"), F.hll_sketch_agg("__site", F.lit(LG_K)).alias("sk"), F.min(F.struct("__id", "__th", "__pos")).alias("__first"))
        .where(F.col("n") >= min_sites)
        .select("__h", "__first", F.hll_sketch_estimate("sk").alias("est"))
    )
    margin = max(1.0, BAND * min_sites)
    per_line = stored(per_line.where(F.col("est") >= min_sites - margin))
    near = per_line.where(F.col("est") <= min_sites + margin)
    pairs = attach(lines.select("__h", "__site"), near.select("__h", F.lit(True).alias("__near")), ["__h"], "inner", F.xxhash64("__site"))
    exact = pairs.groupBy("__h", "__site").agg(F.lit(1).alias("one")).groupBy("__h").agg(F.count("*").alias("sites"))
    counted = near.join(exact, "__h").where(F.col("sites") >= min_sites).select("__h", "__first")
    return per_line.where(F.col("est") > min_sites + margin).select("__h", "__first").unionByName(counted)


def remove_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 5, min_words: int = 1) -> DataFrame:
    """``docs`` with the cleaned ``text`` and ``lines_removed`` (long)."""
    docs, back = shelter(docs.drop("lines_removed"), key, text, site)
    lines = _lines(docs, key, text, site, min_words)
    flagged = stored(spread(lines, min_sites))
    gone = (
        attach(lines.drop("__site"), flagged, ["__h"], "inner", F.xxhash64("__id", "__th", "__pos"))
        .where(~F.struct("__id", "__th", "__pos").eqNullSafe(F.col("__first")))
        .groupBy("__id", "__th")
        .agg(F.collect_set("__pos").alias("__gone"))  # at most the lines of one document
    )
    base = docs.withColumn("__th0", F.xxhash64(text))
    out = base.join(gone, base[key].eqNullSafe(gone["__id"]) & (base["__th0"] == gone["__th"]) & base[text].isNotNull(), "left")
    parts = F.split(F.col(text), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    out = out.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept))
    return back(out.withColumn("lines_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long")), "lines_removed")


def cleaned_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", **options) -> DataFrame:
    """``docs`` with the cleaned ``text`` and no other change of column; a document left without a word by the removal goes."""
    work, back = shelter(docs, key, text, site)
    out = remove_boilerplate(work, key, text, site, **options)
    return back(out.where((F.col("lines_removed") == 0) | F.col(text).rlike(WORD_CLASS)))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document with its text after the removal of lines found on five sites or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_boilerplate(docs).select("doc_id", "text", "lines_removed")


def oracle() -> str:
    return """
WITH l AS (
  SELECT doc_id, source, i - 1 AS pos, parts[i] AS line, trim(parts[i], chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents))),
c AS (
  SELECT *, len(regexp_extract_all(bare, '[^\\x20\\x09-\\x0D]+')) >= 1 AS counts FROM l),
s AS (
  SELECT bare FROM c WHERE counts GROUP BY bare HAVING count(DISTINCT source) >= 5),
f AS (
  SELECT c.*, s.bare IS NOT NULL AND row_number() OVER (PARTITION BY c.bare ORDER BY doc_id, pos) > 1 AS gone
  FROM c LEFT JOIN s ON c.counts AND c.bare = s.bare)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS lines_removed
FROM f GROUP BY doc_id"""
