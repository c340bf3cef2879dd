"""Document fingerprints: threshold-scaled sketches (DataFrame functions only).

A document is the set of its shingles (five words in a row; of fewer words, all of them).  Every shingle has a hash that looks
random (the first 48 bits of MD5), and a fingerprint keeps every hash below a bound.  The bound is a fixed fraction of all hashes,
1/16, so a long document keeps more hashes than a short one and a short one's share in a long one can be told from their
fingerprints; a document too short to keep LEAST hashes that way has a higher bound, just above its LEAST smallest hashes (and no
bound if it has no more).  The bound is part of the fingerprint:

    <bound, 12 hex digits, or 'all'>:<hashes, 12 hex digits each, ascending>

Two fingerprints are compared below the lower of their bounds, where both hold every hash of their documents.  So the shares of
common hashes there estimate resemblance and containment without bias, and a merge (the union below the lowest bound) is
the fingerprint, at that bound, of the documents' union.  With LEAST = 64 the standard error of an estimate r is at
most sqrt(r (1 - r) / 64), 0.06, whatever the lengths.

Words are the runs of characters other than ASCII white space, with A-Z in lower case.  Defined cases: null counts as the empty
text; a text without words keeps no hash (``all:``), and two such texts have likeness 1, one of them and any other 0; texts are taken
whole, whatever their length; equal texts have equal fingerprints; an empty table gives an empty result.  The next document is
the one with the next larger key (after the largest: the smallest; null before all others); where the key repeats, the smallest of
its texts stands for the next document and every row of the key gets a result.  Columns in ``keep`` pass through; those named like a
result column are left out.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of, words_of
from .ordering import place

WIDTH = 5
FRACTION = 16
LEAST = 64
DIGITS = 12
CEILING = f"{16**DIGITS // FRACTION:0{DIGITS}x}"
#: Above every hash, as a string.
ALL = "all"
BEYOND = "g"
RESULTS = ("n_chars", "edited", "fingerprint", "edited_fingerprint", "next_fingerprint", "near_edited", "near_next")


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """The ascending distinct hashes of a text's shingles."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)

    def of(words):
        digest = lambda shingle: F.substring(F.md5(shingle.cast("binary")), 1, DIGITS)
        spaced = lambda i: F.concat(F.get(words, i), *[x for k in range(1, width) for x in (F.lit(" "), F.get(words, i + k))])
        places = F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)))
        hashes = F.sort_array(F.array_distinct(F.transform(places, lambda i: digest(spaced(i)))))
        return F.when(F.size(words) >= width, hashes).when(F.size(words) > 0, F.array(digest(F.array_join(words, " ")))).otherwise(F.array().cast("array<string>"))

    return _let(words_of(lower), of)


def fingerprint(text: Column, width: int = WIDTH, least: int = LEAST) -> Column:
    """The fingerprint of a text (no null) as a string."""

    def of(hashes):
        bound = F.when(F.size(hashes) > least, F.greatest(F.lit(CEILING), F.get(hashes, F.lit(least)))).otherwise(F.lit(ALL))
        return _let(bound, lambda b: F.concat(b, F.lit(":"), F.array_join(F.when(b == ALL, hashes).otherwise(F.filter(hashes, lambda h: h < b)), "")))

    return _let(shingle_hashes(text, width), of)


def bound_of(fp: Column) -> Column:
    """The bound as a string that compares with hashes."""
    name = F.substring_index(fp, ":", 1)
    return F.when(name == ALL, F.lit(BEYOND)).otherwise(name)


def hashes_of(fp: Column) -> Column:
    """The hashes of a fingerprint, ascending."""

    def of(joined):
        n = F.floor(F.length(joined) / DIGITS).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(joined, i * DIGITS + 1, F.lit(DIGITS)))
        return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))

    return _let(F.substring_index(fp, ":", -1), of)


def _below(a: Column, b: Column, fn) -> Column:
    """``fn`` of both fingerprints' hashes below the lower bound."""
    bound = F.least(bound_of(a), bound_of(b))
    both = F.struct(bound.alias("t"), hashes_of(a).alias("a"), hashes_of(b).alias("b"))
    cut = lambda hashes, t: F.when(t == BEYOND, hashes).otherwise(F.filter(hashes, lambda h: h < t))
    return _let(both, lambda s: _let(F.struct(cut(s["a"], s["t"]).alias("a"), cut(s["b"], s["t"]).alias("b")), fn))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance (size of the intersection by that of the union) of two fingerprints' documents; 1 for two empty ones."""

    def of(s):
        common = lambda n: F.when(F.size(s["a"]) + F.size(s["b"]) == 0, F.lit(1.0)).otherwise(n / (F.size(s["a"]) + F.size(s["b"]) - n))
        return _let(F.size(F.array_intersect(s["a"], s["b"])), common)

    return _below(a, b, of)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a``'s document that ``b``'s has too; 1 if ``a``'s has none."""

    def of(s):
        return F.when(F.size(s["a"]) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(s["a"], s["b"])) / F.size(s["a"]))

    return _below(a, b, of)


def merged(df: DataFrame, keys: list[str], fp: str = "fingerprint") -> DataFrame:
    """The merge per ``keys``, a row per kept hash: ``keys``, bound ('g': none), hash (null where no document has a shingle).

    Hashes are rows, so a group's union may outgrow a task's memory; documents of one group meet only in map-side combined counts.
    """
    bounds = df.groupBy(*keys).agg(F.min(bound_of(F.col(fp))).alias("bound"))
    rows = df.select(*keys, F.explode(hashes_of(F.col(fp))).alias("hash")).distinct()
    match = None
    for i, k in enumerate(keys):
        rows = rows.withColumnRenamed(k, f"__k{i}")
        c = bounds[k].eqNullSafe(rows[f"__k{i}"])
        match = c if match is None else match & c
    return bounds.join(rows, match & (rows["hash"] < bounds["bound"]), "left").select(*keys, "bound", "hash")


def with_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """key, ``keep``, text, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint, near_edited and near_next.

    The edited text has the last quarter of its characters replaced by as many of the next document's first ones.  Keys are put
    in order without the texts.  Then the texts are dealt by key once; of the next document only the characters that are needed
    and the fingerprint are sent to the row before it.
    """
    keep = [c for c in keep or [] if c not in (key, text, *RESULTS)]
    columns = [F.col(c).alias(f"__c{i}") for i, c in enumerate(keep)]
    # in a struct a null key equals a null key
    own = docs.select(F.struct(F.col(key).alias("key")).alias("__id"), text_of(text).alias("__text"), *columns)
    ids = own.select(F.col("__id.key").alias("__key"), F.length("__text").alias("__n")).groupBy("__key").agg(F.floor(F.max("__n") / 4).cast("int").alias("__need"))
    placed = stored(place(ids, ["__key"]))
    n = placed.count()
    before = placed.select(((F.col("__place") + 1) % max(n, 1)).alias("__place"), F.col("__key").alias("__before"), "__need")
    id_of = lambda c: F.struct(F.col(c).alias("key"))
    before = placed.select("__place", id_of("__key").alias("__id")).join(before.select("__place", id_of("__before").alias("__before"), "__need"), "__place")
    before = stored(before.drop("__place"))
    own = own.withColumn("__fp", fingerprint(F.col("__text")))
    # both joins with ``own`` are by its key and read the same columns (but for ``keep``), so its rows are dealt once for
    # both; what a row is given is grouped by that key too, and not dealt again for the join
    given = F.struct(F.substring(F.col("__text"), F.lit(1), F.col("__need")).alias("head"), F.col("__fp").alias("fp"))
    there = own.join(before, "__id").select("__before", given.alias("__given"))
    given = there.groupBy("__before").agg(F.min("__given").alias("__given"))
    out = own.join(given, own["__id"] == given["__before"])
    chars = F.length("__text")
    cut = F.floor(chars / 4).cast("int")
    edited = F.concat(F.substring(F.col("__text"), F.lit(1), chars - cut), F.substring(F.col("__given.head"), F.lit(1), cut))
    out = out.withColumn("__edited", edited).withColumn("__fp2", fingerprint(F.col("__edited")))
    return out.select(
        F.col("__id.key").alias(key),
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(keep)],
        F.col("__text").alias(text),
        chars.cast("long").alias("n_chars"),
        F.col("__edited").alias("edited"),
        F.col("__fp").alias("fingerprint"),
        F.col("__fp2").alias("edited_fingerprint"),
        F.col("__given.fp").alias("next_fingerprint"),
        likeness(F.col("__fp"), F.col("__fp2")).alias("near_edited"),
        likeness(F.col("__fp"), F.col("__given.fp")).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op11: fingerprints of every document and of its edited text, and their likeness to each other and to the next document."""
    out = with_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def oracle() -> str:
    words = f"regexp_extract_all(translate({{0}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+')"
    hashes = f"list_sort(list_distinct(list_transform(range(greatest(len(w) - {WIDTH - 1}, least(len(w), 1))), lambda i: substr(md5(array_to_string(w[i + 1:i + {WIDTH}], ' ')), 1, {DIGITS}))))"
    like = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END::DOUBLE"
    cut = "list_filter({0}.k, lambda x: x < least({0}.b, {1}.b))".format
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (
  SELECT doc_id, t, length(t)::BIGINT AS n,
         coalesce(lead(t) OVER (ORDER BY doc_id NULLS FIRST, t), first_value(t) OVER (ORDER BY doc_id NULLS FIRST, t)) AS nxt
  FROM d),
e AS (SELECT doc_id, n, t, nxt, substr(t, 1, n - n // 4) || substr(nxt, 1, n // 4) AS edited FROM o),
w AS (SELECT doc_id, 0 AS kind, {words.format("t")} AS w FROM e UNION ALL SELECT doc_id, 1, {words.format("edited")} FROM e),
h AS (SELECT doc_id, kind, {hashes} AS hs FROM w),
b AS (SELECT doc_id, kind, hs, CASE WHEN len(hs) > {LEAST} THEN greatest('{CEILING}', hs[{LEAST + 1}]) ELSE '{BEYOND}' END AS b FROM h),
k AS (SELECT doc_id, kind, b, list_filter(hs, lambda x: x < b) AS k FROM b),
f AS (
  SELECT x.doc_id, x.k AS k, x.b AS b, {{'k': x.k, 'b': x.b}} AS own, {{'k': y.k, 'b': y.b}} AS ed,
         coalesce(lead({{'k': x.k, 'b': x.b}}) OVER (ORDER BY x.doc_id NULLS FIRST), first_value({{'k': x.k, 'b': x.b}}) OVER (ORDER BY x.doc_id NULLS FIRST)) AS nx
  FROM k x JOIN k y ON x.doc_id IS NOT DISTINCT FROM y.doc_id AND x.kind = 0 AND y.kind = 1),
c AS (
  SELECT doc_id, own, ed, {cut("own", "ed")} AS p, {cut("ed", "own")} AS q, {cut("own", "nx")} AS r, {cut("nx", "own")} AS s FROM f)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256,
       replace(own.b, '{BEYOND}', '{ALL}') || ':' || array_to_string(own.k, '') AS fingerprint,
       replace(ed.b, '{BEYOND}', '{ALL}') || ':' || array_to_string(ed.k, '') AS edited_fingerprint,
       {like.format("p", "q")} AS near_edited, {like.format("r", "s")} AS near_next
FROM e JOIN c ON e.doc_id IS NOT DISTINCT FROM c.doc_id"""
