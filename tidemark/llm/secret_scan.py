"""Secret scans: fixed patterns plus a randomness test battery (DataFrame functions only).

Base spans come from three patterns (assignments to secret names, access keys, hex runs).  Further candidates are whole
runs of 16 or more characters of the base62, base64 and base64url alphabets, each alphabet by itself: what one of
them does not hold cuts its runs, so NAME=VALUE and paths leave the value as a run of its own; '=' belongs to a run only as
padding at its end.  For each candidate the encoding is inferred (hex, base32, base62, base64, base64url) and three tests
ask whether its symbols look uniform:

* chi-squared of the symbol counts over the encoding's alphabet (Wilson-Hilferty tail),
* runs of symbols below and above the middle of the alphabet,
* serial correlation of neighbouring symbols.

Fisher's method combines the three to one p-value, uniform for random strings and near 0 for words and identifiers.
Claims are controlled per encoding and length class (half doublings), since short strings tell less.  How often a string
that is no secret gets a p-value above a cut is counted on strings made of the corpus' own words (``vocabulary``: the words of
all texts, in proportion to the number of texts that hold them), put together in the SHAPES of identifiers, paths and headings
(``known``).  Of the shapes of a class the one that reaches a cut most often counts, with one string more than were seen, (m + 1) / (n + 1),
so a cut that no string reached is not taken for one that none can reach.  At a cut at most (candidates of the class) times
that share are false; a class takes the lowest cut at which they are at most ``fdr`` of what lies above, and claims nothing
where no cut is.  The shares do not depend on the candidates' p-values; the number of made strings is fixed (EACH per shape and
length class), so the rule is the same for a corpus of any size.  A class with over fdr * EACH candidates for each
that lies above its cuts claims nothing, and so does a corpus in which no word is in two texts.

Places are code points.  Spans are rows (one per match) until they are put together per document.  Defined cases: null text
is empty; a null id is an id; repeated rows get equal results; of claimed runs that lie in one another the
longest counts; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, stored, text_of

KINDS = ["assign", "access", "hex", "random"]
# The patterns of the base scan.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"  # whole runs, so a limit on their length is the same as a filter afterwards
_PAD = "(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
#: Runs of each alphabet; those of the last two hold a symbol that base62 has not, so no run is found twice.
RANDOM = [
    "(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+" + _PAD,
    "(?<![A-Za-z0-9+/])(?=[A-Za-z0-9]*+[+/])[A-Za-z0-9+/]{16,}+" + _PAD,
    "(?<![A-Za-z0-9_-])(?=[A-Za-z0-9]*+[_-])[A-Za-z0-9_-]{16,}+" + _PAD,
]
ASSIGN_LEAST = 12

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: encoding -> (pattern of its strings, its symbols in order); the first that fits is taken.
ENCODINGS = {
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    "base32": ("^[A-Z2-7]+$", UPPER + "234567"),
    "base62": ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    "base64": ("^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    "base64url": ("^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
}
#: Cuts of the p-value, lowest first.
CUTS = [1e-4, 1e-3, 5e-3, 0.01, 0.02, *[i / 20 for i in range(1, 20)]]
LONGEST = 12  # half doublings: the class of 64 symbols and more
#: A word, alone or as a part of an identifier.
WORD = "(?:[A-Z]|(?<![A-Za-z])[a-z])[a-z]{2,14}+(?![a-z])"
SLOTS = 2_000  # words that made strings draw from, a word as often as its share of the corpus asks
EACH = 1_000  # made strings per shape and length class
SIZES = [(16, 22), (23, 31), (32, 45), (46, 63), (64, 127)]
SHAPES = 14


def _found(text: Column, kind: int, pattern: str, group: int) -> Column:
    """Array of (kind, j, gap, len, value): the j-th match follows ``gap`` characters after the one before."""
    gaps, hits = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    rows = F.transform(
        F.arrays_zip(hits.alias("h"), values.alias("v"), gaps.alias("g")),
        lambda x, j: F.struct(F.lit(kind).alias("kind"), j.alias("j"), F.char_length(x["g"]).cast("long").alias("gap"), F.char_length(x["h"]).cast("long").alias("len"), x["v"].alias("value")),
    )
    none = F.array().cast("array<struct<kind:int,j:int,gap:bigint,len:bigint,value:string>>")
    # the last gap follows the last match and belongs to none
    return F.when(text.rlike(pattern), F.filter(rows, lambda x: x["len"].isNotNull())).otherwise(none)


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(__id, __th, kind, start, end, value): all matches, in code points, one row for each of equal documents."""
    df = docs.select(F.col(key).alias("__id"), text_of(text).alias("__t")).withColumn("__th", F.xxhash64("__t"))
    t = F.col("__t")
    found = F.concat(_found(t, 0, ASSIGN, 1), _found(t, 1, ACCESS, 0), _found(t, 2, HEX, 0), *[_found(t, 3 + i, r, 0) for i, r in enumerate(RANDOM)])
    rows = df.select("__id", "__th", F.explode(found).alias("m")).select("__id", "__th", "m.*")
    rows = rows.groupBy("__id", "__th", "kind", "j").agg(*[F.first(c).alias(c) for c in ("gap", "len", "value")])  # repeated documents
    order = Window.partitionBy("__id", "__th", "kind").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)  # of one document
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order)).withColumn("start", F.col("end") - F.col("len"))
    rows = rows.withColumn("kind", F.least("kind", F.lit(3)))
    return rows.where((F.col("kind") != 0) | (F.char_length("value") >= ASSIGN_LEAST)).drop("j", "gap", "len")


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z) by the rational approximation of Abramowitz and Stegun 7.1.26 (error below 1e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _places(chars: Column, alphabet: str) -> Column:
    return F.transform(chars, lambda c: F.call_function("locate", c, F.lit(alphabet)) - 1)


def battery(rows: DataFrame, value: str = "value") -> DataFrame:
    """``rows`` whose ``value`` fits an alphabet, with encoding, n_symbols and p_value."""
    df = rows.withColumn("__s", F.rtrim(F.col(value), F.lit("=")))
    enc, size = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, (pattern, alphabet) in reversed(ENCODINGS.items()):
        fits = F.col("__s").rlike(pattern)
        enc, size = F.when(fits, name).otherwise(enc), F.when(fits, len(alphabet)).otherwise(size)
    df = df.withColumns({"encoding": enc, "__k": size}).where(F.col("encoding").isNotNull())
    df = df.withColumn("__s", F.when(F.col("encoding") == "hex", F.lower("__s")).otherwise(F.col("__s")))
    at, chars = F.lit(None).cast("array<int>"), F.filter(F.split("__s", ""), lambda c: c != "")
    for name, (_, alphabet) in ENCODINGS.items():  # a literal alphabet: a column would be worked out again for every symbol
        at = F.when(F.col("encoding") == name, _places(chars, alphabet)).otherwise(at)
    df = df.withColumn("__a", at)
    a, k = F.col("__a"), F.col("__k").cast("double")
    n = F.size(a)
    df = df.withColumn("n_symbols", n.cast("long")).where("n_symbols >= 2")
    squares = F.aggregate(
        F.sort_array(a),
        F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("s")),
        lambda acc, x: F.struct(
            x.alias("last"),
            F.when(x == acc["last"], acc["r"] + 1).otherwise(F.lit(1).cast("long")).alias("r"),
            (acc["s"] + 2 * F.when(x == acc["last"], acc["r"] + 1).otherwise(F.lit(1).cast("long")) - 1).alias("s"),
        ),
        lambda acc: acc["s"],
    )
    mean = (k - 1) / 2
    walk = F.aggregate(
        a,
        F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).cast("long").alias("up"), F.lit(0).cast("long").alias("turns"), F.lit(0.0).alias("cov")),
        lambda acc, x: F.struct(
            x.alias("last"),
            (acc["up"] + (x > mean).cast("int")).alias("up"),
            (acc["turns"] + F.coalesce(((x > mean) != (acc["last"] > mean)).cast("int"), F.lit(0))).alias("turns"),
            (acc["cov"] + F.coalesce((x - mean) * (acc["last"] - mean), F.lit(0.0))).alias("cov"),
        ),
    )
    df = df.withColumn("__sq", squares).withColumn("__w", walk)
    n, up, turns, cov = F.col("n_symbols").cast("double"), F.col("__w.up"), F.col("__w.turns"), F.col("__w.cov")
    chi, dof = k / n * F.col("__sq") - n, k - 1
    z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / dof) - (1 - 2 / (9 * dof))) / F.sqrt(2 / (9 * dof))
    both = 2.0 * up * (n - up)
    var = both * (both - n) / (n * n * (n - 1))
    z_runs = F.when(var > 0, (turns + 1 - (1 + both / n)) / F.sqrt(F.when(var > 0, var).otherwise(F.lit(1.0)))).otherwise(F.lit(8.0))
    z_serial = cov / ((k * k - 1) / 12) / F.sqrt(n - 1)
    df = df.withColumns({"__p1": _upper_tail(z_chi), "__p2": 2 * _upper_tail(F.abs(z_runs)), "__p3": 2 * _upper_tail(F.abs(z_serial))})
    half = -sum((F.log(F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(1e-300))) for c in ("__p1", "__p2", "__p3")), F.lit(0.0))
    df = df.withColumn("__h", half).withColumn("p_value", F.exp(-F.col("__h")) * (1 + F.col("__h") + F.col("__h") * F.col("__h") / 2))
    return df.drop("__s", "__k", "__a", "__sq", "__w", "__p1", "__p2", "__p3", "__h")


def vocabulary(docs: DataFrame, text: str = "text", slots: int = SLOTS) -> list[str]:
    """About ``slots`` words: each one's place count is its share of all (text, word) pairs times ``slots``, rounded up or down by its hash.

    Every text counts, whole; words of one text only do not, as random strings hold such.
    """
    words = F.array_distinct(F.transform(F.regexp_extract_all(text_of(text), F.lit(WORD), F.lit(0)), F.lower))
    counts = stored(docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n >= 2"))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return []
    luck = F.pmod(F.xxhash64(F.lit(5), "w"), F.lit(1 << 30)) / (1 << 30)
    places = counts.select("w", F.floor(F.col("n") * slots / total + luck).alias("k")).where("k >= 1")
    return [r["w"] for r in places.orderBy("w").collect() for _ in range(r["k"])]  # ``slots`` on average, whatever the corpus


def known(spark: SparkSession, words: list[str], each: int = EACH) -> DataFrame:
    """(value, shape): strings of ``words`` that are no secrets, ``each`` of every shape and length class; none without words."""
    rows = spark.range(SHAPES * len(SIZES) * each if words else 0)
    shape, nth = F.pmod(F.col("id"), F.lit(SHAPES)), F.floor(F.col("id") / SHAPES) % len(SIZES)
    lows, highs = F.array(*[F.lit(a) for a, _ in SIZES]), F.array(*[F.lit(b) for _, b in SIZES])
    size = F.get(lows, nth.cast("int")) + F.pmod(F.xxhash64("id"), F.get(highs, nth.cast("int")) - F.get(lows, nth.cast("int")) + 1).cast("int")
    rows = rows.select("id", shape.cast("int").alias("shape"), size.alias("size"))
    draw = lambda i, n: F.pmod(F.xxhash64(F.lit(17), "id", i), F.lit(n)).cast("int")
    hexes = [w for w in words if not w.strip("abcdef")] or ["0"]
    names, hexes_ = F.split(F.lit(" ".join(words)), " "), F.split(F.lit(" ".join(hexes)), " ")
    steps = F.sequence(F.lit(0), F.lit(42))  # of three letters or more each
    joined = lambda fn, by="": F.array_join(F.transform(steps, fn), by)
    lower, title = lambda i: F.get(names, draw(i, len(words))), lambda i: F.initcap(F.get(names, draw(i, len(words))))
    number = lambda i: draw(-i - 1, 1000).cast("string")
    made = [
        joined(lower), joined(title), joined(lambda i: F.concat(lower(i), number(i))), joined(lambda i: F.concat(title(i), number(i))),
        joined(lower, "_"), joined(lower, "-"), joined(lambda i: F.concat_ws("-", title(i), number(i)), "-"), F.upper(joined(lower, "_")),
        joined(lower, "/"), joined(title, "/"), joined(lambda i: F.concat_ws("/", lower(i), number(i)), "/"),
        F.upper(joined(lower)), F.repeat(joined(lambda i: draw(i, 10).cast("string")), F.lit(3)), joined(lambda i: F.concat(F.get(hexes_, draw(i, len(hexes))), number(i))),
    ]
    value = F.coalesce(*[F.when(F.col("shape") == k, F.substring(m, F.lit(1), F.col("size"))) for k, m in enumerate(made)])
    return stored(rows.select(value.alias("value"), "shape"))  # so that no later plan holds the words


def _class() -> Column:
    """Length class: half doublings."""
    return F.least(F.lit(LONGEST), F.floor(2 * F.log2(F.col("n_symbols").cast("double"))).cast("int"))


def _above() -> Column:
    return F.array(*[F.count_if(F.col("p_value") >= c) for c in CUTS]).alias("__above")


def shares(made: DataFrame, each: int = EACH) -> DataFrame:
    """(encoding, __len, __f): per class the share of strings that are no secrets at or above every cut, by its worst shape."""
    per = battery(made).groupBy("encoding", _class().alias("__len"), "shape").agg(F.count("*").alias("n"), _above())
    per = per.where(F.col("n") >= each // 10)  # a shape is of the encodings that a tenth of its strings fit
    worst = [F.max((F.get("__above", F.lit(i)) + 1) / (F.col("n") + 1)) for i in range(len(CUTS))]
    return stored(per.groupBy("encoding", "__len").agg(F.array(*worst).alias("__f")))


def claim(tested: DataFrame, null: DataFrame, fdr: float = 0.1) -> DataFrame:
    """The rows of ``tested`` that are claimed as secrets, by the ``shares`` of strings that are none."""
    df = stored(tested).withColumn("__len", F.greatest(F.lit(8), _class()))  # shorter ones than the candidates' least length are judged like those
    hist = df.groupBy("encoding", "__len").agg(F.count("*").alias("n"), _above())  # encodings times classes of length
    hist = hist.join(null, ["encoding", "__len"])
    passes = lambda x: (x["__above"] > 0) & (F.col("n") * x["__f"] <= fdr * x["__above"])
    cut = F.array_min(F.transform(F.arrays_zip("__above", "__f", F.lit(CUTS).alias("c")), lambda x: F.when(passes(x), x["c"])))
    cuts = stored(hist.select("encoding", "__len", cut.alias("__cut")))  # no cut is null, which no p-value reaches
    return attach(df, cuts, ["encoding", "__len"], "inner").where(F.col("p_value") >= F.col("__cut")).drop("__len", "__cut")


def outermost(claimed: DataFrame) -> DataFrame:
    """The rows of ``claimed`` that lie in no other one of their document."""
    before = Window.partitionBy("__id", "__th").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)  # of one document
    return claimed.withColumn("__reach", F.max("end").over(before)).where(F.col("__reach").isNull() | (F.col("end") > F.col("__reach"))).drop("__reach")


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", fdr: float = 0.1) -> DataFrame:
    """(__id, __th, kind, start, end): base spans and claimed ones; __th is the hash of the text."""
    found = stored(matches(docs, key, text))  # the matches alone, not the texts
    cols = ["__id", "__th", "kind", "start", "end"]
    null = shares(known(docs.sparkSession, vocabulary(docs, text)))
    claimed = outermost(claim(battery(found.where(F.col("kind") == 3)).drop("value"), null, fdr).select(cols))
    return found.where(F.col("kind") < 3).select(cols).unionByName(claimed.select(cols))


def summaries(docs: DataFrame, key: str = "doc_id", text: str = "text", fdr: float = 0.1) -> DataFrame:
    """Per document the counts of base spans, the digest of their list, and all spans as a list."""
    per = spans(docs, key, text, fdr).groupBy("__id", "__th").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("__all"))  # of one document
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    base = docs.select(F.col(key), F.xxhash64(text_of(text)).alias("__th0"))
    out = base.join(per, base[key].eqNullSafe(per["__id"]) & (base["__th0"] == per["__th"]), "left")
    out = out.withColumn("__all", F.coalesce("__all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    of_kind = lambda i: F.filter("__all", lambda x: x["kind"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{KINDS[i]}") for i in range(3)]
    return out.select(key, *counts, F.sha2(shown(F.filter("__all", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), shown(F.col("__all")).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: spans of secrets per document."""
    return summaries(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
