"""Quality rules with risk-controlled cutoffs (DataFrame functions only).

Each rule rejects a document whose metric lies above a cutoff.  Cutoffs are not guessed: on the labelled
documents of each stratum (language) the number of good documents that the rules together would reject is tested
against the allowed rate with the exact binomial tail.  The rules are tightened in step: at level j each of them stands at
the j-th cutoff of its grid (or its last).  A level is certified when the hypothesis "its rules together reject more
than ``alpha`` of the good documents" is refuted at level ``delta`` divided by the number of strata (Bonferroni);
levels are tested from lax to strict up to the first failure (fixed sequence), so no further correction is
needed.  Whatever cutoffs are then chosen at or below the last certified level, they reject a part of what that level
rejects, so the bound holds for all rules of a stratum together.  Among them each rule takes the one that separates best
(share of bad rejected minus share of good rejected), ties to the laxest; with none, or none that separates, it rejects
nothing in that stratum.

Defined cases: null text has no words and fails the base rules; a null stratum is a stratum of its own;
several labels of one document count as its lowest quality; null quality is no label; repeated rows each get
the verdict; empty tables give empty results (and without labels no rule rejects).  Extra columns pass
through whatever their names, but for those an operator returns itself; ``kept_rows`` returns the caller's columns alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, attach, shelter, stored, text_of, words_of

SYMBOLS = "[#*$%&|<>]"

#: rule -> (numerator, denominator); the metric is their ratio, 0 where the denominator is 0.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
}
#: Candidate cutoffs in hundredths, from lax to strict; a document is rejected above the cutoff.
GRID: dict[str, list[int]] = {
    "symbols": [200, 150, 100, 75, 50, 40, 30, 20, 15, 10, 5],
    "word_length": [5000, 3000, 2000, 1500, 1200, 1100, 1000, 900, 800],
    "dup_lines": [95, 90, 80, 70, 60, 50, 40, 30, 20, 10],
    "repeats": [95, 90, 80, 70, 60, 50, 45, 40, 35, 30, 25, 20],
    "capitals": [90, 80, 70, 60, 50, 40, 30, 25, 20, 15],
}
LEVELS = max(len(grid) for grid in GRID.values())
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = [*BASE, "n_lines", "n_capitals"]


def _repeated(words: str) -> tuple[Column, Column]:
    """Sorted (hash, place) of all 3-word windows, and the places of windows that occur twice or more."""
    n = F.size(words)
    w = F.col(words)
    grams = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))))
    g = F.col("__grams")
    again = F.sort_array(
        F.transform(
            F.filter(g, lambda x, j: ((j > 0) & (F.get(g, j - 1)["h"] == x["h"])) | F.coalesce(F.get(g, j + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"],
        )
    )
    return grams, again


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the MEASURES (long) of the whole text; an input column of such a name is replaced."""
    df, back = shelter(docs.drop(*MEASURES), text)
    lines = F.filter(F.split(text_of(text), "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != F.lit(""))
    df = df.withColumn("__words", words_of(text_of(text))).withColumn("__lines", lines)
    grams, again = _repeated("__words")
    df = df.withColumn("__grams", grams).withColumn("__again", again)
    covered = F.aggregate(
        "__again",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    joined = F.array_join("__words", "")
    out = {
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.char_length(joined).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(joined, "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        "n_lines": F.size("__lines").cast("long"),
        "n_capitals": F.char_length(F.regexp_replace(joined, "[^A-Z]+", "")).cast("long"),
    }
    # a generator of one row: filters on the measures stay above it, where they are computed once
    row = F.inline(F.array(F.struct(*[e.alias(c) for c, e in out.items()])))
    return back(df.select("*", row), *MEASURES)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _above(rule: str, cut: Column) -> Column:
    """Whether the rule's metric exceeds ``cut`` hundredths, in whole numbers."""
    num, den = RULES[rule]
    return (F.col(den) > 0) & (F.col(num) * 100 > cut * F.col(den))


def _allowed(n: Column, alpha: float, level: Column) -> Column:
    """The most rejections k of n for which P(X <= k), X binomial(n, alpha), is at most ``level``; -1 if none.

    The tail is summed term by term in logarithms, up to the mean n * alpha, beyond which it exceeds any level below 1/2.
    """
    ratio = math.log(alpha) - math.log1p(-alpha)
    first = n * math.log1p(-alpha)
    most = F.least(n, F.floor(n * alpha).cast("long"))
    start = F.struct(first.alias("t"), first.alias("s"), F.when(first <= F.log(level), F.lit(0)).otherwise(F.lit(-1)).cast("long").alias("k"))

    def step(acc, i):
        t = acc["t"] + F.log(n - i + 1) - F.log(i.cast("double")) + ratio
        top = F.greatest(acc["s"], t)
        s = top + F.log(F.exp(acc["s"] - top) + F.exp(t - top))
        return F.struct(t.alias("t"), s.alias("s"), F.when(s <= F.log(level), i).otherwise(acc["k"]).alias("k"))

    steps = F.when(most >= 1, F.sequence(F.lit(1).cast("long"), most)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, step, lambda acc: acc["k"])


def certify(measured: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """One row per stratum: ``stratum`` and ``cut_<rule>`` in hundredths (null: the rule rejects nothing there).

    ``measured`` has the MEASURES of every document; every labelled document counts (no sample).  Documents
    that fail the base rules are not in the holdout: the verdict is never asked for them.
    """
    lab = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg((F.min("quality") > 0).alias("__good"))
    hold = measured.where(~base_failed()).select(F.col(stratum).alias("__stratum"), F.col(key).alias("__key"), *MEASURES).join(lab, "__key")
    counts = [F.count_if("__good").alias("n_good"), F.count_if(~F.col("__good")).alias("n_bad")]
    for j in range(LEVELS):
        hits = [_above(rule, F.lit(grid[min(j, len(grid) - 1)])) for rule, grid in GRID.items()]
        counts.append(F.count_if(F.col("__good") & F.array_contains(F.array(*hits), True)).alias(f"u_{j}"))
    for rule, grid in GRID.items():
        for i, cut in enumerate(grid):
            hit = _above(rule, F.lit(cut))
            counts += [F.count_if(hit & F.col("__good")).alias(f"g_{rule}_{i}"), F.count_if(hit & ~F.col("__good")).alias(f"b_{rule}_{i}")]
    by = hold.groupBy("__stratum").agg(*counts)  # one row per stratum, pre-aggregated where the rows are
    by = stored(by)
    by = by.withColumn("__k", _allowed(F.col("n_good"), alpha, F.lit(delta / max(1, by.count()))))
    # rejections grow with the level, so "all laxer levels passed" is "this one passes"
    passed = F.array_size(F.filter(F.array(*[F.col(f"u_{j}") for j in range(LEVELS)]), lambda u: u <= F.col("__k")))
    by = by.withColumn("__levels", passed)
    cuts = []
    for rule, grid in GRID.items():
        tried = F.array(
            *[
                F.struct(
                    (F.col(f"b_{rule}_{i}").cast("double") * F.col("n_good") - F.col(f"g_{rule}_{i}").cast("double") * F.col("n_bad")).alias("gain"),
                    F.lit(-i).alias("i"),
                    F.lit(cut).alias("cut"),
                    (F.lit(i) < F.col("__levels")).alias("ok"),
                )
                for i, cut in enumerate(grid)
            ]
        )
        cuts.append(F.array_max(F.filter(tried, lambda x: x["ok"] & (x["gain"] > 0)))["cut"].alias(f"cut_{rule}"))
    return by.select(F.col("__stratum").alias(stratum), *cuts)


def apply_rules(measured: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` plus ``base_failed``, ``rejected_by`` (rules, in RULES order) and ``kept``."""
    out = attach(measured.drop("base_failed", "rejected_by", "kept", *[f"cut_{r}" for r in RULES]), stored(cuts), [stratum])
    hits = [F.when(F.coalesce(_above(r, F.col(f"cut_{r}")), F.lit(False)), F.lit(r)) for r in RULES]
    out = out.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.array_compact(F.array(*hits)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop(*[f"cut_{r}" for r in RULES])


def kept_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", **risk) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    Texts are measured twice, for the certificate and for the verdict: storing them with their measures instead costs an
    executor more memory than a second look at them costs time.
    """
    work, back = shelter(docs, key, text, stratum)
    cuts = certify(measure(work.select(key, stratum, text), text).drop(text), labels, stratum, key, **risk)
    return back(apply_rules(measure(work, text), cuts, stratum).where("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document with its measures, the base verdict and the certified verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    measured = stored(measure(docs.select("doc_id", "lang", "text")).drop("text"))  # whole texts are read once
    return apply_rules(measured, certify(measured, labels)).select("doc_id", *BASE, "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def oracle() -> str:
    """The same in SQL: measures by unnesting, the binomial tail with lgamma."""
    alpha, delta = 0.01, 0.05
    tries = " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, {i} AS i, {cut} AS cut, lang, good, {den} > 0 AND {num} * 100 > {cut} * {den} AS hit FROM hold"
        for rule, (num, den) in RULES.items()
        for i, cut in enumerate(GRID[rule])
    )
    joint = " UNION ALL ".join(
        f"SELECT {j} AS j, lang, good, " + " OR ".join(f"({den} > 0 AND {num} * 100 > {GRID[r][min(j, len(GRID[r]) - 1)]} * {den})" for r, (num, den) in RULES.items()) + " AS hit FROM hold"
        for j in range(LEVELS)
    )
    rejected = " || ".join(f"CASE WHEN coalesce({den} > 0 AND {num} * 100 > cut_{r} * {den}, false) THEN '{r},' ELSE '' END" for r, (num, den) in RULES.items())
    return f"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
hold AS (
  SELECT b.*, good FROM b JOIN (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) lab
  ON b.doc_id = lab.doc_id WHERE NOT base_failed),
tried AS (
  SELECT lang, rule, i, cut, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad,
         count(*) FILTER (hit AND good) AS g, count(*) FILTER (hit AND NOT good) AS bad
  FROM ({tries}) GROUP BY ALL),
joint AS (SELECT lang, j, count(*) FILTER (good) AS n_good, count(*) FILTER (hit AND good) AS g FROM ({joint}) GROUP BY ALL),
tail AS (
  SELECT lang, j, list_sum([exp(lgamma(n_good + 1) - lgamma(k + 1) - lgamma(n_good - k + 1) + k * ln({alpha}::DOUBLE) + (n_good - k) * ln(1 - {alpha}::DOUBLE)) for k in range(0, g + 1)])
              <= {delta}::DOUBLE / (SELECT count(*) FROM (SELECT DISTINCT lang FROM hold)) AS ok
  FROM joint),
certified AS (SELECT lang, count(*) FILTER (ok) AS levels FROM tail GROUP BY lang),
best AS (
  SELECT t.lang, rule, cut FROM tried t JOIN certified c ON t.lang IS NOT DISTINCT FROM c.lang
  WHERE i < levels AND bad * n_good > g * n_bad
  QUALIFY row_number() OVER (PARTITION BY t.lang, rule ORDER BY bad::DOUBLE * n_good - g::DOUBLE * n_bad DESC, i) = 1),
cuts AS (SELECT lang, {", ".join(f"max(cut) FILTER (rule = '{r}') AS cut_{r}" for r in RULES)} FROM best GROUP BY lang),
v AS (SELECT b.*, rtrim({rejected}, ',') AS rejected_by FROM b LEFT JOIN cuts ON b.lang IS NOT DISTINCT FROM cuts.lang)
SELECT doc_id, {", ".join(BASE)}, base_failed, NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM v"""
