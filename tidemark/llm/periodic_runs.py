"""Periodic run detection: seeds on diagonals, extended once per stretch.

A run is a stretch of consecutive words whose smallest period is ``q`` (words ``q`` apart are identical), of at least
``max(MIN_WORDS, MIN_EXPONENT * q)`` words, that no neighbouring word extends.  Such a run makes the text agree with
itself, shifted by ``q``, over at least ``max(MIN_WORDS, MIN_EXPONENT * q) - q`` words: on the diagonal of lag ``q`` lies a
stretch of that overlap.  Periods are taken in bands whose longest period is no longer than the overlap its shortest
period guarantees; this overlap is the band's seed length ``k``.

* Index: the ``k``-grams that occur twice or more in a document get exact names by doubling (a name of ``2j`` words is the
  pair of names of its halves), so no hash can join or part two of them.
* Occurrence pairs: since ``k`` is at least the period, the occurrence ``q`` words on is the *next* one inside a run of
  smallest period ``q`` (a nearer one would give the run a smaller period).  So only neighbouring occurrences in the same
  document are paired, at most one pair per word and band, and what a pair finds has ``q`` as its smallest period.
* Extension: a pair is extended to both sides by comparing words; a table of the furthest place covered per lag leaves out
  the pairs inside a stretch that is already extended.

Documents are worked on about a megabyte of text at a time, inside one row-wise pass without a shuffle; a document's work grows
with its words times the number of bands (the logarithm of its length to base 3).

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; texts of any length are taken whole; ties
between runs are settled by start, then period; repeated rows are worked on one by one; an empty table gives an empty result.  An
input column named like a result column (``runs``, ``collapsed``) is replaced; all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import _slices
from .common import words_of

MIN_WORDS = 6
MIN_EXPONENT = 4
RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def bands(longest: int) -> Iterator[tuple[int, int]]:
    """(shortest period, seed length) of each band; the seed length is its longest period too."""
    low = 1
    while max(MIN_WORDS, MIN_EXPONENT * low) <= longest:
        seed = max(MIN_WORDS, MIN_EXPONENT * low) - low
        yield low, seed
        low = seed + 1


class _Grams:
    """Names of the grams that repeat inside a document, by doubling; -1 where a gram does not repeat."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        self.n, self.size = len(words), 1
        self.names = self._named(np.arange(self.n), doc * (int(words.max(initial=0)) + 1) + words)

    def _named(self, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        _, name, count = np.unique(key, return_inverse=True, return_counts=True)
        names = np.full(self.n, -1, np.int64)
        again = count[name] > 1
        names[at[again]] = name[again]
        return names

    def pairs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a gram of ``length`` words can repeat, and the key of the gram there."""
        while 2 * self.size <= length:
            at, key = self._joined(2 * self.size)
            self.names, self.size = self._named(at, key), 2 * self.size
        return self._joined(length)

    def _joined(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        # a gram can only repeat where both of its parts do; the first word's name tells documents apart, and two documents
        # meet at one place only, so a gram over their border never repeats
        shift = length - self.size
        at = np.flatnonzero((self.names[: self.n - shift] >= 0) & (self.names[shift:] >= 0)) if shift < self.n else np.zeros(0, np.int64)
        return at, self.names[at] * (int(self.names.max(initial=0)) + 1) + self.names[at + shift]


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Number of leading places at which ``a`` and ``b`` agree, read in growing pieces."""
    done, step = 0, 32
    while done < len(a):
        differ = np.flatnonzero(a[done : done + step] != b[done : done + step])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, 2 * step
    return len(a)


def find_runs(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Runs (start, length, period) of the documents whose words lie one after the other in ``words``.

    ``starts`` holds the place of each document's first word, and the number of words at its end.  Starts count from the
    first word of all; rows are sorted by start, then period.
    """
    lengths = np.diff(starts)
    if not len(words) or lengths.max() < MIN_WORDS:
        return np.zeros((0, 3), np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    begin, end = starts[:-1][doc], starts[1:][doc]
    grams = _Grams(words.astype(np.int64), doc)
    found: list[tuple[int, int, int]] = []
    covered: dict[int, int] = {}
    for low, k in bands(int(lengths.max())):
        at, key = grams.pairs(k)
        inside = at + k <= end[at]
        at, key = at[inside], key[inside]
        if not len(at):
            break  # no gram of k words repeats, so no longer one does
        order = np.argsort(key, kind="stable")
        here, there = at[order[:-1]], at[order[1:]]
        lag = there - here
        pair = np.flatnonzero((key[order[:-1]] == key[order[1:]]) & (lag >= low) & (lag <= k))
        pair = pair[np.lexsort((here[pair], lag[pair]))]
        for i, q in zip(here[pair].tolist(), lag[pair].tolist()):
            if i < covered.get(q, 0):
                continue
            a, z = int(begin[i]), int(end[i])
            left = i - _agreeing(words[a:i][::-1], words[a + q : i + q][::-1])
            right = i + k + _agreeing(words[i + k : z - q], words[i + k + q : z])
            covered[q] = right
            if right - left + q >= max(MIN_WORDS, MIN_EXPONENT * q):
                found.append((left, right - left + q, q))
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _worked(texts) -> tuple[pa.Array, pa.Array]:
    """The runs and the collapsed text of each text of an Arrow string array."""
    number: dict[bytes, int] = {}
    split = [t.as_buffer().to_pybytes().split() if t.is_valid else [] for t in texts]  # bytes split at ASCII white space
    words = np.fromiter((number.setdefault(w, len(number)) for doc in split for w in doc), np.int64, sum(map(len, split)))
    starts = np.cumsum([0, *map(len, split)])
    runs = find_runs(words, starts)
    first = np.searchsorted(runs[:, 0], starts)  # runs of document i: first[i] to first[i + 1]
    collapsed = []
    for i, doc in enumerate(split):
        if first[i] < first[i + 1]:
            own = runs[first[i] : first[i + 1]]
            edge = np.zeros(len(doc) + 1, np.int64)
            np.add.at(edge, own[:, 0] + own[:, 2] - starts[i], 1)
            np.add.at(edge, own[:, 0] + own[:, 1] - starts[i], -1)
            doc = [doc[j] for j in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
        collapsed.append(b" ".join(doc))
    places = runs[:, 0] - np.repeat(starts[:-1], np.diff(first))
    items = pa.StructArray.from_arrays([pa.array(places), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), items), pa.array(collapsed, pa.binary()).cast(pa.string())


def periodic_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``df`` with ``runs`` (start, length, period; by start, then period) and ``collapsed``, the words that no run repeats, joined by a space."""
    rest = [c for c in df.columns if c not in (runs, collapsed)]
    place = rest.index(text)

    def work(batches):
        for whole in batches:
            for batch in _slices(whole, whole.schema.names[place]):
                yield pa.RecordBatch.from_arrays([*batch.columns, *_worked(batch.column(place))], [*rest, runs, collapsed])

    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(runs, RUN), T.StructField(collapsed, T.StringType())])
    return df.select(*rest).mapInArrow(work, schema)


def planted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the contract's repeats: in a tenth of the documents the words from a place on repeat a stretch of them.

    A null key plants nothing.  Words are joined by a space there; all other texts stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    df = df.withColumn("__g", F.floor(h / 10).cast("long"))
    df = df.withColumn("__w", F.when(h % 10 == 0, words_of(F.col(text))))
    n, g, w = F.size("__w").cast("long"), F.col("__g"), F.col("__w")
    df = df.withColumn("__a", F.when(n > 0, g % n))
    df = df.withColumn("__p", F.when(n > 0, 1 + F.floor((n - F.col("__a")) / (3 + g % 8)).cast("long")))
    a, p = F.col("__a"), F.col("__p")
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    edited = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i).cast("int"))), " ")
    return df.withColumn(text, F.when(n > 0, edited).otherwise(F.col(text))).drop("__g", "__w", "__a", "__p")


def _part(name: str) -> Column:
    """A field of the longest run; ties to the smallest start, then period."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return longest["length"] if name == "length" else -longest[name]


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the runs of every document (with the contract's planted repeats) and its collapsed text, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = periodic_runs(planted(docs))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        _part("start").alias("start"),
        _part("length").alias("length"),
        _part("period").alias("period"),
        F.floor(1000 * _part("length") / _part("period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
