"""Exact n-gram Jaccard join by T-occurrence search.

A document's set are its distinct ``width``-word shingles; two documents link when 100 * intersection >=
``percent`` * union.  A query with n shingles can only link with sets that share T = ceil(n * percent / 100) of them or
more, so the search is for the sets that occur on T or more of the query's inverted lists (DivideSkip): the L longest lists
are set aside, the short ones are merged and counted, sets that occur on fewer than T - L of them are dropped, and the
others are looked up in the long lists by binary search.  Everything is exact.

Spreading the search over a cluster:

1. ``doc_sets``: every text is read whole; equal sets become one node, so copies are never paired.  A set's marks are about one bit
   a shingle: whether an odd number of its shingles falls on the bit.
2. ``long_lists``: the list lengths of all shingles are counted; the longest lists (at most ``max_long``, a proven size) are
   known to every task, and a bit array of a fixed size says which shingles occur once only.  They only order the shingles, those of
   one set first, then short lists before long ones, and decide no result.
3. ``meetings``: if all but the first n - T + 1 shingles of a set (in that order) are set aside as long, a linked set must
   occur on one of the short lists left (a shingle of one set alone has no list).  Sets that meet on such a list, and whose sizes
   allow a link, are a pair; a list of more than ``WIDE`` such sets gives a star in place of its pairs.
4. ``linkable``: marks differ in no more bits than the sets in shingles, so pairs whose marks differ in more bits than a link allows
   go.  Without that, chance meetings, which grow with the square of the input, make one family of nearly all sets.  Families are
   the components of the pairs and stars left.
5. ``search``: every family is searched by itself, many small families in a task.  A family beyond ``block_tokens``
   is dealt out as pairs of blocks.  Only counts of links and union-find trees leave a task, never all pairs.

Hashes have 64 bits for shingles and 63 for sets; a wrong result needs two of them to collide.  Merging is a counting merge of
the joined lists in numpy, in place of an element-wise heap.

Defined cases: null or wordless texts have empty sets and link with nothing; a text of fewer than ``width`` words has
one shingle, all its words; null ids take part, and a component's id is its smallest id that is not null; repeated rows are
copies; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, attach, shelter, stored
from .components import components
from .shingles import node_of, sets_of

MAX_LONG = 1 << 20  # lists known as long to every task: 8 MB
LEAST_LONG = 4
BUCKET = 2_000_000  # hashes a counting group holds, about
BLOCK_TOKENS = 1_000_000  # shingles a search block holds, about
SHORT = np.uint64(16)  # lists are told apart by the upper 48 bits of a hash: enough to order and to find candidates
FILTER_BITS = 1 << 25  # 4 MB
ONCE_BITS = 27  # the bit array of shingles has 2^27 bits at most: 16 MB
WIDE = 32  # sets on a list of which all pairs are made
FEW_FAMILY_ROWS = 500_000  # rows of (node, family) that are broadcast, 24 bytes each


def needed(n, percent: int = 80):
    """T: the least intersection of a set of ``n`` shingles with one it links with."""
    return -((-percent * n) // 100)


def _flat(got: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in got], np.int64)
    return sizes, np.concatenate(got) if got else np.zeros(0, np.uint64)


def _batches(batches, text: int, width: int):
    """(batch, sets) in portions, so that a task holds the sets of few documents at a time."""
    for batch in batches:
        yield batch, sets_of(batch.column(text), width)


def marks_of(s: np.ndarray) -> bytes:
    """A bit for each value of the shingles' lowest bits, as many as the set has shingles or up to twice that (64 at least): the parity
    of how many shingles have it."""
    bits = 1 << max(6, (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def doc_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, th, node, n, marks): text hash, name, size and marks of each document's set; node is null for an empty set."""

    def run(batches):
        for batch, sets in _batches(batches, 2, width):
            nodes, sizes, marks = [], [], []
            for s in sets:
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                marks.append(marks_of(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary())], ["doc_id", "th", "node", "n", "marks"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, th long, node long, n long, marks binary")


def _planes(a: np.ndarray) -> bytes:
    """Bytes of like weight together: sorted hashes then compress in the shuffle."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _cuts(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of sorted ``tokens`` (48 bits) begins; buckets are even ranges of hash values."""
    edges = np.array([(i << 48) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(tokens, edges), [len(tokens)]])


def long_lists(docs: DataFrame, total: int, text: str = "text", width: int = 5, max_long: int = MAX_LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]:
    """The shingles with the longest lists, sorted, and how long those are (log2), at most ``max_long``; bits by the upper part of a
    shingle, and how far to shift for them: where a bit is 0, its shingles occur in one set each."""
    buckets = max(1, total // BUCKET)
    shift = 48 - max(16, min(ONCE_BITS, (2 * total).bit_length()))

    def emit(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush():
            tokens = np.sort(np.concatenate(held) >> SHORT)
            cuts = _cuts(tokens, buckets)
            rows = [(i, _planes(tokens[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "tokens"])

        for _, sets in _batches(batches, 0, width):
            for s in sets:
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    held.append(s)
                    size += len(s)
                    if size >= 4_000_000:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    def count(pdf):
        import pandas as pd

        tokens = np.concatenate([_unplanes(x, np.uint64) for x in pdf["tokens"]])
        tokens, n = np.unique(tokens, return_counts=True)
        some = n >= LEAST_LONG
        lists = pd.DataFrame({"token": tokens[some].view(np.int64), "level": np.log2(n[some]).astype(np.int32), "bits": None})
        at = tokens[n > 1].view(np.int64) >> shift
        if not len(at):
            return lists
        first = int(at[0]) >> 3  # the bytes from the first to the last that has a bit
        bits = np.zeros((int(at[-1]) >> 3) - first + 1 << 3, np.uint8)
        bits[at - 8 * first] = 1
        return pd.concat([lists, pd.DataFrame({"token": [first], "level": np.array([-1], np.int32), "bits": [np.packbits(bits, bitorder="little").tobytes()]})])

    blobs = docs.select(F.col(text).alias("text")).mapInArrow(emit, "bucket int, tokens binary")
    counted = stored(blobs.groupBy("bucket").applyInPandas(count, "token long, level int, bits binary"))
    twice = np.zeros(1 << 48 - shift - 3, np.uint8)
    for r in counted.where("level < 0").select("token", "bits").coalesce(8).toLocalIterator():  # a row a bucket, no more bytes than ``twice`` has and one a row
        twice[r["token"] : r["token"] + len(r["bits"])] |= np.frombuffer(r["bits"], np.uint8)
    by_level = sorted(((r["level"], r["n"]) for r in counted.where("level >= 0").groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True)  # at most 64 rows
    level, room = 64, max_long
    for at, n in by_level:
        if n > room:
            break
        level, room = at, room - n

    def pack(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([g[i] for g in got]).astype(k).tobytes()], pa.binary()) for i, k in ((0, np.uint64), (1, np.uint8))], ["t", "l"])

    rows = counted.where(F.col("level") >= level).select("token", "level").coalesce(8).mapInArrow(pack, "t binary, l binary").collect()  # at most max_long entries of 9 bytes
    tokens = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["t"], np.uint64) for r in rows]])
    levels = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(r["l"], np.uint8) for r in rows]])
    order = np.argsort(tokens)
    return tokens[order], levels[order], twice, np.uint64(shift)


def _in_order(s: np.ndarray, tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set's shingles from short lists to long ones; unknown lists are short; equal lengths by hash."""
    if not len(tokens):
        return s
    upper = s >> SHORT
    at = np.minimum(np.searchsorted(tokens, upper), len(tokens) - 1)
    level = np.where(tokens[at] == upper, levels[at], 0)
    return s[np.argsort(level, kind="stable")] if level.any() else s


def _prefix(s: np.ndarray, size: int, known) -> np.ndarray:
    """Those of a set's first ``size`` shingles that occur in other sets as well (or may): shingles of one set come first."""
    tokens, levels, twice, shift = known
    at = (s >> SHORT) >> shift
    more = (twice[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    size -= len(s) - int(more.sum())
    return _in_order(s[more], tokens, levels)[:size] if size > 0 else s[:0]


def _value(x):
    return getattr(x, "value", x)


def meetings(docs: DataFrame, total: int, known, text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(a, b, star) with a > b: sets that meet on a short list, as pairs, or as stars where the list is wide."""
    buckets = max(1, total * (105 - percent) // 100 // (BUCKET // 4))

    def emit(batches):
        order = _value(known)
        seen: set[int] = set()
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flush():
            t = np.concatenate([h[2] for h in held]) >> SHORT
            lens = [len(h[2]) for h in held]
            node, n = np.repeat(np.array([h[0] for h in held], np.int64), lens), np.repeat(np.array([h[1] for h in held], np.int32), lens)
            order = np.argsort(t)
            t, node, n = t[order], node[order], n[order]
            cuts = _cuts(t, buckets)
            rows = [(i, _planes(t[a:b]), _planes(node[a:b]), _planes(n[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2, 3)], ["bucket", "t", "node", "n"])

        for _, sets in _batches(batches, 0, width):
            for s in sets:
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    short = _prefix(s, len(s) - needed(len(s), percent) + 1, order)
                    if len(short):
                        held.append((node, len(s), short))
                        size += len(short)
                    if size >= 1_000_000:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    def meet(pdf):
        import pandas as pd

        t = np.concatenate([_unplanes(x, np.uint64) for x in pdf["t"]])
        node = np.concatenate([_unplanes(x, np.int64) for x in pdf["node"]])
        n = np.concatenate([_unplanes(x, np.int32) for x in pdf["n"]]).astype(np.int64)
        order = np.lexsort((node, n, t))
        t, node, n = t[order], node[order], n[order]
        other = np.append(True, (t[1:] != t[:-1]) | (node[1:] != node[:-1]))[: len(t)]  # copies of a set come from several tasks
        t, node, n = t[other], node[other], n[other]
        # a run: one list, or the part of it within which sizes allow links from one set to the next
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (100 * n[:-1] < percent * n[1:])
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        lens = np.diff(np.append(first, len(t)))
        wide = lens[run] > WIDE
        low = np.minimum.reduceat(node, first)[run] if len(t) else node
        some = wide & (node != low)
        got = [(node[some], low[some], np.ones(int(some.sum()), bool))]
        i = np.flatnonzero(~wide)
        for step in range(1, WIDE):
            i = i[i + step < len(t)]
            i = i[run[i] == run[i + step]]
            if not len(i):
                break
            j = i[100 * n[i] >= percent * n[i + step]]
            got.append((np.maximum(node[j], node[j + step]), np.minimum(node[j], node[j + step]), np.zeros(len(j), bool)))
        a, b, star = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((~star, b, a))
        a, b, star = a[order], b[order], star[order]
        other = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        return pd.DataFrame({"a": a[other], "b": b[other], "star": star[other]})

    blobs = docs.select(F.col(text).alias("text")).mapInArrow(emit, "bucket int, t binary, node binary, n binary")
    return blobs.groupBy("bucket").applyInPandas(meet, "a long, b long, star boolean")


def linkable(pairs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b): the stars of ``pairs``, and those pairs whose marks allow a link.

    Of linked sets with n and m shingles at most (n + m) * (100 - percent) / (100 + percent) shingles are in one only, and
    each of these turns one bit of the marks.  Marks of twice the length are folded.
    """

    def run(batches):
        for batch in batches:
            a, b, star, n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            x, y = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            keep = star.copy()
            sizes = np.array([(len(p), len(q)) for p, q in zip(x, y)], np.int64).reshape(-1, 2)
            for of in np.unique(sizes[~star], axis=0):
                at = np.flatnonzero((sizes == of).all(1) & ~star)
                both = [np.frombuffer(b"".join([z[i] for i in at]), np.uint8).reshape(len(at), -1) for z in (x, y)]
                while both[0].shape[1] != both[1].shape[1]:
                    k = int(both[1].shape[1] > both[0].shape[1])
                    half = both[k].shape[1] // 2
                    both[k] = both[k][:, :half] ^ both[k][:, half:]
                turned = np.bitwise_count(both[0] ^ both[1]).sum(1, dtype=np.int64)
                keep[at] = turned * (100 + percent) <= (n[at] + m[at]) * (100 - percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], ["a", "b"])

    marks = sets.where(F.col("node").isNotNull()).select("node", "n", "marks").dropDuplicates(["node"])
    both = pairs.groupBy("a", "b").agg(F.max("star").alias("star"))
    both = both.join(marks.select(F.col("node").alias("a"), F.col("n").alias("__n"), F.col("marks").alias("__x")), "a")
    both = both.join(marks.select(F.col("node").alias("b"), F.col("n").alias("__m"), F.col("marks").alias("__y")), "b")
    return both.select("a", "b", "star", "__n", "__m", "__x", "__y").mapInArrow(run, "a long, b long")


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def divide_skip(lists: np.ndarray, starts: np.ndarray, mine: np.ndarray, t: int, n_sets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets (positions) that occur on at least ``t`` of the lists ``mine``, with the exact number of occurrences.

    ``lists`` holds all inverted lists, each sorted, list i at ``starts[i]:starts[i + 1]``.
    """
    lens = starts[mine + 1] - starts[mine]
    far = np.zeros(len(mine), bool)
    if t > 1 and len(mine) > 1:
        # long: sixteen times the usual list; at most t - 1 may be set aside
        typical = np.partition(lens, len(lens) // 2)[len(lens) // 2]
        by = np.argsort(-lens, kind="stable")[: t - 1]
        far[by[lens[by] > 16 * typical]] = True
    short, long = mine[~far], mine[far]
    ls = lens[~far]
    at = np.repeat(starts[short] - np.cumsum(ls) + ls, ls) + np.arange(int(ls.sum()))
    merged = lists[at]
    if len(merged) * 4 > n_sets:
        count = np.bincount(merged, minlength=n_sets)
        found = np.flatnonzero(count >= max(1, t - len(long)))
        count = count[found]
    else:
        found, count = np.unique(merged, return_counts=True)
        keep = count >= max(1, t - len(long))
        found, count = found[keep], count[keep]
    left = len(long)
    for i in long:
        one = lists[starts[i] : starts[i + 1]]
        place = np.minimum(np.searchsorted(one, found), len(one) - 1)
        count = count + (one[place] == found)
        left -= 1
        keep = count + left >= t
        found, count = found[keep], count[keep]
    return found, count


def search(tokens: list[np.ndarray], copies: np.ndarray, percent: int = 80, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of one family: for each set the number of documents in sets it links with, and the position of its tree's root.

    ``blocks`` (0 or 1 per set) restricts the search to pairs across the two blocks.
    """
    m = len(tokens)
    order = np.argsort([len(t) for t in tokens], kind="stable")
    sizes = np.array([len(tokens[i]) for i in order], np.int64)
    weight = copies[order]
    side = blocks[order] if blocks is not None else None
    flat = np.concatenate([tokens[i] for i in order])
    owner = np.repeat(np.arange(m), sizes)
    _, token, times = np.unique(flat, return_inverse=True, return_counts=True)
    by = np.argsort(token, kind="stable")  # owners ascend within a list
    lists, starts = owner[by], np.concatenate([[0], np.cumsum(times)])
    ends = np.cumsum(sizes)
    links, forest = np.zeros(m, np.int64), Forest(m)
    for q in range(1, m):
        mine = token[ends[q] - sizes[q] : ends[q]]
        mine = mine[times[mine] > 1]
        t = int(needed(int(sizes[q]), percent))
        if len(mine) < t:
            continue
        found, count = divide_skip(lists, starts, mine, t, m)
        keep = found < q  # every pair once; the partner is no larger
        if side is not None:
            keep &= side[found] != side[q]
        found, count = found[keep], count[keep]
        found = found[100 * count >= percent * (sizes[found] + sizes[q] - count)]
        if len(found):
            links[q] += weight[found].sum()
            links[found] += weight[q]
            for i in found:
                forest.join(int(i), q)
    out, root = np.zeros(m, np.int64), np.zeros(m, np.int64)
    out[order] = links
    root[order] = order[[forest.root(i) for i in range(m)]]
    return out, root


def _member_filter(nodes: DataFrame) -> np.ndarray:
    """Bit i says that some node is i modulo FILTER_BITS; a fixed 4 MB whatever the number of nodes."""

    def run(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy() & (FILTER_BITS - 1)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in nodes.select("node").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():  # eight rows at most
        bits |= np.frombuffer(row["bits"], np.uint8)
    return bits


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, block_tokens: int = BLOCK_TOKENS, max_long: int = MAX_LONG) -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id, th, root), one row per document.

    n_links counts the other documents that link with it, copies included; th is the hash of its text, and root
    names the component (null for an empty set).
    """
    spark = docs.sparkSession
    marked = stored(doc_sets(docs, key, text, width))
    sets = marked.drop("marks")
    total = int(sets.agg(F.sum("n")).first()[0] or 0)
    known = long_lists(docs, total, text, width, max_long)
    shared = spark.sparkContext.broadcast(known)  # at most max_long entries, and 2^ONCE_BITS bits
    families = components(linkable(meetings(docs, total, shared, text, width, percent), marked, percent))
    nodes = sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.min("doc_id").alias("rep"))
    family = stored(families.select("node", F.col("root").alias("family")).join(nodes, "node"))

    # families share tasks, and a large one is cut into blocks
    per = family.groupBy("family").agg(F.sum("n").alias("size"))
    in_families = int(per.agg(F.sum("size")).first()[0] or 0)
    tasks = max(1, -(-in_families // block_tokens))
    cut = per.select("family", F.when(F.col("size") > 2 * block_tokens, F.ceil(F.col("size") / block_tokens)).otherwise(1).cast("int").alias("blocks"))
    placed = family.join(cut, "family")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(tasks))).otherwise(tasks + F.pmod(F.xxhash64("family", low, high), F.lit(2**40)))
    placed = stored(placed.select("node", "family", "copies", F.col("rep").alias("__rep"), task.alias("task"), low.alias("low"), high.alias("high"), "mine"))

    wanted = spark.sparkContext.broadcast(_member_filter(placed))

    def emit(batches):
        bits = _value(wanted)
        for batch, got in _batches(batches, 1, width):
            rows = [(d, node, s.tobytes()) for d, s in zip(batch.column(0).to_pylist(), got) if len(s) and (node := node_of(s)) >= 0 and bits[(node & (FILTER_BITS - 1)) >> 3] >> (node & 7) & 1]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["__doc", "node", "tokens"])

    emitted = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(emit, "__doc long, node long, tokens binary")
    side = F.broadcast(placed) if placed.count() <= FEW_FAMILY_ROWS else placed
    work = emitted.join(side, "node").where(F.col("__doc").eqNullSafe(F.col("__rep"))).drop("__doc", "__rep")

    def find(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates(["node", "mine"])
        out = []
        for (_, a, b), g in pdf.groupby(["family", "low", "high"], sort=False):
            ids, copies = g["node"].to_numpy(np.int64), g["copies"].to_numpy(np.int64)
            if len(ids) > 1:
                links, root = search([np.frombuffer(x, np.uint64) for x in g["tokens"]], copies, percent, (g["mine"] == a).to_numpy() if a != b else None)
                some = links > 0
                out.append(pd.DataFrame({"node": ids[some], "links": links[some], "root": ids[root][some]}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "links": [], "root": []})

    found = stored(work.groupBy("task").applyInPandas(find, "node long, links long, root long"))
    tree = stored(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    per_node = stored(found.groupBy("node").agg(F.sum("links").alias("links")).join(tree, "node").join(nodes.select("node", "copies"), "node"))
    out = attach(sets, per_node.select("node", "links", "root"), ["node"], "left", F.xxhash64("doc_id"))
    out = out.withColumn("root", F.coalesce("root", "node"))
    ids = stored(out.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("__many")).where("__many > 1"))
    out = attach(out, ids.drop("__many"), ["root"], "left", F.xxhash64("doc_id"))
    own = attach(out, stored(nodes.where("copies > 1").select("node", "copies")), ["node"], "left", F.xxhash64("doc_id"))
    n_links = F.when(F.col("node").isNull(), 0).otherwise(F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long")
    return own.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), n_links.alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"), "th", "root")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` of which one for each component stays (the smallest id); rows without words all stay."""
    found = linked(docs, key, text, **options).where(F.col("root").isNotNull())
    name = lambda i, h: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), h)
    stay = found.groupBy("root").agg(F.min(F.struct(F.col(key).alias("i"), "th")).alias("k")).select(name(F.col("k.i"), F.col("k.th")).alias("__name")).distinct()
    work, back = shelter(docs, key, text)
    named = work.where(F.col(text).rlike(WORD_CLASS)).withColumn("__name", name(F.col(key).cast("long"), F.xxhash64(text)))
    kept = named.join(stay, "__name", "left_semi").dropDuplicates(["__name"]).drop("__name")  # equal rows are copies, too
    return back(kept.unionByName(work.where(~F.coalesce(F.col(text).rlike(WORD_CLASS), F.lit(False)))))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document with the size of its set, its number of links and its component."""
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("th", "root")
