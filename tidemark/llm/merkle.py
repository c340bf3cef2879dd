"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; the leaves of one group (a language) ascend by key and form a binary tree: as long as a level has several
nodes, each two neighbours (the last one alone, if their number is odd) become the digest of their digests in hex, one after the
other.  The roots of the groups, in order of the group (null first, by bytes), form a tree in the same way, whose root stands for
the whole dataset.  A proof of a leaf lists, level by level up to that root, the other node of its pair and its side.

A tree is evaluated time-forward: a node is labelled (level, place), and a priority queue ordered by label holds the messages that
children send to their parent.  The least label is always ready: all its messages lie at the front of the queue.  The reversed sweep
takes labels from the root down; a node receives the tail of the proof above it and sends each child that tail with the child's
sibling put in front, until the tails reach the leaves.

The queue is external: a tree is cut into aligned blocks of 2 ** BITS leaves.  Inside a block the queue is a heap in one task, which
never holds more than one block; what passes between blocks (block roots upwards, tails downwards) goes through Spark's sorted
shuffle, which spills, one job per BITS levels.  A group with a third or all of the rows is thus many blocks on many tasks.  Places
of leaves come from a range sort.  All layers are stored in the shared folder, so a lost executor costs one layer at most.  Only the
size of the largest tree and the dataset's root reach the driver.

Defined cases: a null field counts as ``-`` and differs from an empty one; a null group is a group, the first; a null key comes
first; rows of equal keys are separate leaves, in order of their digests; very long texts are digested where they lie and never
moved; an empty table gives no rows.  Columns in ``keep`` pass through; those named like a result column are left out.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, stored
from .ordering import place

BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULTS = ("leaf", "place", "subroot", "root", "proof")
STEPS = "array<struct<side: string, digest: string>>"
_ARROW_STEPS = pa.list_(pa.struct([("side", pa.string()), ("digest", pa.string())]))


def leaf_digest(*fields: Column) -> Column:
    """Digest of one row: each field is ``-`` if null, else its number of UTF-8 bytes, a colon and its value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    pair = lambda d, s: F.when(s["side"] == "left", F.concat(s["digest"], d)).when(s["side"] == "right", F.concat(d, s["digest"])).otherwise(d)
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(pair(d, s), 256))


def _digest(parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def levels(total: int, bits: int) -> int:
    """Levels that a block of a tree of ``total`` leaves has above its leaves: all ``bits``, or in a last block as many as leave one node."""
    return min(bits, (total - 1).bit_length())


def sweep_up(digests: list[str], first: int, top: int) -> dict[tuple[int, int], str]:
    """Digest of each node of a block by label; ``first`` is the place of its first leaf."""
    queue = [(0, first + i, 0, d) for i, d in enumerate(digests)]  # a message: label of the node it goes to, sender, digest
    heapify(queue)
    node: dict[tuple[int, int], str] = {}
    while queue:
        level, at = queue[0][:2]
        got = []
        while queue and queue[0][:2] == (level, at):
            got.append(heappop(queue)[3])
        own = got[0] if level == 0 else _digest(got)
        node[level, at] = own
        if level < top:
            heappush(queue, (level + 1, at // 2, at, own))
    return node


def sweep_down(node: dict[tuple[int, int], str], first: int, top: int, tail: tuple) -> list[tuple]:
    """Proof steps of each leaf of a block, whose root has the steps ``tail`` above it."""
    queue = [(-top, -(first >> top), tail)]
    proofs = []
    while queue:
        level, at, own = heappop(queue)
        level, at = -level, -at
        if level == 0:
            proofs.append(own)
            continue
        for child in (2 * at, 2 * at + 1):
            if (level - 1, child) in node:
                other = node.get((level - 1, child ^ 1))
                step = (None, None) if other is None else ("left" if child & 1 else "right", other)
                heappush(queue, (1 - level, -child, (step, *own)))
    return proofs[::-1]  # leaves come out from the last to the first


def _block(table: pa.Table, bits: int):
    table = table.sort_by("__place")
    first = table.column("__place")[0].as_py()
    top = levels(table.column("__total")[0].as_py(), bits)
    return table, first, top, sweep_up(table.column("__digest").to_pylist(), first, top)


def _in_blocks(nodes: DataFrame, bits: int) -> DataFrame:
    return nodes.withColumn("__block", F.shiftright("__place", bits))


def _layer_up(nodes: DataFrame, bits: int) -> DataFrame:
    """The block roots of a layer, as the nodes of the next one."""

    def work(key, table):
        _, first, top, node = _block(table, bits)
        total = table.column("__total")[0].as_py()
        return pa.table({"__tree": [key[0].as_py()], "__place": [key[1].as_py()], "__digest": [node[top, first >> top]], "__total": [-(-total >> bits)]})

    narrow = _in_blocks(nodes.select("__tree", "__place", "__digest", "__total"), bits)
    return narrow.groupBy("__tree", "__block").applyInArrow(work, "__tree long, __place long, __digest string, __total long")


def _layer_down(nodes: DataFrame, tails: DataFrame, bits: int, keep: list[str]) -> DataFrame:
    """``__tree``, ``__place``, ``keep`` and the proof of each node of a layer, from the proofs of its block roots."""

    def work(key, left, right):
        table, first, top, node = _block(left, bits)
        tail = tuple((s["side"], s["digest"]) for s in right.column("__proof")[0].as_py())
        steps = sweep_down(node, first, top, tail)
        proof = pa.array([[{"side": a, "digest": b} for a, b in s] for s in steps], _ARROW_STEPS)
        return table.select(["__tree", "__place", *keep]).append_column("__proof", proof)

    left = _in_blocks(nodes, bits).groupBy("__tree", "__block")
    right = tails.withColumnRenamed("__place", "__block").groupBy("__tree", "__block")
    schema = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in ["__tree", "__place", *keep])
    return left.cogroup(right).applyInArrow(work, f"{schema}, __proof {STEPS}")


def grow(nodes: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """Layers of the trees in ``nodes`` (__tree, __place, __digest, __total, ...): the nodes, their block roots, and so on to the roots."""
    layers = [nodes]
    most = nodes.agg(F.max("__total")).first()[0] or 0
    while most > 1:
        layers.append(stored(_layer_up(layers[-1], bits)))
        most = -(-most >> bits)
    return layers


def prove(layers: list[DataFrame], tails: DataFrame, bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """__tree, __place, ``keep`` and __proof of each node of the first layer; ``tails`` has the steps above each tree's root."""
    keep = keep or []
    for layer in layers[-2:0:-1]:
        tails = stored(_layer_down(layer, tails, bits, []))
    if len(layers) > 1:
        return _layer_down(layers[0], tails, bits, keep)
    return layers[0].select("__tree", "__place", *keep).join(tails, ["__tree", "__place"])


def manifest(docs: DataFrame, fields=FIELDS, key: str = "doc_id", group: str = "lang", keep: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """One row per leaf: key, group, ``keep``, leaf, place, subroot, root and proof (side and digest per level; both null for a lone node)."""
    keep = [c for c in keep or [] if c not in (key, group, *RESULTS)]
    named = [key, group, *keep]
    columns = [F.col(c).alias(f"__c{i}") for i, c in enumerate(named)]  # working names, whatever the columns are called
    leaves = docs.select(*columns, leaf_digest(*[F.col(f) for f in fields]).alias("__digest"))
    leaves = place(leaves, ["__c0", "__digest"], ["__c1"])
    totals = leaves.groupBy("__c1").agg(F.count("*").alias("__total"))
    groups = stored(place(totals, ["__c1"], name="__tree"))
    nodes = stored(attach(leaves, groups, ["__c1"]))
    layers = grow(nodes, bits)

    # the roots of the groups are the leaves of one more tree
    n_groups = groups.count()
    tops = layers[-1].select(F.lit(0).cast("long").alias("__tree"), F.col("__tree").alias("__place"), "__digest", F.lit(n_groups).cast("long").alias("__total"))
    tops = stored(tops)
    top_layers = grow(tops, bits)
    root = top_layers[-1].select("__digest").first()
    none = F.array().cast(STEPS)
    top_tails = top_layers[-1].select("__tree", "__place", none.alias("__proof"))
    tails = prove(top_layers, top_tails, bits).select(F.col("__place").alias("__tree"), F.lit(0).cast("long").alias("__place"), "__proof")
    payload = [f"__c{i}" for i in range(len(named))]
    out = prove(layers, stored(tails), bits, [*payload, "__digest"])
    subroots = stored(tops.select(F.col("__place").alias("__tree"), F.col("__digest").alias("__subroot")))
    out = attach(out, subroots, ["__tree"])
    return out.select(
        *[F.col(p).alias(c) for p, c in zip(payload, named)],
        F.col("__digest").alias("leaf"),
        F.col("__place").alias("place"),
        F.col("__subroot").alias("subroot"),
        F.lit(root[0] if root else None).cast("string").alias("root"),
        F.col("__proof").alias("proof"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op12: leaf, roots and digest of the proof of every document, and what the proof says of a tampered one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = [F.when(tampered, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in FIELDS]
    out = manifest(docs.withColumn("seen_leaf", leaf_digest(*changed)), keep=["seen_leaf"])
    fold = folded(F.col("seen_leaf"), F.col("proof"))
    out = out.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(F.transform("proof", lambda s: s["digest"]), ""), 256).alias("proof_sha256"),
        fold.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle() -> str:
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')".format
    leaf = " || ".join(field(f) for f in FIELDS)
    seen = " || ".join(field("seen_chars" if f == "n_chars" else f) for f in FIELDS)
    return f"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN xor(list_reduce(
      list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT),
      lambda crc, byte: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, byte)),
      4294967295::BIGINT), 4294967295::BIGINT) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS seen_chars
  FROM documents),
leaf AS (
  SELECT doc_id, lang, sha256({leaf}) AS leaf, sha256({seen}) AS seen_leaf FROM d),
up AS (
  SELECT lang, 0 AS lvl, (row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1)::BIGINT AS i, leaf AS dig,
         count(*) OVER (PARTITION BY lang) AS n
  FROM leaf
  UNION ALL
  SELECT lang, lvl + 1, i // 2, sha256(string_agg(dig, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, lvl, i // 2),
sub AS (SELECT lang, dig AS subroot, lvl AS height FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, (row_number() OVER (ORDER BY lang NULLS FIRST) - 1)::BIGINT AS i, subroot AS dig, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(dig, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, i // 2),
root AS (SELECT dig AS root, lvl AS top_height FROM top WHERE n = 1),
p AS (
  SELECT doc_id, lang, leaf, seen_leaf, (row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1)::BIGINT AS i FROM leaf),
s AS (
  SELECT p.*, sub.subroot, sub.height, root.root, root.top_height, r.g
  FROM p JOIN sub ON p.lang IS NOT DISTINCT FROM sub.lang
  JOIN (SELECT lang, (row_number() OVER (ORDER BY lang NULLS FIRST) - 1)::BIGINT AS g FROM sub) r ON p.lang IS NOT DISTINCT FROM r.lang, root),
steps AS (
  SELECT s.doc_id, s.lang, s.i, l.lvl, (s.i >> l.lvl) & 1 AS odd, up.dig
  FROM s JOIN (SELECT unnest(range(64)) AS lvl) l ON l.lvl < s.height
  LEFT JOIN up ON up.lang IS NOT DISTINCT FROM s.lang AND up.lvl = l.lvl AND up.i = xor(s.i >> l.lvl, 1)
  UNION ALL
  SELECT s.doc_id, s.lang, s.i, 64 + l.lvl, (s.g >> l.lvl) & 1, top.dig
  FROM s JOIN (SELECT unnest(range(64)) AS lvl) l ON l.lvl < s.top_height
  LEFT JOIN top ON top.lvl = l.lvl AND top.i = xor(s.g >> l.lvl, 1)),
proof AS (
  SELECT lang, i, string_agg(dig, '' ORDER BY lvl) AS digests,
         list(CASE WHEN dig IS NULL THEN '-' WHEN odd = 1 THEN 'L' || dig ELSE 'R' || dig END ORDER BY lvl) AS path
  FROM steps GROUP BY lang, i),
f AS (
  SELECT s.doc_id, s.leaf, s.subroot, s.root, sha256(coalesce(digests, '')) AS proof_sha256,
         list_reduce(coalesce(path, []), lambda c, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || c WHEN x[1] = 'R' THEN c || x[2:] ELSE c END), s.seen_leaf) AS folded_root
  FROM s LEFT JOIN proof ON s.lang IS NOT DISTINCT FROM proof.lang AND s.i = proof.i)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f"""
