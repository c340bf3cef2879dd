import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import merkle as M
from tidemark.llm.ordering import place


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(digests):
    """Root and, per leaf, the (side, sibling) of each level, by plain recursion."""
    proofs, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for leaf, i in enumerate(at):
            j = i ^ 1
            proofs[leaf].append(("left" if i & 1 else "right", level[j]) if j < len(level) else (None, None))
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], proofs


def fold(leaf, proof):
    for side, other in proof:
        leaf = h(other, leaf) if side == "left" else h(leaf, other) if side == "right" else h(leaf)
    return leaf


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> (doc_id, leaf) -> (subroot, root, proof)"""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in order:
        own = sorted(((r[0], leaf_of(r)) for r in groups[g]), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs[g] = (own, *tree([x[1] for x in own]))
    root, tops = tree([subs[g][1] for g in order])
    out = []
    for g, top in zip(order, tops):
        own, sub, proofs = subs[g]
        out += [(k, leaf, i, sub, root, proofs[i] + top) for i, (k, leaf) in enumerate(own)]
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(1, 4))
def test_blocks_and_sweeps_equal_one_tree(total, bits):
    """The heap sweeps, block by block and layer by layer, give the tree that recursion gives."""
    layers = [[h(str(i)) for i in range(total)]]
    blocks = []
    while len(layers[-1]) > 1:
        layer, nxt, own = layers[-1], [], []
        for first in range(0, len(layer), 1 << bits):
            top = M.levels(len(layer), bits)
            node = M.sweep_up(layer[first : first + (1 << bits)], first, top)
            own.append((node, first, top))
            nxt.append(node[top, first >> top])
        blocks.append(own)
        layers.append(nxt)
    tails = [()]
    for own in blocks[::-1]:
        tails = [p for (node, first, top), tail in zip(own, tails) for p in M.sweep_down(node, first, top, tail)]
    root, proofs = tree(layers[0])
    assert layers[-1] == [root] and [list(t) for t in tails] == proofs


def rows_of(prose):
    langs = ["en"] * 5 + ["de", None, "", "fr", "é"]
    rows = [(i * 3, prose(1 + i % 9, i), langs[i % 10], ["a", None, "b"][i % 3]) for i in range(140)]
    rows += [(1, None, "only", None), (None, "x", "en", "a"), (None, "y", None, None), (6, rows[2][1], "en", "b"), (6, rows[2][1], "en", "b"), (700, "é" * 5000, "de", "é")]
    return rows + [rows[4]]


@pytest.mark.parametrize("bits", [2, 10])
def test_manifest_equals_brute_force(make_docs, prose, bits):
    docs = make_docs(rows_of(prose))
    plain = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = M.manifest(docs, keep=["size", "root", "node"], bits=bits)
    assert got.columns == ["doc_id", "lang", "size", "node", "leaf", "place", "subroot", "root", "proof"]
    got = sorted(((r["doc_id"], r["leaf"], r["place"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in got.collect()), key=str)
    assert got == brute(plain)


def test_query_verifies_all_but_tampered_rows(spark, make_docs, prose, tmp_path):
    docs = make_docs(rows_of(prose))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plain = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = {}
    for r in plain:
        seen = (*r[:3], r[3] + 1, r[4]) if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else r
        want.setdefault((r[0], leaf_of(r)), leaf_of(seen))
    rows = M.query(spark, str(tmp_path)).collect()
    proofs = {}
    for k, leaf, _, sub, root, proof in brute(plain):
        proofs.setdefault((k, leaf), []).append((sub, root, h(*(d for _, d in proof if d)), fold(want[k, leaf], proof)))
    got = {}
    for r in rows:
        got.setdefault((r["doc_id"], r["leaf"]), []).append((r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]))
        assert r["verified"] == (want[r["doc_id"], r["leaf"]] == r["leaf"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in proofs.items()}
    assert 0 < sum(not r["verified"] for r in rows) < len(rows) / 2


def test_a_changed_field_changes_the_leaf(spark):
    rows = [(None, "", "1:a", "-"), (None, None, "1:a", "-"), ("", None, "1:a", "-"), ("1", ":a", "1:", "a"), ("11", "a", "1:", "a")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    assert df.select(M.leaf_digest(*[F.col(c) for c in "abcd"]).alias("x")).distinct().count() == len(rows)


def test_empty_and_single(make_docs):
    assert M.manifest(make_docs([])).count() == 0
    r = M.manifest(make_docs([(5, "only one", "en", "a")])).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof"] == []


def test_place_numbers_groups_over_many_ranges(spark):
    df = spark.range(5000).selectExpr("id % 3 AS g", "hash(id) AS v", "id")
    got = {}
    for r in place(df, ["v", "id"], ["g"]).collect():
        got.setdefault(r["g"], []).append((r["__place"], r["v"], r["id"]))
    for rows in got.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows))) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
