import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprints as P

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return set()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def print_of(text):
    hashes = sorted({hashlib.md5(s.encode()).hexdigest()[:12] for s in shingles(text)})
    if len(hashes) <= 64:
        return "all:" + "".join(hashes)
    bound = max("100000000000", hashes[64])
    return bound + ":" + "".join(h for h in hashes if h < bound)


def parsed(fp):
    bound, joined = fp.split(":")
    return "g" if bound == "all" else bound, {joined[i : i + 12] for i in range(0, len(joined), 12)}


def below(a, b):
    (s, x), (t, y) = parsed(a), parsed(b)
    return {h for h in x if h < min(s, t)}, {h for h in y if h < min(s, t)}


def like(a, b):
    x, y = below(a, b)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows):
    texts = {}
    for k, t in rows:
        texts.setdefault(k, []).append(t or "")
    keys = sorted(texts, key=lambda k: (k is not None, k or 0))
    nxt = {k: min(texts[n], key=str.encode) for k, n in zip(keys, keys[1:] + keys[:1])}
    out = []
    for k, t in rows:
        t = t or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[k][:cut]
        a, b, c = print_of(t), print_of(edited), print_of(nxt[k])
        out.append((k, len(t), edited, a, b, c, like(a, b), like(a, c)))
    return sorted(out, key=str)


def rows_of(prose):
    rows = [(i * 2, prose(1 + i * 13 % 200, i)) for i in range(60)]
    return rows + [(500, None), (501, ""), (502, " \t "), (503, prose(3000, 1)), (504, prose(3000, 1)), (505, "É UN deux " * 30), (None, "no key at all here"), (4, rows[2][1]), (4, "other text of a repeated key " * 3), (506, "w")]


def test_rows_equal_brute_force(make_docs, prose):
    rows = rows_of(prose)
    out = P.with_neighbours(make_docs(rows), keep=["size", "n_chars", "root"])
    assert out.columns == ["doc_id", "size", "root", "text", "n_chars", "edited", "fingerprint", "edited_fingerprint", "next_fingerprint", "near_edited", "near_next"]
    got = [(r["doc_id"], r["n_chars"], r["edited"], r["fingerprint"], r["edited_fingerprint"], r["next_fingerprint"], r["near_edited"], r["near_next"]) for r in out.collect()]
    assert sorted(got, key=str) == brute(rows)


def test_estimates_lie_near_the_true_shares(spark, prose):
    """Resemblance and containment, also of documents whose lengths differ fifty-fold."""
    rnd = random.Random(4)
    pairs = []
    for i in range(80):
        base = prose(rnd.choice([300, 1500, 6000]), 1000 + i).split()
        start = rnd.randrange(len(base) // 2)
        part = base[start : start + rnd.choice([len(base) // 50 + 40, len(base) // 2])]
        other = part + prose(rnd.choice([0, 50, 400]), 5000 + i).split()
        pairs.append((" ".join(base), " ".join(other)))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", P.fingerprint(F.col("a")).alias("fa"), P.fingerprint(F.col("b")).alias("fb"))
    rows = df.select("a", "b", P.likeness(F.col("fa"), F.col("fb")).alias("like"), P.containment(F.col("fb"), F.col("fa")).alias("inside")).collect()
    off, off_inside = [], []
    for r in rows:
        a, b = shingles(r["a"]), shingles(r["b"])
        off.append(r["like"] - len(a & b) / len(a | b))
        off_inside.append(r["inside"] - len(a & b) / len(b))
    assert max(map(abs, off)) < 0.25 and abs(sum(off) / len(off)) < 0.02
    assert abs(sum(off_inside) / len(off_inside)) < 0.05 and sum(x * x for x in off_inside) / len(off_inside) < 0.03


def test_a_merge_is_the_fingerprint_of_the_union(spark, prose):
    groups = {"x": [prose(400, 1), prose(30, 2), ""], "y": [prose(5, 3)], None: [prose(3000, 4), prose(3000, 5)], "z": [""]}
    rows = [(g, t) for g, texts in groups.items() for t in texts]
    df = spark.createDataFrame(rows, "g string, t string").select("g", P.fingerprint(F.col("t")).alias("fingerprint"))
    got = {}
    for r in P.merged(df, ["g"]).collect():
        got.setdefault((r["g"], r["bound"]), set()).update([r["hash"]] if r["hash"] else [])
    want = {}
    for g, texts in groups.items():
        bound = min(parsed(print_of(t))[0] for t in texts)
        hashes = {hashlib.md5(s.encode()).hexdigest()[:12] for t in texts for s in shingles(t)}
        want[g, bound] = {h for h in hashes if h < bound}
    assert got == want


def test_fraction_holds_for_long_texts(spark, prose):
    text = " ".join(str(i) for i in range(200_000))
    fp = spark.createDataFrame([(text,)], "t string").select(P.fingerprint(F.col("t"))).first()[0]
    bound, hashes = parsed(fp)
    assert bound == P.CEILING and abs(len(hashes) - 200_000 / 16) < 500 and fp == print_of(text)


@pytest.mark.parametrize("n", [0, 1])
def test_empty_and_single(make_docs, n):
    rows = P.with_neighbours(make_docs([(3, "a b c d e f g h")][:n])).collect()
    assert len(rows) == n
    for r in rows:
        assert r["edited"] == "a b c d e f " + "a b"
        assert r["near_next"] == 1.0
