import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import jaccard_join as J
from tidemark.llm.shingles import sets_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < width else frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), links[i], low.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


@pytest.fixture(scope="module")
def rows(prose):
    rnd = random.Random(5)
    passage = prose(60, 99)
    out = [(i, prose(rnd.randint(20, 200), i)) for i in range(40)]
    out += [(100 + i, prose(rnd.randint(20, 40), 200 + i) + " " + passage) for i in range(40)]  # one passage in many documents
    for k in range(4):  # chains and groups of near copies
        words = prose(150, 300 + k).split()
        for i in range(12):
            words = list(words) if i % 3 else prose(150, 300 + k).split()
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = "changed" + str(rnd.randrange(10**6))
            out.append((200 + 20 * k + i, " ".join(words)))
    out += [(400 + i, out[3][1].upper()) for i in range(5)]  # copies in other case
    out += [(500, None), (501, ""), (502, " \n\t"), (503, "one two"), (504, "One\ttwo"), (505, "one two three four five"), (506, "w " * 100_000), (None, out[3][1]), (None, prose(30, 7777))]
    out += [(4, out[4][1]), (4, out[4][1])]  # repeated rows
    rnd.shuffle(out)
    return out


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "n_links", "component_id").collect())


def test_join_equals_brute_force(make_docs, rows):
    assert got(J.linked(make_docs(rows))) == brute(rows)


def test_join_in_blocks_with_few_known_long_lists(make_docs, rows, monkeypatch):
    monkeypatch.setattr(J, "BUCKET", 2_000)
    monkeypatch.setattr(J, "FEW_FAMILY_ROWS", -1)
    assert got(J.linked(make_docs(rows), block_tokens=400, max_long=20)) == brute(rows)


def test_join_with_wide_lists_and_a_full_bit_array(make_docs, rows, monkeypatch):
    monkeypatch.setattr(J, "WIDE", 2)
    monkeypatch.setattr(J, "_prefix", lambda s, size, known: J._in_order(s, *known[:2])[:size])  # as if every bit were set
    assert got(J.linked(make_docs(rows))) == brute(rows)


def test_chance_meetings_make_no_family(make_docs, prose, monkeypatch):
    """Texts that share half of their shingles with the next one link with none, so none of them is searched."""
    edges = []
    components = J.components
    monkeypatch.setattr(J, "components", lambda e: (edges.append(e.count()), components(e))[1])
    parts = [prose(60, 9_000 + i) for i in range(41)]
    chain = [(i, parts[i] + " " + parts[i + 1]) for i in range(40)]
    near = [(100 + i, parts[0] + " one more " * i + parts[40]) for i in range(2)]
    assert got(J.linked(make_docs(chain + near))) == brute(chain + near)
    assert edges[0] == 1


def test_marks_differ_in_no_more_bits_than_sets_in_shingles():
    rnd = np.random.RandomState(3)
    for n, m, common in ((1, 1, 0), (64, 65, 60), (120, 140, 110), (500, 520, 30), (1000, 1030, 1000)):
        a = np.unique(rnd.randint(0, 2**62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[:common], rnd.randint(0, 2**62, m - common).astype(np.uint64)]))
        x, y = (np.frombuffer(J.marks_of(s), np.uint8) for s in (a, b))
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert len(x) * 8 >= min(len(a), 64) and np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_one_of_each_group_stays(make_docs, rows):
    docs = make_docs(rows)
    out = J.one_of_each(docs)
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    filled = [r for r in kept if shingles(r[1])]
    assert len([r for r in kept if not shingles(r[1])]) == 3
    found = J.linked(docs).collect()
    assert len(filled) == len({r["root"] for r in found if r["root"] is not None})


def test_divide_skip_counts_exactly_with_and_without_long_lists():
    rnd = np.random.RandomState(1)
    for _ in range(50):
        n = rnd.randint(2, 300)
        lens = np.where(rnd.rand(40) < 0.2, rnd.randint(1, n + 1, 40), rnd.randint(1, 3, 40))
        parts = [np.sort(rnd.choice(n, min(k, n), replace=False)) for k in lens]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        mine = np.sort(rnd.choice(40, 25, replace=False))
        t = rnd.randint(1, 8)
        count = np.bincount(np.concatenate([parts[i] for i in mine]), minlength=n)
        found, c = J.divide_skip(np.concatenate(parts), starts, mine, t, n)
        assert list(found) == list(np.flatnonzero(count >= t)) and list(c) == list(count[count >= t])


def test_sets_of_long_and_odd_texts(monkeypatch):
    import pyarrow as pa

    from tidemark.llm import shingles as S

    texts = [None, "", " ", "A b", "a b c d e", "a b c d e f " * 3, "é  x\tY\x0bz\x0cq r", "x" * 5_000 + " a b c d e", "foo bar baz qux " * 500]
    want = [len(shingles(t)) for t in texts]
    assert [len(s) for s in sets_of(pa.array(texts))] == want
    monkeypatch.setattr(S, "SLICE", 64)
    assert [len(s) for s in sets_of(pa.array(texts))] == want


def test_empty(make_docs):
    assert J.linked(make_docs([])).count() == 0
