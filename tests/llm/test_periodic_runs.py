import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodic_runs as P

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Every maximal stretch of each period, kept where no smaller period holds."""
    out, n = [], len(words)
    for q in range(1, n // P.MIN_EXPONENT + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            smaller = any(all(own[x] == own[x + p] for x in range(len(own) - p)) for p in range(1, q))
            if len(own) >= max(P.MIN_WORDS, P.MIN_EXPONENT * q) and not smaller:
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_after_planting(key, text):
    words = WORDS.findall(text or "")
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def found(docs):
    flat = [w for d in docs for w in d]
    starts = np.cumsum([0, *map(len, docs)])
    got = P.find_runs(np.array(flat, np.int64), starts)
    out = [[] for _ in docs]
    for s, n, q in got.tolist():
        i = int(np.searchsorted(starts, s, side="right")) - 1
        out[i].append((s - int(starts[i]), n, q))
    return out


def test_bands_leave_no_period_out():
    for n in (5, 6, 24, 1000, 100_000):
        want = range(1, n // P.MIN_EXPONENT + 1) if n >= P.MIN_WORDS else []
        got = list(P.bands(n))
        assert all(any(low <= q <= k for low, k in got) for q in want)
        for low, k in got:  # the seed fits into the least overlap of each period of the band, and holds a whole period
            assert all(k <= max(P.MIN_WORDS, P.MIN_EXPONENT * q) - q for q in range(low, k + 1))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_random_words_equal_brute_force(docs):
    assert found(docs) == [brute(d) for d in docs]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 9), min_size=1, max_size=25), st.integers(1, 7), st.integers(0, 12)), max_size=5))
def test_planted_repeats_equal_brute_force(parts):
    doc = []
    for unit, times, cut in parts:
        doc += (unit * times)[: max(1, len(unit) * times - cut)] + [99]
    assert found([doc, doc[::-1], doc[1:]]) == [brute(doc), brute(doc[::-1]), brute(doc[1:])]


def test_extreme_texts():
    one = [0] * 50_000
    fib = [0]
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert found([one]) == [[(0, 50_000, 1)]]
    assert found([b]) == [brute(b)] and found([fib]) == [[]]
    rnd = random.Random(3)
    unit = [rnd.randrange(10**6) for _ in range(4_000)]
    assert found([[-1, *unit * 4, -2], unit]) == [[(1, 16_000, 4_000)], []]


def rows_of(prose):
    rows = [(i, prose(1 + 37 * i % 160, i), "en", "a") for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "x " * 700), (204, "é " * 9 + "  \x1c a b a b a b a b a b"), (205, "one"), (None, "a b " * 20), (5, rows[5][1]), (5, "c d e " * 30)]
    return rows + [(206, "a b c d e f X a b c d e f Y " * 12), (207, ("k " * 6 + "z ") * 9)]


def test_rows_equal_brute_force(make_docs, prose):
    rows = rows_of(prose)
    docs = make_docs(rows)
    out = P.periodic_runs(P.planted(docs)).collect()
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"], r["size"], r["kept"]) for r in out), key=str)
    want = []
    for key, text, *_ in rows:
        words = words_after_planting(key, text)
        runs = brute(words)
        want.append((key, runs, collapsed(words, runs), 7, "k"))
    assert got == sorted(want, key=str)
    assert sum(bool(r[1]) for r in want) > 10


def test_query_digests(spark, make_docs, prose, tmp_path):
    rows = rows_of(prose)
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["collapsed_sha256"]): r for r in P.query(spark, str(tmp_path)).collect()}
    for key, text, *_ in rows:
        words = words_after_planting(key, text)
        runs = brute(words)
        r = got[key, hashlib.sha256(collapsed(words, runs).encode()).hexdigest()]
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        if runs:
            s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (s, n, q, 1000 * n // q)
        else:
            assert r["start"] is r["length"] is r["period"] is r["exponent_milli"] is None


@pytest.mark.parametrize("extra", [("runs", "collapsed")])
def test_empty_and_clashing_columns(spark, make_docs, extra):
    assert P.periodic_runs(P.planted(make_docs([]))).count() == 0
    df = spark.createDataFrame([(1, "a a a a a a a", "old", "old", 3)], f"doc_id long, text string, {extra[0]} string, {extra[1]} string, start long")
    r = P.periodic_runs(df).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 7, 1)] and r["collapsed"] == "a" and r["start"] == 3
