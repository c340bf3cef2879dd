import math
import re
from collections import Counter

import pytest

from tidemark.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


ODD = [None, "", "   \n\t ", "a", "a a", "a a a a", "a b c a b c", "x\ny\nx\n\nx ", "é#*é <b>|&$%\x0bq\x0cr", "one two three four " * 30_000, "\n".join(["same line here"] * 50)]


def test_measures_equal_brute_force(make_docs, prose):
    texts = ODD + [prose(n, n) for n in (3, 49, 50, 400)] + [prose(30, 1) + " " + prose(30, 1)]
    rows = Q.measure(make_docs([(i, t) for i, t in enumerate(texts)])).collect()
    for r in rows:
        assert tuple(r[c] for c in Q.BASE) == brute(texts[r["doc_id"]]), r["doc_id"]


def tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


@pytest.mark.parametrize("n", [0, 1, 50, 298, 300, 2_000])
def test_allowed_rejections_are_the_exact_binomial_bound(spark, n):
    from pyspark.sql import functions as F

    for alpha, level in ((0.01, 0.05), (0.05, 0.0025)):
        k = spark.createDataFrame([(n,)], "n long").select(Q._allowed(F.col("n"), alpha, F.lit(level)).alias("k")).first()["k"]
        want = max([-1, *[i for i in range(int(n * alpha) + 1) if tail(i, n, alpha) <= level]])
        assert k == want


def test_verdict_keeps_good_documents_and_rejects_what_separates(spark, make_docs, prose):
    clean = [(i, prose(80, i), "en") for i in range(700)]
    junk = [(1000 + i, prose(80, i).replace(" ", "*** "), "en") for i in range(200)]
    other = [(2000 + i, prose(80, i).replace(" ", "*** "), "fr") for i in range(5)]  # too few to certify anything
    docs = make_docs(clean + junk + other + [(None, None, None), (3, clean[3][1], "en")])
    labels = spark.createDataFrame([(i, 1) for i in range(0, 700, 1)] + [(1000 + i, 0) for i in range(100)] + [(2000 + i, 0) for i in range(5)] + [(None, 1), (5, None)], "doc_id long, quality int")
    m = Q.measure(docs)
    got = Q.apply_rules(m, Q.certify(m, labels))
    rows = got.collect()
    assert len(rows) == 907
    assert all(r["kept"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 700)
    assert not any(r["kept"] for r in rows if r["doc_id"] is not None and 1000 <= r["doc_id"] < 2000)
    assert all(r["kept"] for r in rows if r["doc_id"] is not None and r["doc_id"] >= 2000)
    assert [r["base_failed"] for r in rows if r["doc_id"] is None] == [True]


def test_conflicting_labels_count_as_the_lowest_and_no_labels_reject_nothing(spark, make_docs, prose):
    m = Q.measure(make_docs([(i, prose(60, i), "en") for i in range(4)]))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r["kept"] for r in Q.apply_rules(m, Q.certify(m, none)).collect())
    both = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, quality int")
    assert Q.certify(m, both).count() == 1


def test_empty_tables(spark, make_docs):
    m = Q.measure(make_docs([]))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.apply_rules(m, Q.certify(m, labels)).count() == 0


def test_the_bound_holds_for_all_rules_of_a_stratum_together(spark, make_docs, prose, monkeypatch):
    """Each rule alone spares enough good documents at its strictest cutoff, together they do not."""
    n, alpha = 1500, 0.02
    text = [prose(80, i) for i in range(n)]
    hit = {"symbols": range(0, 20), "capitals": range(20, 40), "word_length": range(40, 60)}
    for i in hit["symbols"]:
        text[i] = " ".join(w + "|" * 3 for w in text[i].split())
    for i in hit["capitals"]:
        text[i] = text[i].upper()
    for i in hit["word_length"]:
        text[i] = " ".join(w * 4 for w in text[i].split())
    bad = [prose(80, 9_000 + i) for i in range(150)]
    for i in range(150):
        bad[i] = [" ".join(w + "|" * 3 for w in bad[i].split()), bad[i].upper(), " ".join(w * 4 for w in bad[i].split())][i % 3]
    docs = make_docs([(i, t, "en") for i, t in enumerate(text + bad)])
    labels = spark.createDataFrame([(i, int(i < n)) for i in range(n + 150)], "doc_id long, quality int")
    m = Q.measure(docs)

    def lost(rules):
        monkeypatch.setattr(Q, "GRID", {r: g if r in rules else [10**6] for r, g in Q.GRID.items()})
        return Q.apply_rules(m, Q.certify(m, labels, alpha=alpha)).where(f"doc_id < {n} AND NOT kept").count()

    grid = dict(Q.GRID)
    for rule in hit:
        monkeypatch.setattr(Q, "GRID", grid)
        assert lost({rule}) >= 20  # one rule's 20 of 1,500 are within the bound
    monkeypatch.setattr(Q, "GRID", grid)
    most = max(k for k in range(60) if tail(k, n, alpha) <= 0.05)
    assert 20 <= most < 60
    assert lost(set(hit)) <= most


def test_kept_rows_are_the_callers_rows_with_clashing_names(spark, make_docs, prose):
    from pyspark.sql import functions as F

    docs = make_docs([(i, prose(80, i), "en") for i in range(5)] + [(7, "too short", "en"), (None, None, None)])
    names = ["__words", "__lines", "__grams", "__again", "__k0", "__salt", "__s", "base_failed", "rejected_by", "cut_symbols", "n_lines", "a.b"]
    docs = docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in names])
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    got = Q.kept_rows(docs, labels)
    assert got.columns == docs.columns
    want = {tuple(r) for r in docs.where("doc_id < 5").collect()}
    assert {tuple(r) for r in got.collect()} == want
    assert Q.kept_rows(docs.limit(0), labels).count() == 0
