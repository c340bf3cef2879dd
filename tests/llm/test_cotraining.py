import random

import numpy as np
import pytest

from tidemark.llm import cotraining as C


@pytest.fixture(scope="module")
def corpus(prose):
    rnd = random.Random(9)
    rows, good = [], {}
    for i in range(900):
        ok = rnd.random() < 0.7
        text = prose(rnd.randint(20, 120), i)
        if not ok:
            text = [lambda t: t.upper() + "!!", lambda t: t.replace(" ", "$$ "), lambda t: t.replace(" ", " | ")][i % 3](text)
        rows.append((i, text, "en", f"s{i % 5}"))
        good[i] = ok
    return rows, good


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_held_out_accuracy_from_few_labels(spark, make_docs, corpus):
    rows, good = corpus
    labels = spark.createDataFrame([(i, int(good[i])) for i in range(0, 900, 4)] + [(1, None), (None, 1)], "doc_id long, quality int")
    extra = [(2000, None, None, None), (2001, "", "en", "s1"), (7, rows[7][1], "en", "s2"), (7, rows[7][1], "en", "s2"), (None, rows[3][1], "en", "s3"), (2002, "word " * 250_000, None, "s0")]
    docs = make_docs(rows + extra)
    got = C.score(docs, labels, per_round=100).collect()
    assert len(got) == len(rows) + len(extra)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] % 4]
    for view in ("text_score", "meta_score", "score"):
        assert auc([(r[view], good[r["doc_id"]]) for r in held]) > 0.9, view
    assert np.mean([r["kept"] == good[r["doc_id"]] for r in held]) > 0.93
    same = {(r["text_score"], r["score"]) for r in got if r["doc_id"] == 7 and r["text_score"]}
    assert len({round(s, 9) for _, s in same}) <= 2  # the two repeated rows agree
    again = C.score(docs, labels, per_round=100).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in again) == sorted((str(r["doc_id"]), r["score"]) for r in got)


def test_without_labels_of_both_classes(spark, make_docs, corpus):
    docs = make_docs(corpus[0][:30])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in C.score(docs, none).collect()} == {1.0}
    one = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    assert {r["kept"] for r in C.score(docs, one).collect()} == {True}
    assert C.score(make_docs([]), none).count() == 0


def test_content_counts_do_not_depend_on_slices(monkeypatch):
    data = ("some text, é " * 50).encode()
    whole = C.content_counts(data)
    monkeypatch.setattr(C, "SLICE", 17)
    assert (C.content_counts(data) == whole).all() and whole[:256].sum() == len(data) and whole[256:].sum() == len(data) - 2
