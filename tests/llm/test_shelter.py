"""Stage operators return the caller's columns with the caller's values, whatever their names."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, line_dedup, mixing
from tidemark.llm.common import shelter

NAMES = ["__id", "__th", "__th0", "__gone", "__pos", "__h", "__src", "__src2", "__key", "__tie", "__range", "__range2", "__before", "__in", "__sum", "__epoch",
         "__name", "__salt", "__s", "__k0", "__caller0", "lines_removed", "size", "source_size", "taken", "n", "th", "i", "a.b", "back`tick"]


@pytest.fixture
def docs(make_docs, prose):
    shared = prose(30, 77)
    rows = [(i, prose(40, i) + "\n" + shared, "en", f"s{i % 6}") for i in range(12)] + [(20, prose(40, 0) + "\n" + shared, None, None), (None, None, None, None), (21, "", "en", "s1")]
    df = make_docs(rows)
    return df.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in NAMES if c not in df.columns])


def other(df):
    """The columns no stage may change, by document."""
    return {tuple(r) for r in df.select(*["`" + c.replace("`", "``") + "`" for c in df.columns if c != "text"]).collect()}


def test_shelter_is_undone_in_the_callers_order(docs):
    work, back = shelter(docs, "doc_id", "text")
    assert set(work.columns) >= {"doc_id", "text"} and "size" not in work.columns
    again = back(work.withColumn("extra", F.lit(1)).withColumn("size", F.lit(-1)))
    assert again.columns == docs.columns and other(again) == other(docs)


def test_line_stage(docs):
    got = line_dedup.cleaned_rows(docs)
    assert got.columns == docs.columns and other(got) == other(docs)
    plain = line_dedup.remove_boilerplate(docs)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {r["doc_id"]: r["text"] for r in plain.collect()}
    assert plain.where("lines_removed = 1").count() == 12  # 13 carry the line, one keeps it


def test_join_stage(docs):
    got = jaccard_join.one_of_each(docs)
    assert got.columns == docs.columns and other(got) == {r for r in other(docs) if r[0] != 20}


def test_mixing_stage(docs):
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    assert other(got) <= other(docs) and got.count() > 0
    times = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    plain = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) if r["size"] else 0 for r in mixing.mix(docs.select("doc_id", "text", "source")).collect()}
    assert times == {i: k for i, k in plain.items() if k}
    assert mixing.mix(docs).columns == [c for c in docs.columns if c not in ("text", *mixing.RESULTS)] + mixing.RESULTS
