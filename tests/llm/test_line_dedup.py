from collections import defaultdict

from tidemark.llm import line_dedup as L


def brute(rows, min_sites, min_words):
    sites, first = defaultdict(set), {}
    for i, t, _, s in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0)):
        for p, line in enumerate(t.split("\n")):
            bare = line.strip(" \t\x0b\x0c\r")
            if len(bare.split()) >= min_words:
                sites[bare].add(s)
                first.setdefault(bare, (i, p))
    out = {}
    for i, t, _, _ in rows:
        if t is None:
            out[i] = None
            continue
        stay = []
        for p, line in enumerate(t.split("\n")):
            bare = line.strip(" \t\x0b\x0c\r")
            if not (len(sites.get(bare, ())) >= min_sites and first[bare] != (i, p)):
                stay.append(line)
        out[i] = "\n".join(stay)
    return out


def test_lines_on_many_sites_stay_once(make_docs, prose):
    rows = []
    for i in range(60):
        lines = [prose(6, 1000 + i), "  accept all our cookies now " if i % 2 else "accept all our cookies now", "too short", prose(7, i % 7)]
        if i % 9 == 0:
            lines.insert(0, "accept all our cookies now")  # twice in one document
        rows.append((i, "\n".join(lines), "en", None if i % 11 == 0 else f"s{i % 8}"))
    rows += [(100, None, None, "s1"), (101, "", None, "s1"), (102, "\n\n", None, "s2"), (103, "accept all our cookies now", None, "s3"), (104, "x" * 200_000 + "\naccept all our cookies now\n" + "y z " * 50_000, None, "s4"), (None, prose(7, 3), "en", "s9")]
    for sites, words in ((5, 4), (9, 1)):
        want = brute(rows, sites, words)
        got = {r["doc_id"]: r["text"] for r in L.remove_boilerplate(make_docs(rows), min_sites=sites, min_words=words).collect()}
        assert got == want, (sites, words)


def test_repeated_rows_agree_and_columns_stay(make_docs):
    row = (1, "accept all our cookies now\nown line of this page", "en", "a")
    others = [(i, "accept all our cookies now", "en", f"s{i}") for i in range(2, 9)]
    docs = make_docs([row, row, *others])
    got = L.remove_boilerplate(docs)
    assert got.columns == [*docs.columns, "lines_removed"]
    rows = got.collect()
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [row[1]] * 2
    assert all(r["text"] == "" and r["lines_removed"] == 1 for r in rows if r["doc_id"] > 1)


def test_estimates_near_the_threshold_are_counted_exactly(make_docs):
    rows, want = [], {}
    for n in range(37, 44):
        for s in range(n):
            rows.append((n * 1000 + s, f"line of {n} many sites", "en", f"site{s}"))
    got = L.remove_boilerplate(make_docs(rows), min_sites=40).where("lines_removed > 0").collect()
    removed = {r["doc_id"] // 1000 for r in got}
    assert removed == set(range(40, 44)) and len(got) == sum(n - 1 for n in range(40, 44))


def test_empty(make_docs):
    assert L.remove_boilerplate(make_docs([])).count() == 0


def test_pipeline_removes_short_lines_and_lines_without_spaces(spark, make_docs, prose):
    import corpus_pipeline

    shared = ["All rights reserved.", "本网站的所有内容均受版权保护未经许可不得转载", "Home"]
    rows = [(i, "\n".join([prose(8, 50 + i), *shared, "On few" if i < 4 else f"own {i}", " ", ""]), "en", f"s{i}") for i in range(6)]
    rows.append((9, "Home\nAll rights reserved.", "en", "s0"))  # loses all its words
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, make_docs(rows), "").collect()}
    want = brute(rows, 5, 1)
    assert want.pop(9) == "" and got == want
    assert all(line not in got[i].split("\n") for line in shared for i in range(1, 6))


def test_query_takes_lines_of_any_length(spark, make_docs, prose, tmp_path):
    lines = ["All rights reserved.", "本网站的所有内容均受版权保护", "Home", "four words stand here"]
    rows = [(i, "\n".join([prose(5, 70 + i), *lines[: 1 + i % 4], "|", f"own {i}"]), "en", f"s{i}") for i in range(24)]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["text"] for r in L.query(spark, str(tmp_path)).collect()}
    assert got == brute(rows, 5, 1)
    assert got[23] == "\n".join([prose(5, 93), "own 23"])
