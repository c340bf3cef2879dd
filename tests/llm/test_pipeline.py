"""The whole corpus pipeline against a plain chain of its five stages, each by brute force on what the one before kept."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_jaccard_join import shingles
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_quality_rules import brute as base_measures
from tests.llm.test_quality_rules import tail
from tidemark.llm import byte_bpe, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ID, TEXT, LANG, SOURCE = range(4)


def quality(rows, labels):
    """Rows that pass the base rules and the cutoffs certified per language."""
    m = []
    for r in rows:
        text = r[TEXT] or ""
        n, chars, symbols, dups, repeats = base_measures(text)
        lines = sum(1 for x in text.split("\n") if WORD.search(x))
        capitals = sum(len(re.findall("[A-Z]", w)) for w in WORD.findall(text))
        rates = {"symbols": (symbols, n), "word_length": (chars, n), "dup_lines": (dups, lines), "repeats": (repeats, n), "capitals": (capitals, chars)}
        m.append((r, n < 50 or 100 * repeats > 50 * n, rates))
    above = lambda rates, rule, cut: rates[rule][1] > 0 and 100 * rates[rule][0] > cut * rates[rule][1]
    lowest = {}
    for i, q in labels:
        if i is not None and q is not None:
            lowest[i] = min(q, lowest.get(i, q))
    hold = defaultdict(list)
    for r, failed, rates in m:
        if not failed and r[ID] in lowest:
            hold[r[LANG]].append((lowest[r[ID]] > 0, rates))
    grid, cuts = quality_rules.GRID, defaultdict(dict)
    for lang, found in hold.items():
        good, bad = [x for ok, x in found if ok], [x for ok, x in found if not ok]
        certified = 0
        for j in range(max(map(len, grid.values()))):
            lost = sum(any(above(x, rule, g[min(j, len(g) - 1)]) for rule, g in grid.items()) for x in good)
            if not good or tail(lost, len(good), 0.01) > 0.05 / len(hold):
                break
            certified = j + 1
        for rule, g in grid.items():
            gains = [(sum(above(x, rule, c) for x in bad) * len(good) - sum(above(x, rule, c) for x in good) * len(bad), -i) for i, c in enumerate(g[:certified])]
            if gains and max(gains)[0] > 0:
                cuts[lang][rule] = g[-max(gains)[1]]
    return [r for r, failed, rates in m if not failed and not any(above(rates, rule, c) for rule, c in cuts[r[LANG]].items())]


def first(i):
    return (i is not None, i or 0)


def line_dedup(rows):
    places = defaultdict(list)
    for r in rows:
        for pos, line in enumerate(r[TEXT].split("\n")):
            if WORD.search(line):
                places[line.strip(" \t\x0b\f\r")].append((first(r[ID]), pos, r[SOURCE]))
    gone = {line: min(p[:2] for p in found) for line, found in places.items() if len({s for *_, s in found}) >= 5}
    out = []
    for r in rows:
        lines = list(enumerate(r[TEXT].split("\n")))
        bare = lambda x: x.strip(" \t\x0b\f\r")
        left = [x for pos, x in lines if bare(x) not in gone or gone[bare(x)] == (first(r[ID]), pos)]
        if len(left) == len(lines) or WORD.search("\n".join(left)):
            out.append((r[ID], "\n".join(left), *r[2:]))
    return out


def one_of_each(rows):
    sets = [shingles(r[TEXT]) for r in rows]
    lists, up = defaultdict(list), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in lists[g])
        for j, both in shared.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
        for g in s:
            lists[g].append(i)
    best = {}
    for i, r in enumerate(rows):
        k = root(i)
        if k not in best or first(r[ID]) < first(best[k][ID]):
            best[k] = r
    return list(best.values())


def mix(rows):
    times = {r[0]: math.floor(r[4] / r[1] + 0.5) for r in mixed([(r[ID], r[TEXT], r[LANG], r[SOURCE]) for r in rows])}
    return [r for r in rows for _ in range(times[r[ID]])]


def corpus(prose):
    rnd = random.Random(21)
    rows, labels = [], []
    site = lambda i: [None, "s1", "s2", "s3", "s4", "s5", "s6"][0 if i % 3 == 0 else i % 7]
    footer, short = prose(9, 901), "All rights reserved."
    for i in range(760):
        text = prose(rnd.randint(52, 75), i)
        if i % 4 == 0:
            text += "\n" + footer + ("\n" + short if i % 8 == 0 else "") + "\n" + prose(6, 5_000 + i)
        if i % 9 == 0:
            text = short + "\n \n" + text
        rows.append((i, text, "en", site(i)))
        labels.append((i, 1))
    for i in range(120):  # bad ones, half of them labelled; the same in a language without a certificate
        rows.append((2_000 + i, prose(60, i).replace(" ", "*** "), "en" if i < 100 else "fr", site(i)))
        if i % 2 or i >= 100:
            labels.append((2_000 + i, 0))
    for i in range(40):  # near copies of four documents
        words = rows[11 + i % 4][TEXT].split(" ")
        words[rnd.randrange(len(words))] = f"changed{i}"
        rows.append((3_000 + i, " ".join(words), "en", site(i)))
    rows += [(4_000 + i, f"{footer}\n{short}\n{footer}", "en", site(i)) for i in range(4)]  # too short
    rows += [(4_100 + i, "\n".join([prose(60, 6_000)]), None, site(i)) for i in range(9)]  # one line on many sites: all but one go
    rows += [(5_000, None, "en", "s1"), (5_001, "", None, None), (5_002, " \n\t", "fr", "s2"), (5_003, "w " * 500, "en", "s1"), (None, prose(70, 7_000), "en", "s4")]
    rows += [rows[20], rows[20], (5_004, rows[21][TEXT], "en", "s6"), (5_005, prose(30_000, 8_000), "en", "s5"), (5_006, prose(80, 8_001) + " é日 <|endoftext|> \x1c!", "de", "zz")]
    labels += [(5, 0), (5, 1), (None, 0), (7, None), (99_999, 0), (5_000, 1)]
    rnd.shuffle(rows)
    return rows, labels


@pytest.fixture
def folder(spark, make_docs, tmp_path):
    def make(rows, labels):
        make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return make


def test_the_chain_equals_brute_force(spark, prose, folder):
    rows, labels = corpus(prose)
    kept = quality(rows, labels)
    clean = line_dedup(kept)
    single = one_of_each(clean)
    want = mix(single)
    # every stage has something to do, and clean documents stay
    assert not any(r[ID] is not None and 2_000 <= r[ID] < 2_100 for r in kept) and sum(r[ID] is not None and 2_100 <= r[ID] < 2_120 for r in kept) == 20
    assert len(clean) < len(kept) and sum(a[TEXT] != b[TEXT] for a, b in zip(sorted(clean, key=str), sorted(kept, key=str))) > 50
    assert len(clean) - len(single) >= 40 and len(want) != len(single)
    enc = byte_bpe.coder(*byte_bpe.local_vocabulary())
    tokens = {r[TEXT]: tuple(enc.encode_ordinary(r[TEXT])) for r in want}
    got = corpus_pipeline.run(spark, folder(rows, labels))
    assert got.columns == ["doc_id", "source", "n_tokens", "ids", "decodes"]
    found = Counter((r["doc_id"], r["source"], r["n_tokens"], tuple(r["ids"]), r["decodes"]) for r in got.collect())
    assert found == Counter((r[ID], r[SOURCE], len(tokens[r[TEXT]]), tokens[r[TEXT]], True) for r in want)


def test_empty_tables_and_no_labels(spark, prose, folder):
    assert corpus_pipeline.run(spark, folder([], [])).count() == 0


def test_without_labels_only_the_base_rules_reject(spark, prose, folder):
    rows = [(1, prose(60, 1).replace(" ", "*** "), "en", "a"), (2, prose(60, 2), "en", "a"), (3, prose(49, 3), "en", "a")]
    got = corpus_pipeline.run(spark, folder(rows, [])).collect()
    assert {r["doc_id"] for r in got} <= {1, 2} and Counter(r["doc_id"] for r in got) == Counter(r[ID] for r in mix(rows[:2]))


def test_join_stage_searches_no_chance_meetings(spark, make_docs, prose, monkeypatch):
    """Texts that share half of their shingles with the next one all stay, and no pair of them is searched."""
    from tidemark.llm import jaccard_join

    edges = []
    components = jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda e: (edges.append(e.count()), components(e))[1])
    parts = [prose(60, 7_000 + i) for i in range(31)]
    docs = make_docs([(i, parts[i] + " " + parts[i + 1]) for i in range(30)] + [(99, parts[5] + " " + parts[6])])
    out = corpus_pipeline.join_stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(30))
    assert edges[0] == 0
