import hashlib

from tidemark.llm import mixing as M


def brute(rows, weights=M.WEIGHTS, share=M.SHARE, most=M.MOST):
    size = lambda t: len((t or "").split())
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sums = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in names}
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = share * sum(sums.values()), set(names), {}
    while free:  # reshare until none is above
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sums[s]}
        if not over:
            target |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            target[s] = most * sums[s]
            left -= target[s]
        free -= over
    out = []
    for s in names:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (int(hashlib.md5(f"42:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16), r[0] or 0, size(r[1])))
        whole, total = int(target[s]), sums[s]
        epochs, rest = divmod(whole, total) if total else (0, 0)
        for r in own:
            part = min(size(r[1]), max(0, rest))
            rest -= size(r[1])
            out.append((r[0], size(r[1]), total, round(target[s], 6), epochs * size(r[1]) + part))
    return sorted(out, key=str)


def rows_of(n, prose):
    return [(i, prose(1 + i * 7 % 40, i), "en", ["a", "b", "c", "d", None][0 if i % 3 == 0 else i % 5]) for i in range(n)]


def test_mix_equals_brute_force(make_docs, prose):
    rows = rows_of(200, prose) + [(300, None, "en", "a"), (301, "", "en", "z"), (302, "w " * 60_000, "en", "b"), (None, "null id here", "en", "c"), (7, rows_of(8, prose)[7][1], "en", "a")]
    got = M.mix(make_docs(rows)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(((*r[:3], round(r[3], 6), r[4]) for r in got), key=str) == brute(rows)


def test_budgets_are_cut_exactly_in_many_ranges(make_docs, prose, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 2)
    rows = rows_of(150, prose)
    got = M.mix(make_docs(rows)).collect()
    taken, target = {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert {s: int(t) for s, t in target.items()} == taken
    assert sorted(((r["doc_id"], r["taken"]) for r in got), key=str) == sorted(((r[0], r[4]) for r in brute(rows)), key=str)


def test_mixed_rows_repeat_whole_rows(make_docs, prose):
    rows = rows_of(40, prose)
    docs = make_docs(rows)
    out = M.mixed_rows(docs)
    assert out.columns == docs.columns
    n = {r["doc_id"]: 0 for r in docs.collect()}
    for r in out.collect():
        n[r["doc_id"]] += 1
    for i, size, _, _, taken in brute(rows):
        assert n[i] == int(taken / size + 0.5)


def test_empty(make_docs):
    assert M.mix(make_docs([])).count() == 0 and M.mixed_rows(make_docs([])).count() == 0
