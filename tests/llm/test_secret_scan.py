import hashlib
import math
import random
import re
from collections import defaultdict

from tidemark.llm import secret_scan as S

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    listed = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))
    return tuple(sum(x[1] == k for x in out) for k in range(3)) + (hashlib.sha256(listed.encode()).hexdigest(),), listed


def text_of(rnd):
    bits = ["password", "Token", "API_KEY", "apikey", "=", ":", " ", "  ", '"', "'", "abcdefghijkl", "short", "AKIA", "AKIA" + "Q7" * 8, "0123456789abcdef", "deadbeef" * 3, "é日", "\n", "=", ".", "x" * 12]
    return "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))


def test_base_spans_equal_brute_force(make_docs):
    rnd = random.Random(7)
    rows = [(i, text_of(rnd)) for i in range(500)]
    rows += [(600, None), (601, ""), (602, "token=password: abcdefghijklmnop"), (603, "a" * 100_000 + " secret = " + "b" * 40), (604, "deadbeefdeadbeef " * 2_000), (None, "token=abcdefghijklmnop"), (3, rows[3][1]), (3, rows[3][1])]
    got = S.summaries(make_docs(rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(base(t))
    for r in got:
        digest, listed = want[r["doc_id"]][0]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == digest, r["doc_id"]
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("random")) == listed


def tokens(rnd):
    abc = S.ENCODINGS["base62"][1]
    strong = ["".join(rnd.choice(abc) for _ in range(40)) for _ in range(150)]
    strong = [s for s in strong if re.search("[0-9]", s) and re.search("[A-Za-z]", s)]
    weak = [f"section{i:03d}section{i:03d}section{i:03d}" for i in range(150)] + ["aaaaaaaaaaaaaaaaaaaaaaaa1", "abcdefghijklmnopqrstuvwxyz0123456789"]
    return strong, weak


def test_battery_claims_random_strings_and_leaves_identifiers(make_docs):
    strong, weak = tokens(random.Random(11))
    rows = [(i, f"see {t} here") for i, t in enumerate(strong + weak)]
    got = {r["doc_id"]: r["spans"] for r in S.summaries(make_docs(rows)).collect()}
    found = [i for i, s in got.items() if "random:4:" in s]
    assert sum(i < len(strong) for i in found) >= 0.85 * len(strong)
    wrong = [i for i in found if i >= len(strong)]
    assert len(wrong) <= 0.1 * len(found)  # the rate that is controlled
    assert not [i for i in wrong if (strong + weak)[i].startswith("section")]


def test_p_values_of_random_strings_are_uniform(spark):
    rnd = random.Random(13)
    rows = [("".join(rnd.choice("0123456789abcdef") for _ in range(64)),) for _ in range(1_500)]
    p = [r["p_value"] for r in S.battery(spark.createDataFrame(rows, "value string")).collect()]
    assert len(p) == 1_500
    for q in (0.1, 0.5, 0.9):
        assert abs(sum(x < q for x in p) / len(p) - q) < 0.06


def test_empty_and_plain_texts(make_docs):
    assert S.summaries(make_docs([])).count() == 0
    got = S.summaries(make_docs([(1, "only words here")])).collect()
    assert [r["spans"] for r in got] == [""] and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_values_after_names_and_paths_are_candidates(make_docs):
    rnd = random.Random(29)
    a62, a64 = S.ENCODINGS["base62"][1], S.ENCODINGS["base64"][1]
    short, plain, full = ("".join(rnd.choice(abc) for _ in range(n)) for abc, n in ((a62, 24), (a62, 40), (a64, 40)))
    letters = "".join(rnd.choice(a62[10:]) for _ in range(16))  # no digit
    cases = [("AUTH=", short, ""), ("see ?sig=", plain, "&x=1"), ("client_id=", full, "=="), ("org/a-b/", plain, ""), ("my-app/", plain, " end"), ("", letters, ""), ("é ", plain, "=x")]
    rows = [(i, a + v + z) for i, (a, v, z) in enumerate(cases)]
    got = {(r["__id"], r["start"], r["value"]) for r in S.matches(make_docs(rows)).where("kind = 3").collect()}
    for i, (a, v, z) in enumerate(cases):
        assert (i, len(a), v + ("==" if z == "==" else "")) in got, cases[i]


def test_of_nested_claims_the_outermost_stays(spark):
    rows = [(1, 7, 3, 0, 50), (1, 7, 3, 0, 20), (1, 7, 3, 21, 50), (1, 7, 3, 60, 80), (1, 8, 3, 0, 20), (None, 7, 3, 1, 30)]
    got = S.outermost(spark.createDataFrame(rows, "__id long, __th long, kind int, start long, end long")).collect()
    assert {tuple(r) for r in got} == {rows[0], rows[3], rows[4], rows[5]} and len(got) == 4


def null_of(spark, texts):
    """The shares that a corpus of these texts gives."""
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    return S.shares(S.known(spark, S.vocabulary(docs)))


def claimed(spark, values, null):
    return {r["value"] for r in S.claim(S.battery(spark.createDataFrame([(v,) for v in values], "value string")), null).collect()}


def secret(rnd, n=40):
    return "".join(rnd.choice(S.ENCODINGS["base62"][1]) for _ in range(n))


# Words of four languages, used nowhere else.
FOREIGN = """talo kissa koira metsa jarvi lumi kaupunki ystava samaki nyumba mtoto kitabu barabara chakula rafiki jioni
dworzec ksiazka rzeka miasto zamek wiosna ogrod jesien biblioteka calle ventana corazon invierno puente zapato""".split()
NAMES = ["Amber", "Basket", "Cobalt", "Dragon", "Engine", "Falcon", "Garnet", "Harbor", "Island", "Jacket", "Kettle", "Lantern"]


def identifiers(rnd, words, n, low, high):
    made = set()
    while len(made) < n:
        v = "".join(rnd.choice(words).title() for _ in range(24))
        made.add(v[: rnd.randint(low, high)])
    return made


def test_the_vocabulary_follows_the_texts_and_is_bounded(spark):
    texts = ["common word, HTTPServer seenOnce" + ("x" * 30), "common word fooBarBaz", "common fooBarBaz_bar1", "common", None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = S.vocabulary(docs, slots=1_000)
    share = {w: got.count(w) for w in set(got)}
    # (text, word) pairs of words in two texts: common 4, word 2, foo 2, bar 2, baz 2
    assert set(share) == {"common", "word", "foo", "bar", "baz"} and abs(len(got) - 1_000) <= len(share)
    assert abs(share["common"] - 4_000 / 12) <= 1 and abs(share["baz"] - 2_000 / 12) <= 1
    assert S.vocabulary(docs, slots=1_000) == got
    assert S.vocabulary(docs.limit(0)) == [] and S.known(spark, []).count() == 0


def test_made_strings_have_every_class_and_length(spark):
    rows = S.known(spark, ["alpha", "bed", "gamma"], 20).collect()
    assert len(rows) == S.SHAPES * len(S.SIZES) * 20 and {r["shape"] for r in rows} == set(range(S.SHAPES))
    for low, high in S.SIZES:
        assert sum(low <= len(r["value"]) <= high for r in rows) == S.SHAPES * 20


def test_few_secrets_among_many_identifiers_are_found(spark):
    rnd = random.Random(31)
    plain, secrets = identifiers(rnd, NAMES, 400, 34, 44), {secret(rnd) for _ in range(5)}
    got = claimed(spark, plain | secrets, null_of(spark, plain | secrets))
    assert len(got & secrets) >= 4 and len(got - secrets) <= 1


def test_identifiers_of_words_seen_nowhere_else_claim_next_to_nothing(spark):
    rnd = random.Random(41)
    plain = set().union(*[identifiers(rnd, FOREIGN, 1_300, low, high) for low, high in ((16, 22), (23, 31), (32, 45), (46, 63))])
    null = null_of(spark, plain)
    assert len(claimed(spark, plain, null)) <= 5  # of 5,200
    for low, high in ((23, 31), (32, 45), (46, 63)):
        secrets = {secret(rnd, rnd.randint(low, high)) for _ in range(130)}
        got = claimed(spark, {v for v in plain if low <= len(v) <= high} | secrets, null)
        assert len(got - secrets) <= 0.1 * len(got) + 1, (low, len(got - secrets))
        assert len(got & secrets) >= (0.4 if low == 23 else 0.8) * len(secrets), (low, len(got & secrets))


def test_one_secret_is_enough_and_a_corpus_without_words_claims_nothing(spark):
    rnd = random.Random(37)
    many = S.battery(spark.createDataFrame([(secret(rnd),) for _ in range(60)], "value string")).collect()
    one = next(r["value"] for r in many if 0.2 < r["p_value"] < 0.4)
    assert claimed(spark, [one], null_of(spark, [" ".join(FOREIGN)] * 2)) == {one}
    assert not claimed(spark, [one], null_of(spark, [one]))


def test_claims_equal_a_plain_count(spark):
    """Cut, shares and claims by hand from the p-values."""
    rnd = random.Random(43)
    made = S.known(spark, FOREIGN)
    null = S.shares(made)
    values = identifiers(rnd, FOREIGN, 300, 17, 60) | {secret(rnd, rnd.randint(17, 60)) for _ in range(60)}
    cls = lambda r: (r["encoding"], min(S.LONGEST, max(8, math.floor(2 * math.log2(r["n_symbols"])))))
    worst = defaultdict(list)
    for r in S.battery(made).collect():
        worst[(*cls(r), r["shape"])].append(r["p_value"])
    tested = S.battery(spark.createDataFrame([(v,) for v in values], "value string")).collect()
    want = set()
    for c in {cls(r) for r in tested}:
        own = [r for r in tested if cls(r) == c]
        shapes = [p for k, p in worst.items() if k[:2] == c and len(p) >= S.EACH // 10]
        for cut in S.CUTS if shapes else []:
            share = max((sum(x >= cut for x in p) + 1) / (len(p) + 1) for p in shapes)
            above = [r["value"] for r in own if r["p_value"] >= cut]
            if above and len(own) * share <= 0.1 * len(above):
                want |= set(above)
                break
    assert claimed(spark, values, null) == want and want
