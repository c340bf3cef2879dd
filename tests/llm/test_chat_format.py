import hashlib
import random

import pytest

from tidemark.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, place long, formatted string"


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or ""))
        pairs = [(r[2] or "", r[3] or "") for r in own]
        learnt = [t for r, t in pairs if r == "assistant"]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(pairs), sha("".join(f"{r}\n{t}\n" for r, t in pairs)), sum(map(len, learnt)), sha("".join(learnt)))
    return out


def test_escape_round_trip():
    rnd = random.Random(2)
    bits = [*C.CONTROLS, "\\", "<", "[", "|", "INST]", "/s>", "a", "\n", "é"]
    for _ in range(5_000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))
        e = C.escape(t)
        assert C.unescape(e) == t
        assert not any(c in e for c in C.CONTROLS)
    for r in ("user", "", "a\nb", "a\\nb", "<|end|>", "[\\INST]", "\\"):
        assert C.unescape_role(C.escape_role(r)) == r and "\n" not in C.escape_role(r)


def test_read_back_equals_the_turns(spark):
    rnd = random.Random(4)
    bits = [*C.CONTROLS, "\\", "<", "word ", "\n", "é日"]
    rows = []
    for c in range(30):
        for t in range(rnd.randint(1, 9)):
            rows.append((c, t, ["system", "user", "assistant"][rnd.randrange(3)], "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 20)))))
    rows += [(50, 0, "user", None), (50, 1, None, "x"), (50, None, "assistant", "no turn"), (50, 1, None, "x"), (None, 0, "assistant", "null id"), (51, 0, "assistant", "y " * 100_000), (52, 0, "odd\nrole <|end|>", "z")]
    rows += [(60, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(2_000)]  # one long conversation
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], SCHEMA)
    formatted = C.format_turns(df)
    got = {r["conv_id"]: r for r in C.read_back(formatted).collect()}
    want = brute(rows)
    assert {c: tuple(r[1:5]) for c, r in got.items()} == want
    chars = {}
    for r in formatted.collect():
        chars.setdefault(r["conv_id"], []).append((r["place"], r["char_offset"], len(r["formatted"])))
    for c, pieces in chars.items():
        at = 0
        for i, (place, offset, n) in enumerate(sorted(pieces)):
            assert (place, offset) == (i, at)
            at += n
        assert got[c]["formatted_chars"] == at


def test_typed_parts(spark):
    part = "struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
    p = lambda kind, text=None, ref=None, w=None, h=None, s=None, n=None: (kind, text, ref, w, h, s, n)
    rows = [
        (1, 0, "user", None, [p("text", "see <|im"), p("text", "age|> "), p("image", ref="a.png", w=56, h=29), None, p("text", " and "), p("audio", ref="b.wav", s=2.01), p("document", ref="c.pdf", n=3)]),
        (1, 1, "assistant", None, [p(None, "ok"), p("image")]),
        (1, 2, "assistant", "plain", None),
        (1, 3, "user", None, []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, content array<{part}>")
    out = {r["place"]: r for r in C.format_turns(df, parts="content").collect()}
    a = out[0]
    assert C.read_piece(a["formatted"]) == ("user", "see <|image|> <|image|> and <|audio|><|document|>")
    assert [(x["place"], x["type"], x["ref"], x["n_tokens"]) for x in a["attachments"]] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 51), (2, "document", "c.pdf", 1728)]
    for x in a["attachments"]:
        assert a["formatted"][x["char_start"] :].startswith(C.PLACEHOLDERS[x["type"]])
    assert a["expanded_tokens"] == 4 + 51 + 1728 and a["loss_start"] is None
    assert out[1]["formatted"][out[1]["loss_start"] : out[1]["loss_end"]] == "ok<|image|>"
    assert C.read_piece(out[2]["formatted"])[1] == "plain" and C.read_piece(out[3]["formatted"])[1] == ""
    with pytest.raises(ValueError, match="unknown content part"):
        C.Visitor().visit({"type": "video"})


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.read_back(C.format_turns(df)).count() == 0
