import base64
import random

import pytest

from tidemark.llm import byte_bpe as B


@pytest.fixture(scope="module")
def vocabulary():
    return B.local_vocabulary()


def test_pieces_give_the_ids_of_the_whole_text(vocabulary):
    enc = B.coder(*vocabulary)
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab1 \n\t'sé!日    <|>") for _ in range(rnd.randint(0, 200))) for _ in range(1_500)]
    texts += ["a" * 50_000, " " * 20_000 + "x", "日本" * 9_000, "it's we'll " * 3_000, "<|endoftext|>"]
    for t in texts:
        assert list(B.encode_text(enc, t, rnd.randint(1, 40))) == enc.encode_ordinary(t)


def test_control_characters_are_no_white_space_of_the_library(vocabulary):
    tokens = [bytes([b]) for b in range(256)] + [b"!" + bytes([b]) for b in range(0x1C, 0x20)]
    enc = B.coder(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)), vocabulary[1])
    rnd = random.Random(2)
    for _ in range(2_000):
        t = "".join(rnd.choice("a! \n\x1c\x1d\x1e\x1f\x85") for _ in range(rnd.randint(2, 30)))
        assert list(B.encode_text(enc, t, rnd.randint(1, 10))) == enc.encode_ordinary(t)


def test_round_trip_and_columns(make_docs, vocabulary, prose):
    rows = [(1, None), (2, ""), (3, "it's 日本\n\n  é"), (3, "it's 日本\n\n  é"), (None, prose(50, 1)), (5, prose(30_000, 2)), (6, "x" * 300_000)]
    docs = make_docs(rows)
    out = B.decode(B.encode(docs, *vocabulary), *vocabulary)
    assert set(out.columns) == {*docs.columns, "raw"}
    got = out.collect()
    assert len(got) == len(rows)
    enc = B.coder(*vocabulary)
    for r in got:
        assert bytes(r["raw"]) == (r["text"] or "").encode() and r["ids"] == enc.encode_ordinary(r["text"] or "")
    assert B.digests(docs, *vocabulary).count() == len(rows)


def test_ids_of_part_of_a_character_decode_to_raw_bytes(spark, vocabulary):
    enc = B.coder(*vocabulary)
    ids = enc.encode_ordinary("日")
    df = spark.createDataFrame([(1, ids[:1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["raw"] for r in B.decode(df, *vocabulary).collect()}
    assert bytes(got[1]) == enc.decode_bytes(ids[:1]) and got[2] is None and bytes(got[3]) == b""


def test_empty(make_docs, vocabulary):
    assert B.digests(make_docs([]), *vocabulary).count() == 0
