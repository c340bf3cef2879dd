import hashlib
import io
import struct

import pytest

from tidemark.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string, size long"


def brute(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            d = hashlib.sha256(b).hexdigest()
            first[d] = min(first.get(d, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        d = hashlib.sha256(b).hexdigest()
        again = len(b) >= 100 and i is not None and first[d] != i
        out.append((i, len(b), d, "revisit" if again else "response", first[d] if again else None))
    return sorted(out, key=str)


def rows_of(prose):
    page = lambda n, s: f"<html><body>{prose(n, s)}</body></html>"
    rows = [(i, f"http://h{i % 7}.example/{i}?q=é x\r\nX-Bad: 1", page(40 + i % 9, i)) for i in range(60)]
    rows += [(100 + i, f"http://mirror.example/{i}", rows[5][2]) for i in range(80)]  # one payload very often
    rows += [(200, None, None), (201, "", ""), (202, "u", "short"), (203, "u", "short"), (None, "n", rows[5][2]), (5, "again", rows[5][2]), (204, "b", "é" * 50), (205, "b", "é" * 50), (206, "l", "x y " * 300_000)]
    return rows


def write(spark, rows, tmp_path, **o):
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA)
    return W.write(df, f"file://{tmp_path}/w", **o), f"file://{tmp_path}/w"


def test_archives_read_back(spark, tmp_path, prose):
    rows = rows_of(prose)
    index, folder = write(spark, rows, tmp_path, roll_bytes=20_000)
    got = W.read(spark, folder, index).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(rows)
    by = {(r[0], r[1] or ""): (r[2] or "").encode() for r in rows}
    for r in got:
        if r["record_type"] == "response":
            assert bytes(r["payload"]) in set(by.values())
    assert index.select("file").distinct().count() > 3


def test_files_hold_the_dictionary_first_and_records_by_themselves(spark, tmp_path, prose):
    import zstandard

    index, _ = write(spark, rows_of(prose), tmp_path)
    sizes = []
    for row in index.collect():
        data = (tmp_path / "w" / row["file"]).read_bytes()
        magic, n = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D and n > 1000
        known = zstandard.ZstdCompressionDict(data[8 : 8 + n])
        frame = data[row["offset"] : row["offset"] + row["length"]]
        record = zstandard.ZstdDecompressor(dict_data=known).decompress(frame, max_output_size=10_000_000)
        assert record.startswith(b"WARC/1.1\r\n") and W.parse_record(record)["page_id"] == row["page_id"]
        sizes.append((len(frame), len(zstandard.ZstdCompressor(level=6).compress(record))))
    assert sum(a for a, _ in sizes) < sum(b for _, b in sizes)
    assert not [p for p in (tmp_path / "w").iterdir() if p.name.startswith(".part")]


def test_a_damaged_archive_is_an_error():
    with pytest.raises(ValueError):
        list(W.records(io.BytesIO(struct.pack("<II", 1, 0))))
    import zstandard

    good = struct.pack("<II", W.SKIPPABLE, 0) + zstandard.ZstdCompressor().compress(W.record_bytes(1, "u", hashlib.sha256(b"x").hexdigest(), 1, None, b"x"))
    assert [W.parse_record(r)["payload"] for r in W.records(io.BytesIO(good))] == [b"x"]
    with pytest.raises(ValueError):
        list(W.records(io.BytesIO(good[:-3])))
    bad = W.record_bytes(1, "u", "0" * 64, 1, None, b"x")
    with pytest.raises(ValueError):
        W.parse_record(bad)


def test_empty(spark, tmp_path):
    index, folder = write(spark, [], tmp_path)
    assert W.read(spark, folder, index).count() == 0
