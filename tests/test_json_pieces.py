"""JSON values read in pieces: every split size gives what a parser of the whole value gives."""

import json
import random

import pytest
from pyspark.errors import PySparkException

from tidemark.sources.files import read_series_json
from tidemark.sources.jsontext import json_items, read_columns, read_records

WANTED = ["timestamp", "price", "load", "series_id"]


@pytest.fixture
def split(spark):
    """Sets the largest split to so many bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(size):
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield to
    for k, v in old.items():
        spark.conf.set(k, v)


def strange(rnd):
    return "".join(rnd.choice(['a', 'é', ',', '}', '{', '"', '\\', '\n', ':', ' ', '[', ']', '","', '"}', '\\"']) for _ in range(rnd.randint(0, 12)))


def records(n, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        r = {"timestamp": f"Jan {i % 28 + 1}, 2024", "price": rnd.choice([None, i / 4, -i]), "Load ": i, "series_id": strange(rnd), strange(rnd) + "x": strange(rnd)}
        out.append({k: r[k] for k in rnd.sample(list(r), len(r))})
    return out


def as_text(v):
    return None if v is None else str(v)


def rows(df):
    return sorted(df.select(*WANTED).collect(), key=str)


def want(found):
    clean = [{k.strip().lower(): v for k, v in r.items()} for r in found]
    return sorted([tuple(as_text(r.get(c)) for c in WANTED) for r in clean], key=str)


@pytest.mark.parametrize("size", [17, 101, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_records_at_any_split(spark, split, tmp_path, size, indent):
    split(size)
    data = records(40)
    path = tmp_path / "r.json"
    path.write_text(json.dumps(data, indent=indent, ensure_ascii=False))
    got = read_records(spark, str(path), WANTED)
    assert sorted([tuple(r) for r in rows(got)], key=str) == want(data)


@pytest.mark.parametrize("size", [17, 101, 1 << 20])
@pytest.mark.parametrize("gap", [(",", ":"), (", ", ": ")])
def test_columns_at_any_split(spark, split, tmp_path, size, gap):
    split(size)
    data = [{k: r.get(k) for k in ("timestamp", "price", "Load ", "series_id")} for r in records(40)]
    obj = {"skip, {me": {"0": 1, "a,b": "}"}, **{c: {f'{i},"}}': r[c] for i, r in enumerate(data)} for c in data[0]}, "none": {}}
    obj["price"]["no stamp"] = 7
    path = tmp_path / "c.json"
    path.write_text(json.dumps(obj, separators=gap))
    got = read_columns(spark, str(path), WANTED)
    assert sorted([tuple(r) for r in rows(got)], key=str) == want(data)


def test_several_files_and_the_splits_of_one(spark, split, tmp_path):
    split(64)
    both = [records(30, s) for s in (1, 2)]
    for i, data in enumerate(both):
        (tmp_path / f"{i}.json").write_text(json.dumps(data))
    items = json_items(spark, str(tmp_path), "}")
    assert items.select("_file", "_block").distinct().count() > 20
    got = read_records(spark, str(tmp_path), WANTED)
    assert sorted([tuple(r) for r in rows(got)], key=str) == want(both[0] + both[1])


def test_empty_values_and_nested_records(spark, tmp_path):
    for i, text in enumerate(["", "[]", " [\n] "]):
        (tmp_path / f"{i}.json").write_text(text)
    assert read_records(spark, str(tmp_path), WANTED).count() == 0
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "x.json").write_text('[{"timestamp": {"a": 1}, "price": 2}]')
    with pytest.raises(PySparkException, match="no flat JSON object"):
        read_records(spark, str(tmp_path / "n"), WANTED).count()


def test_series_from_records_and_columns(spark, split, tmp_path):
    split(33)
    stamps = ["2024-01-01 00:00:00", 1704070800, 1704074400000]
    (tmp_path / "r.json").write_text(json.dumps([{"timestamp": t, "price": str(i)} for i, t in enumerate(stamps)]))
    (tmp_path / "c.json").write_text(json.dumps({"timestamp": dict(enumerate(stamps)), "price": {0: 0, 1: 1, 2: "x"}}))
    for name, layout, last in (("r.json", "records", 2.0), ("c.json", "columns", None)):
        got = read_series_json(spark, str(tmp_path / name), layout=layout).orderBy("ts").collect()
        assert [r["ts"].hour for r in got] == [0, 1, 2] and [r["price"] for r in got] == [0.0, 1.0, last]
        assert {r["series_id"] for r in got} == {"series"}
