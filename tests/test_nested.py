"""Documents read by ranges of any size give the entries that a whole parser gives; row numbers, and frames side by side."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import positions
from loomwork.sources import nested


def some(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 3 else 3)
    if kind < 2:
        return rng.choice([None, True, 1, -2.5e10, 0])
    if kind < 4:
        return "".join(rng.choice(['"', "\\\\", "{", "}", "[", "]", ",", ":", "a", "é", "\U0001f600", "\n", " "]) for _ in range(rng.randint(0, 9)))
    if kind == 4:
        return [some(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {some_key(rng): some(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def some_key(rng):
    return "".join(rng.choice(["k", '"', "\\\\", ":", ",", "{", "}", "é", "_1"]) for _ in range(rng.randint(0, 5)))


def ranges_by_hand(path, member, size, level):
    """The library's passes without Spark, a range after the other."""
    source = nested.Bytes(path)
    out, inside, depth, current = [], False, 0, None
    for start in range(0, source.size, size):
        end = min(source.size, start + size)
        parity, outside, within = nested.change(source, start, end)
        begins = nested.members(source, start, end, inside, depth, current)
        last = nested.last_member(source, start, end, inside, depth)
        for place, text in nested.found(source, start, end, inside, depth, level):
            own = [name for at, name in begins if at < place][-1]
            if level == 1 or own == member:
                out.append((place, *nested.keyed(text)))
        depth += within if inside else outside
        inside ^= bool(parity)
        current = last if last is not None else current
    assert not inside and depth == 0
    return out


@pytest.mark.parametrize("piece", [3, 1 << 21])
def test_any_range_gives_the_entries(tmp_path, monkeypatch, piece):
    monkeypatch.setattr(nested, "PIECE", piece)
    rng = random.Random(7)
    for case in range(60):
        whole = {some_key(rng) + str(i): some(rng) for i in range(rng.randint(0, 3))} | {"m": {f"{some_key(rng)}{i}": some(rng) for i in range(5)}} | {"z": some(rng), "list": [some(rng) for _ in range(4)]}
        path = tmp_path / f"{case}.json"
        path.write_text(json.dumps(whole, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5))
        for size in (1, 2, 7, 64, 1 << 20):
            if size < 3 and case % 6:
                continue
            read = ranges_by_hand(str(path), "m", size, 2)
            assert [(k, json.loads(v)) for _, k, v in read] == list(whole["m"].items()), (case, size)
            assert [json.loads(v) for _, k, v in ranges_by_hand(str(path), "list", size, 2)] == whole["list"]
            assert [(k, json.loads(v)) for _, k, v in ranges_by_hand(str(path), None, size, 1)] == list(whole.items())


def test_entries_of_several_files(spark, tmp_path):
    for name, n in (("a", 40), ("b", 3)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"x": {"k": 1}, "m": {f"{name}{i}": {"v": "}" * i} for i in range(n)}, "after": [1, 2]}))
    (tmp_path / "_hidden.json").write_text("{")
    (tmp_path / "empty.json").write_text("")
    rows = nested.read_entries(spark, str(tmp_path), "m", 100).orderBy("file", "place").collect()
    assert [r.key for r in rows] == [f"a{i}" for i in range(40)] + [f"b{i}" for i in range(3)]
    assert json.loads(rows[39].value) == {"v": "}" * 39}
    assert nested.read_entries(spark, str(tmp_path), "none", 100).count() == 0
    assert nested.read_entries(spark, str(tmp_path / "nothing"), "m").count() == 0


def test_a_document_written_as_a_stream(spark, tmp_path):
    path = str(tmp_path / "out.json")
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, F.concat(F.lit("[" ), F.col("id").cast("string"), F.lit("]"))).alias("v"))
    nested.write_stream(rows.repartition(7), "v", ["id"], path, '{"rows": [', "]}")
    assert json.load(open(path))["rows"] == [[i] for i in range(1000) if i % 10]
    nested.write_stream(rows.where("id < 0"), "v", ["id"], path, "[", "]")
    assert json.load(open(path)) == [] and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out.json"]


def test_places(spark, tmp_path):
    rows = positions.numbered(spark.range(1000).repartition(7).withColumn("x", -F.col("id")), "x")
    assert all(r.position == 999 - r.id for r in rows.collect())
    assert positions.numbered(spark.range(0), "id").count() == 0
    spark.range(10).repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "a"))
    back = positions.read_in_order(spark, str(tmp_path / "a"))
    assert [r.id for r in back.orderBy("position").collect()] == list(range(10))
    both = positions.side_by_side(back, back.withColumnRenamed("id", "other"))
    assert both.count() == 10 and both.where("id <> other").count() == 0
    with pytest.raises(ValueError):
        positions.side_by_side(back, back.where("position < 9"))
