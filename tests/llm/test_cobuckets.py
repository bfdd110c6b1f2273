"""Co-bucketed files against plain Python: every row, order, name and digest."""

import datetime
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomwork.llm import cobuckets

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz"
LINES = "sale_id long, line_no int, item_id long, amount double, flag string"


def crc(text, n):
    return zlib.crc32(text.encode()) % n


def order(row):
    first = (0,) if row[0] is None else (1, -row[0])
    return [first] + [(0,) if v is None else (1, v.encode() if isinstance(v, str) else v) for v in row[1:]]


def sha(items):
    return hashlib.sha256(",".join("" if i is None else str(i) for i in items).encode()).hexdigest()


def plain(sales, lines, buckets):
    """Rows by (table, bucket): rows in order, rows by starting file, joined rows, whether the starting file stays."""
    own = lambda i: buckets + 1 if i is None else crc(f"s{i}", buckets)
    known = Counter(r[0] for r in sales if r[0] is not None)
    placed = [("sales", own(r[0]) - (own(r[0]) % 4 == 1), own(r[0]), r) for r in sales]
    placed += [("sale_lines", 0 if r[2] is None else crc(str(r[2]), buckets), buckets if r[0] is not None and r[0] not in known else own(r[0]), r) for r in lines]
    final, begun = defaultdict(list), Counter()
    for table, s, b, row in placed:
        final[table, b].append((s, row))
        begun[table, s] += 1
    out = {}
    for (table, b), held in final.items():
        joined = sum(known[r[0]] for s, r in final.get(("sale_lines", b), []) if r[0] is not None)
        traces = Counter(s for s, _ in held)
        stays = len(traces) == 1 and begun[table, held[0][0]] == len(held)
        out[table, b] = sorted((r for _, r in held), key=order), sorted(traces.items()), joined, stays, min(traces)
    return out


def tables(seed, n):
    rng = random.Random(seed)
    day = datetime.datetime(2024, 1, 1)
    sales = [(rng.choice([i, i, i, None, 7]), rng.choice([None, 1, 2]), rng.choice([None, "é", "z", "\U0001f600", "\uffee", ""]), rng.choice([None, 1.5, -0.5]), day + datetime.timedelta(seconds=rng.randint(0, 3))) for i in range(n)]
    lines = [(rng.choice([7, 7, rng.randint(0, 2 * n), None]), rng.choice([None, 1, 2]), rng.choice([None, 7, 7, rng.randint(0, n)]), rng.choice([0.5, None, 2.0]), rng.choice(["a", "B", None])) for _ in range(4 * n)]
    return sales, lines + lines[:n]


def check(spark, sales, lines, buckets, partitions="4"):
    want = plain(sales, lines, buckets)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder, made = cobuckets.co_bucket(spark.createDataFrame(sales, SALES).repartition(3), spark.createDataFrame(lines, LINES).repartition(5), buckets=buckets)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = made.collect()
    assert sorted((r.table_name, r.bucket) for r in rows) == sorted(want)
    left = sorted(os.path.join(d, f) for d, _, names in os.walk(folder.removeprefix("file://")) for f in names if not f.endswith(".crc"))
    assert left == sorted(r.path.removeprefix("file://") for r in rows)
    stitched = 0
    for r in rows:
        held, traces, joined, stays, number = want[r.table_name, r.bucket]
        file = pq.ParquetFile(r.path.removeprefix("file://"))
        stitched += file.num_row_groups > 1
        found = [tuple(x.values()) for x in file.read().to_pylist()]
        assert found == held, r
        assert r.columns == ",".join(file.schema_arrow.names) == ",".join(c.split()[0] for c in (SALES if r.table_name == "sales" else LINES).split(", "))
        assert (r.n_rows, r.n_joined, r.rewritten) == (len(held), joined, not stays)
        assert r.ids_sha256 == sha(x[0] for x in held) and r.lineage_sha256 == sha(f"{s}:{n}" for s, n in traces)
        assert os.path.basename(r.path) == (f"start-{number:05d}.parquet" if stays else f"bucket-{r.bucket:05d}.parquet")
    return rows, stitched


@pytest.mark.parametrize("seed,n,buckets", [(1, 300, 20), (2, 40, 600)])
def test_files_equal_a_plain_version(spark, seed, n, buckets):
    rows, stitched = check(spark, *tables(seed, n), buckets, "7")
    assert {r.rewritten for r in rows} == {True, False}
    assert stitched or buckets > 20  # the hot sale is sorted by several tasks


def test_a_starting_file_may_stay_under_another_number(spark):
    ids = [i for i in range(2000) if crc(f"s{i}", 600) % 4 == 1][:3]
    rows, _ = check(spark, [(i, 1, "a", 1.0, None) for i in ids], [(ids[0], 1, 5, 1.0, None), (ids[0], 2, 5, 1.0, None)], 600)
    assert not any(r.rewritten for r in rows) and any(f"{r.bucket - 1:05d}" in r.path for r in rows)


def test_empty_tables(spark):
    assert check(spark, [], [], 600)[0] == []
    rows, _ = check(spark, [], [(1, 1, None, 0.5, "a"), (None, None, None, None, None)], 600)
    assert sorted(r.bucket for r in rows) == [600, 601]
    rows, _ = check(spark, [(None, None, None, None, None)] * 2, [], 600)
    assert [(r.bucket, r.n_rows, r.n_joined) for r in rows] == [(601, 2, 0)]


def test_clashing_names(spark):
    sales, lines = tables(3, 50)
    names = ["table", "bucket", "number", "file_number", "bucket_number", "n_held", "n", "Bucket_Number_"]
    wide = lambda df: df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    a, b = spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES)
    want = {(r.table_name, r.bucket): (r.ids_sha256, r.lineage_sha256, r.n_joined, r.rewritten, r.columns + "," + ",".join(names)) for r in cobuckets.co_bucket(a, b, buckets=9)[1].collect()}
    got = {(r.table_name, r.bucket): (r.ids_sha256, r.lineage_sha256, r.n_joined, r.rewritten, r.columns) for r in cobuckets.co_bucket(wide(a), wide(b), buckets=9)[1].collect()}
    assert got == want


def test_an_interrupted_step_can_be_repeated(spark, tmp_path):
    """Parts become the file in one move; a second attempt finds it and leaves it."""
    import pyarrow as pa
    import pyarrow.fs as pafs

    fs = pafs.LocalFileSystem()
    for i in range(3):
        pq.write_table(pa.table({"x": [i, i]}), tmp_path / f"p{i}")
    cobuckets.put_together(fs, [str(tmp_path / f"p{i}") for i in range(3)], str(tmp_path / "whole"))
    assert pq.read_table(tmp_path / "whole").column("x").to_pylist() == [0, 0, 1, 1, 2, 2]
    assert sorted(os.listdir(tmp_path)) == ["p0", "p1", "p2", "whole"]
