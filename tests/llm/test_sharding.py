"""Sharding against a plain permutation, its SQL, and its written shards."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import queries, sharding

SCHEMA = "doc_id long, text string, shard int, `row` string, key string"


def plain(rows, shards):
    """Key, shard and slot of every row, with the network written out for one number at a time."""
    found = sorted(
        ((i is not None, i or 0), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows
    )
    p = sharding.Permutation(len(found))
    out = []
    for k, ((known, i), size, crc) in enumerate(found):
        x = k
        while True:
            left, right = x >> p.width, x & p.mask
            for a, b, c in p.keys:
                y = (right * a + b) % sharding.PRIME
                y = (y * y + c) % sharding.PRIME
                left, right = right, left ^ (y * y + right) % sharding.PRIME & p.mask
            x = left << p.width | right
            if x < len(found):
                break
        out.append((i if known else None, size, crc, "rows", x % shards, x // shards, None))
    return out


ROWS = [*[(i, f"text {i} é" * (i % 7)) for i in range(700)], *[(None, "hot")] * 400, *[(None, None)] * 3, (5, "x"), (5, "x"), (5, "y"), (2**60 + 1, ""), (-4, "z" * 300_000)]


@pytest.mark.parametrize("chunk", [sharding.CHUNK, 7])
def test_places_equal_a_plain_permutation(spark, monkeypatch, chunk):
    monkeypatch.setattr(sharding, "CHUNK", chunk)
    docs = spark.createDataFrame([(*r, 1, "r", "k") for r in ROWS], SCHEMA).repartition(5)
    got = [tuple(r) for r in sharding.report(docs).collect()]
    assert Counter(got) == Counter(plain(ROWS, 24))
    sizes = Counter(r[4] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 24
    for shard, n in sizes.items():
        assert sorted(r[5] for r in got if r[4] == shard) == list(range(n))
    # how the table is cut changes nothing
    assert Counter(tuple(r) for r in sharding.report(docs.repartition(2, "text")).collect()) == Counter(got)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4096, 100_003])
def test_permutation_is_one_and_can_be_turned_back(n):
    x = np.arange(n)
    p = sharding.Permutation(n).positions(x)
    assert (np.sort(p) == x).all() and (sharding.Permutation(n).numbers(p) == x).all()
    shard, slot = sharding.place(x, n, 7)
    assert (sharding.row_number(shard, slot, n, 7) == x).all()
    if n > 900:  # far from the order of the rows, and other seeds shuffle otherwise
        assert abs(np.corrcoef(x, p)[0, 1]) < 0.1 and (sharding.Permutation(n, 1).positions(x) == p).mean() < 0.01


def test_permutation_of_many_rows():
    p = sharding.Permutation(2**61 + 12345)
    x = np.array([0, 1, 2**61 + 12344, 2**40 + 7, 3**38])
    assert (p.numbers(p.positions(x)) == x).all() and (p.positions(x) < p.n).all()


def test_empty_and_single_tables(spark):
    assert sharding.report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sharding.assign(spark.createDataFrame([], SCHEMA)).count() == 0
    one = sharding.report(spark.createDataFrame([(None, None, 1, "r", "k")], SCHEMA)).collect()
    assert [tuple(r) for r in one] == [(None, 8, 0, "rows", 0, 0, None)]


def test_assign_keeps_rows_whole_and_write_keeps_their_order(spark, tmp_path):
    docs = spark.createDataFrame([(*r, k, f"r{k}", "k") for k, r in enumerate(ROWS)], SCHEMA).repartition(5)
    got = sharding.assign(docs).collect()
    assert sorted(r.row.row for r in got) == sorted(f"r{k}" for k in range(len(ROWS)))
    assert sorted(r.row_no for r in got) == list(range(len(ROWS)))
    key = lambda i, t: (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert Counter((*key(r.row.doc_id, r.row.text), "rows", r.shard, r.slot, None) for r in got) == Counter(plain(ROWS, 24))
    path = f"{tmp_path}/shards"
    sharding.write(docs, path)
    read = spark.read.parquet(path).collect()
    assert Counter((*key(r.row.doc_id, r.row.text), "rows", r.shard, r.slot, None) for r in read) == Counter(plain(ROWS, 24))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sharding_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    wanted = Counter(con.execute(queries.SQL["op11_sharding"]).fetchall())
    assert Counter(tuple(r) for r in queries.QUERIES["op11_sharding"](spark, f"/root/testdata/{sf}").collect()) == wanted
