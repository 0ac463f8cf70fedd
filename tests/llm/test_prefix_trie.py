"""The prefix trie against a plain one, and its scans over ranges that tear groups apart."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest

from tessera.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, s1 string, place int"


@pytest.fixture(params=[1, 9])
def ranges(request, spark):
    """Few ranges as Spark would have for small tables, and many, which cut groups."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(request.param == 1).lower())
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + said[h:])
    members, children = {}, {}
    for c, p in built.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children.get(p, [])]
        leaves = sum(x[0] for x in below) if below else 1
        saved = sum(x[1] for x in below) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        totals[p] = leaves, saved
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *totals[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == p).encode()).hexdigest())
        for p, m in members.items()
    )


def talk(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(-11, 120):
        if c % 17 == 3:
            continue
        for k in range(rng.randrange(1, 14)):
            turn = None if rng.random() < 0.1 else k if rng.random() < 0.9 else 3
            rows.append((c, turn, rng.choice([None, "user", "bot"]), rng.choice(["a", "b", "é😀", "", None])))
    rows += rng.sample(rows, 30) + [(None, 1, "user", "lost"), (2**60, 1, "user", "far")]
    return rows


def thread(seed):
    """Long shared beginnings, a conversation of a third of all turns, many equal ones, and one long chain of forks."""
    rng = random.Random(seed)
    rows = [(1000, k, "user", f"t{k % 50}") for k in range(1500)]
    rows += [(2000 + c, k, "user", f"t{k % 50}") for c in range(60) for k in range(c)]
    rows += [(5000 + c, k, "bot", "same") for c in range(300) for k in range(4)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("ranges", "make", "piece"), [(1, talk, 4_000), (9, talk, 20), (9, thread, 200)], indirect=["ranges"])
def test_trie_equals_a_plain_one(spark, monkeypatch, ranges, make, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = make(7)
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = Counter(tuple(r) for r in prefix_trie.report(turns).collect())
    wanted = plain(rows)
    assert got == wanted


def test_trie_of_nothing_and_of_one(spark):
    assert prefix_trie.report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.report(spark.createDataFrame([(None, 1, "a", "b", "x", 1)], SCHEMA)).count() == 0
    rows = [(5, None, None, None)]
    assert Counter(tuple(r) for r in prefix_trie.report(spark.createDataFrame([(*rows[0], "x", 1)], SCHEMA)).collect()) == plain(rows)


def test_turnless_conversations_end_at_the_root(spark):
    # of one turn each, with no base, and fewer turns than are left out
    rows = [(c, 0, "user", "x") for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1]
    got = Counter(tuple(r) for r in prefix_trie.report(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect())
    assert got == plain(rows) and len(got) == 1


def test_scan_runs_along_groups(spark, ranges):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, 9]), k, rng.randrange(-5, 5), int(rng.random() < 0.05)) for k in range(600)]
    frame = spark.createDataFrame([(g, k, v & prefix_trie.MASK, f) for g, k, v, f in rows], "g long, k long, v long, f long")
    got = {r.k: r for r in prefix_trie.scan(frame, ["g"], ["k"], ["v", "f"], ["g", "k"], "f", ["k", "v"]).collect()}
    total, seen = {}, {}
    for g, k, v, f in rows:
        a, b = total.get(g, (0, 0))
        total[g] = a + v, b + f
        if f:
            seen[g] = k, v & prefix_trie.MASK
        assert (got[k].v_sum, got[k].f_sum) == (total[g][0] & prefix_trie.MASK, total[g][1])
        assert (got[k].k_last, got[k].v_last) == seen.get(g, (0, 0))
    assert len(got) == len(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_trie_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    wanted = Counter(con.execute(queries.SQL["op13_prefix_trie"]).fetchall())
    assert Counter(tuple(r) for r in queries.QUERIES["op13_prefix_trie"](spark, f"/root/testdata/{sf}").collect()) == wanted
    assert wanted == plain(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall())
