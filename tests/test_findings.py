"""What queries give on rows that the small tables do not hold, against their SQL."""

import random
import re
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import SparkSession
from test_queries import plain

from tessera.llm import fingerprints
from tessera.operators import discovery, graph
from tessera.plans import catalogue
from tessera.sources import bindings, readers


@pytest.fixture
def given(spark: SparkSession, tmp_path):
    """Writes small tables; gives a query's rows, and those of its SQL, over them."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")

    def both(name: str, **tables):
        for t, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        df = catalogue.QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        got = sorted(tuple(plain(r[c]) for c in columns) for r in (x.asDict(recursive=True) for x in df.collect()))
        result = con.execute(catalogue.SQL[name])
        names = [c[0] for c in result.description]
        return got, sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())

    return both


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def test_days_after_the_year_9999(given):
    keys = [1, 2_932_896, 2_932_897, 9_000_001, 60_000_000]
    got, wanted = given("X6_X7_X8_X9_X10_dates", orders=(ORDERS, [(k, 1, "O", 1.0, datetime(1996, 1, 2), "1") for k in keys]))
    assert got == wanted and len(got) == 5


def test_an_order_that_leaves_a_number_out(given):
    text = "x" * 31  # dated, titled and timed
    rows = [(c, n, "user", text) for c, size in ((2, 3), (3, 2), (4, 2), (5, 1), (6, 3), (7, 3)) for n in range(size)]
    rows = [(c, n, r, "x" * 32 if c == 2 and n == 2 else "x" * 35 if c == 3 else t) for c, n, r, t in rows]
    got, wanted = given("M4_episode_groups", conversations=("conv_id long, turn long, role string, text string", rows))
    assert got == wanted and len(got) == 3


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_titles_are_normalised_once_and_not_for_every_pair(given, spark: SparkSession, tmp_path):
    names = ["Blue  Moon!", "blue moon", "uber: 3", "***", "x", "a b a", "b c", "A-B"]
    part = ("p_partkey long, p_name string, p_size int", [(k, names[k % 8], k % 7) for k in range(24)])
    for i, name in enumerate(["X3_edit_distance_X4_title_similarity_A10_overlap", "X5_hit_score"]):
        got, wanted = given(name, **({} if i else {"part": part}))
        assert got == wanted and len(got) == 192
        above, _, below = optimized(catalogue.QUERIES[name](spark, str(tmp_path))).partition("Join Inner")
        assert below and "regexp_replace" not in above and "Repartition" in below


def test_a_document_is_parsed_once(given, spark: SparkSession, tmp_path):
    got, wanted = given("S7_S8_anime_xml", part=("p_partkey long, p_name string, p_size int", [(k, f"t {k}", k % 3) for k in range(9)]))
    assert got == wanted and len(got) == 9
    plan = optimized(catalogue.QUERIES["S7_S8_anime_xml"](spark, str(tmp_path)))
    assert plan.count("from_xml") + plan.count("XmlToStructs") == 1 and "Repartition" in plan


def test_a_text_is_moved_by_its_key_once(spark: SparkSession, monkeypatch):
    tables = {}
    keep = fingerprints.materialise
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    monkeypatch.setattr(fingerprints, "materialise", lambda df, name: keep(tables.setdefault(name, df), name))
    docs = spark.createDataFrame([(k, f"some words of text {k} " * (k % 5)) for k in range(40)], "doc_id long, text string")
    try:
        assert fingerprints.compare(docs).count() == 40
        edited = tables["edited"]
        edited.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "ReusedExchange" in edited._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that discovery has cut."""
    counts, cut = [], discovery.cut

    def counted(df):
        out = cut(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(discovery, "cut", counted)
    return counts


def test_rows_of_a_walk_are_written_once(spark: SparkSession, written):
    nodes = [(100 * c + k, 100 * c + k + 1) for c in range(20) for k in range(31)]
    heads = spark.createDataFrame([(100 * c + k,) for c in range(20) for k in range(32)], "node long")
    got = sorted(map(tuple, discovery.walk(spark.createDataFrame(nodes, "from_id long, to_id long"), heads).select("chain_id", "node", "pos").collect()))
    assert got == sorted((100 * c + k, 100 * c + k + n, n) for c in range(20) for k in range(32) for n in range(32 - k))
    assert sum(written) < 1.5 * len(got)


def test_walks_into_cycles_and_to_ends(spark: SparkSession):
    to = {0: 1, 1: 2, 2: 0, 3: 4, 4: 5, 5: 1, 6: 6, 7: 6, 8: 9, 9: 10, 12: 13, 13: 12} | {k: k + 1 for k in range(20, 60)}
    heads = [*to, 10, 99]
    got = discovery.walk(spark.createDataFrame(list(to.items()), "from_id long, to_id long"), spark.createDataFrame([(h,) for h in heads], "node long"))
    wanted = []
    for h in heads:
        seen, node = [], h
        while node is not None and node not in seen:
            seen.append(node)
            node = to.get(node)
        wanted += [(h, n, p) for p, n in enumerate(seen)]
    assert sorted(map(tuple, got.select("chain_id", "node", "pos").collect())) == sorted(wanted)


def test_a_page_walk_does_not_go_on_after_its_most_pages(spark: SparkSession, written):
    url = "https://api.example/list?offset={}".format
    pages = spark.createDataFrame([(1, url(k), url(k + 1)) for k in range(600)], "list_id long, url string, next string")
    walked = readers.page_walk(pages, pages.where("url LIKE '%=0'").select("list_id", "url"), 5)
    assert sorted((r["url"], r["place"]) for r in walked.collect()) == [(url(k), k) for k in range(5)]
    assert len(written) < 16 and max(written) <= 600


LINE = "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string"
PART = "p_partkey long, p_name string, p_size int"
PARTS = [(k, f"part {k}", k % 9) for k in range(48)]
#: Eight parts an order, one of them twice; a part that is missing and keys that are null.
LINES = [(o, (o * 7 + n * n * 3 + n) % 48, n, "R" if (o + n) % 3 else "N") for o in range(60) for n in range(8)]
LINES += [(o, o * 7 % 48, 9, "A") for o in range(60)] + [(5, 99, 1, "R"), (5, None, 1, "R"), (None, 5, 1, "R")]


@pytest.fixture
def large(spark: SparkSession):
    """Plans as with tables that are too large for broadcasts, and as they stand."""
    with_ = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in with_}
    for k, v in with_.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def moved(node) -> int:
    """Rows that a finished plan wrote to its shuffles."""
    own = node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
    return own + sum(moved(node.children().apply(i)) for i in range(node.children().size()))


@pytest.mark.parametrize("name", ["W10_first_edge_wins", "J2_derive_all_W9_strongest_path"])
def test_a_route_is_moved_once_for_both_ways_and_edges_once_by_unit(given, large, spark: SparkSession, tmp_path, name):
    got, wanted = given(name, lineitem=(LINE, LINES), part=(PART, PARTS))
    assert got == wanted and len(got) > 400
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    df.collect()
    edges = {(o, p) for o, p, *_ in LINES if o is not None and p is not None and p < 48}
    routes = sum(o == q and p % 6 != r % 6 for o, p in edges for q, r in edges)
    assert moved(df._jdf.queryExecution().executedPlan()) <= len(LINES) + len(PARTS) + len(edges) + routes // 2


def test_paths_both_ways(spark: SparkSession):
    rng = random.Random(7)
    edges = [(t, "cab"[t % 3], u, rng.randrange(2), rng.randrange(4), 1000 * rng.randrange(3) + 20 * u + t) for u in range(30) for t in rng.sample(range(14), 6)]
    edges += [(14, None, u, 1, 1, u) for u in range(9)]
    df = spark.createDataFrame(edges, "title_id long, service string, unit_id long, confidence int, provenance int, edge_id long")
    paths: dict = {}
    for t, s, u, c, p, _ in edges:
        for t2, s2, u2, c2, p2, e2 in edges:
            if u == u2 and s and s2 and s != s2:
                paths.setdefault((t, t2, s2), []).append((e2, u, min(c, c2), max(p, p2)))
    for tasks in (None, 3):
        first = {r[:3]: r[3:] for r in map(tuple, graph.first_paths(df, tasks).select("title_id", "target_id", "target_service", "edge_id", "unit_id", "confidence", "provenance").collect())}
        assert first == {k: min(v) for k, v in paths.items()}
        best = {r[:3]: r[3:] for r in map(tuple, graph.strongest_paths(df, tasks).select("title_id", "target_id", "target_service", "confidence", "provenance", "unit_id").collect())}
        assert best == {k: min(((c, p, u) for _, u, c, p in v), key=lambda x: (-x[0], -x[1], x[2])) for k, v in paths.items()}


def test_shared_units_are_counted_after_their_shuffle_in_tasks_as_many_as_the_lines_need(given, large, spark: SparkSession, tmp_path, monkeypatch):
    monkeypatch.setattr(bindings, "LINES", 40, raising=False)
    got, wanted = given("J9_best_aligned_A9_shared_units", lineitem=(LINE, LINES), part=(PART, PARTS))
    assert got == wanted and len(got) > 100
    plan = catalogue.QUERIES["J9_best_aligned_A9_shared_units"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"partial_count.*\n.*Exchange hashpartitioning\(title_id", plan)
    dealt = re.findall(r"hashpartitioning\(((?:l_partkey|title_id|unit_id)#\d+L), (\d+)\)", plan)
    assert len(dealt) >= 4 and {int(n) for _, n in dealt} == {-(-len(LINES) // 40)}


def test_no_table_of_titles_is_broadcast_for_answers_with_instalments(given, large, spark: SparkSession, tmp_path, monkeypatch):
    monkeypatch.setattr(bindings, "LINES", 100)
    rng = random.Random(3)
    lines = [(o, rng.randrange(60), n, rng.choice("NR")) for o in range(6000) for n in range(rng.randrange(1, 4))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # parts are less by their file, as over larger tables by the usual 10 MB, and lines more
    got, wanted = given("R1_title_instalments", lineitem=(LINE, lines), part=(PART, PARTS))
    assert got == wanted and len(got) == 48
    df = catalogue.QUERIES["R1_title_instalments"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "Scan ExistingRDD" not in plan and "ShuffledHashJoin" in plan


def test_instalments_that_cannot_be_named_count_for_the_source_of_their_group(given):
    lines = [(2, 1, 6, "N"), (2, 2, 1, "N"), (4, 1, 1, "N"), (4, 3, 1, "R"), (7, 1, 2, "N"), (9, 5, 3, "N")]  # 7 and 9: no counterparts
    got, wanted = given("R1_title_instalments", lineitem=(LINE, lines), part=(PART, [(k, f"part {k}", 3) for k in range(1, 7)]))
    assert got == wanted and len(got) == 6 and sum("community" in r for r in got) == 2


@pytest.mark.parametrize("name", ["R5_nested_response", "R6_compact_response_A7", "R1_title_answer_A6_link_grades"])
def test_a_path_is_moved_once_to_the_title_that_it_answers(given, large, spark: SparkSession, tmp_path, monkeypatch, name):
    monkeypatch.setattr(bindings, "LINES", 40)
    got, wanted = given(name, lineitem=(LINE, LINES), part=(PART, PARTS))
    assert got == wanted and len(got) >= 48
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    df.collect()
    edges = {(o, p) for o, p, *_ in LINES if o is not None and p is not None and p < 48}
    paths = sum(o == q and p % 6 != r % 6 for o, p in edges for q, r in edges)
    plan = df._jdf.queryExecution().executedPlan()
    assert moved(plan) <= len(LINES) + 2 * len(PARTS) + len(edges) + paths
    assert set(re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan.toString())) == {str(-(-len(LINES) // 40))}  # as many tasks as the lines need at every step
