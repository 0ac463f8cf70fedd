"""Fuzzy discovery: what it finds equals scoring all pairs, and cases on small frames."""

import random
import time

from pyspark.sql import functions as F
from test_ladder import normal, similar

from tessera.operators import discovery

QUERIES = "query_id long, service string, title string, year int, group_id long"
TITLES = "ref long, service string, title string, year int, group_id long"


def test_hits_equal_scoring_all_pairs(spark):
    rng = random.Random(8)
    words = ["the", "the", "red", "night", "garden", "of", "ghosts", "é", "II", "story!"]
    name = lambda: rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))]) if rng.random() < 0.2 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    titles = [(k, rng.choice("ab"), name(), rng.choice([None, 2000, 2001, 2009]), rng.choice([None, 1, 2, 3])) for k in range(120)]
    queries = [(q, s, title, year, group) for q in range(30) for title, year, group in [(name(), rng.choice([None, 2000]), rng.choice([None, 1, 2]))] for s in "ab"]
    wanted = {}
    for q, s, title, year, group in queries:
        scored = []
        for ref, service, other, when, own in titles:
            a, b = normal(title), normal(other)
            if service != s or group == own or not set(a.split()) & set(b.split()):
                continue
            x = similar(a, b)
            scored.append((-(x if year is None or when is None else x * 0.6 + (abs(year - when) <= 1) * 0.4), ref))
        for score, ref in sorted((round(x, 9), r) for x, r in scored)[:8]:
            wanted[q, ref] = -score
    got = {(r.query_id, r.ref): r.score for r in discovery.title_hits(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(titles, TITLES)).collect()}
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-6 for k in wanted) and len(wanted) > 100


def test_proposals(spark):
    titles = [(1, "mal", "Red Garden", 2006, 9), (2, "mal", "Red Garden!", 2006, 9), (3, "mal", "The Red Garden", 2006, 9), (4, "mal", "Red Garden", 1990, 9), (5, "imdb", "Red Garden", None, 9), (6, "mal", "Red Garden", 2006, 1)]
    queries = [(q, s, "Red Garden", 2006, 1) for q in (1, 2) for s in ("mal", "imdb")] + [(3, "mal", "Something else", 2006, 1), (4, "imdb", "red", 2006, 9), (5, "mal", None, None, 1)]
    rejected = [(2, "1,2"), (2, "1,2"), (1, "1,5"), (3, "1")]
    frame = spark.createDataFrame
    got = discovery.fuzzy(frame(queries, QUERIES), frame(titles, TITLES), frame(rejected, "query_id long, evidence string"))
    assert {r.query_id: (r.outcome, r.evidence) for r in got.proposals.collect()} == {1: ("queued", "1,2"), 2: ("suppressed", "1,2"), 3: ("no-proposal", None), 4: ("no-proposal", None), 5: ("no-proposal", None)}
    buckets = {r.ref: r.bucket for r in got.hits.where("query_id = 1").collect()}
    assert buckets == {1: "member", 2: "member", 3: "over-cap", 4: "also-considered", 5: "over-cap"}
    none = discovery.fuzzy(frame([], QUERIES), frame([], TITLES), frame([], "query_id long, evidence string"))
    assert none.hits.count() == 0 and none.proposals.count() == 0


def test_words_meet_by_equality(spark):
    """No pair is made but of titles that share a word of one catalogue."""
    got = discovery.title_hits(spark.createDataFrame([(1, "mal", "a b", None, 1)], QUERIES), spark.createDataFrame([(1, "mal", "b c", None, 2)], TITLES))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "NestedLoop" not in plan and got.agg(F.count("*")).first()[0] == 1


def test_equal_titles_are_compared_once(spark):
    """Thousands of rows of one text: all pairs of them would take minutes; a query's own group holds more than it may propose."""
    titles = spark.range(30_000).select(F.col("id").alias("ref"), F.lit("mal").alias("service"), F.lit("Red Garden").alias("title"), (F.col("id") % 3 * 5 + 1990).cast("int").alias("year"), F.floor(F.col("id") / 60).alias("group_id"))
    queries = spark.range(10_000).select(F.col("id").alias("query_id"), F.lit("mal").alias("service"), F.lit("red garden!").alias("title"), F.lit(1995).alias("year"), (F.col("id") % 500).alias("group_id"))
    start = time.monotonic()
    rows = discovery.title_hits(queries, titles).collect()
    assert time.monotonic() - start < 60
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.ref, r.score))
    assert len(got) == 10_000
    for q, found in got.items():
        first = 61 if q % 500 == 0 else 1  # the refs of 1995 are 1, 4, 7 ...
        assert sorted(found) == [(first + 3 * k, 1.0) for k in range(8)]
