"""Streams over several batches: claims that fail, entries that expire, and a table that batches are merged into."""

import time
from datetime import datetime, timedelta

import pytest

from tessera.streaming import events, keyed
from tessera.streaming.snapshots import Snapshot

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def stream(spark, folder, schema, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_claims(spark, tmp_path):
    log = [
        [(1, 1, "deliver", at(0)), (1, 2, "deliver", at(0)), (2, 1, "deliver", at(0)), (3, 1, "complete", at(0)), (4, 1, "deliver", at(0)), (5, 1, "deliver", at(0)), (5, 2, "complete", at(0))],
        [(1, 3, "release", at(0.5)), (1, 4, "deliver", at(0.6)), (1, 5, "complete", at(0.7)), (1, 6, "release", at(0.8)), (2, 2, "complete", at(0.9))],
        [(1, 7, "deliver", at(1)), (2, 3, "deliver", at(1)), (4, 2, "deliver", at(2)), (9, 1, "deliver", at(200))],  # nobody ended the claim on 4
        [(9, 2, "deliver", at(200)), (5, 3, "deliver", at(201)), (10, 1, "deliver", at(400))],  # 5 was done over a week ago
        [(10, 2, "deliver", at(400.5))],
    ]
    got = events.drain(keyed.claims(stream(spark, tmp_path / "in", "event_id long, seq long, action string, at timestamp", log)), str(tmp_path), "claims")
    found = {(r.event_id, r.seq): r.result for r in got.collect()}
    assert found == {
        (1, 1): "claimed", (1, 2): "in_flight", (1, 3): "released", (1, 4): "claimed", (1, 5): "done", (1, 6): "ignored", (1, 7): "duplicate", (2, 1): "claimed", (2, 2): "done", (2, 3): "duplicate",
        (3, 1): "ignored", (4, 1): "claimed", (4, 2): "claimed", (5, 1): "claimed", (5, 2): "done", (5, 3): "claimed", (9, 1): "claimed", (9, 2): "in_flight", (10, 1): "claimed", (10, 2): "in_flight",
    }


def test_cache_expires(spark, tmp_path):
    log = [
        [("a", "volatile", 1, "get", None, at(0)), ("a", "volatile", 2, "put", "x", at(0)), ("a", "core", 3, "put", "y", at(0)), ("b", "rating", 1, "put", "z", at(0))],
        [("a", "volatile", 4, "get", None, at(5.9)), ("a", "volatile", 5, "get", None, at(6)), ("a", "core", 6, "get", None, at(6)), ("b", "rating", 2, "put", "w", at(5)), ("b", "rating", 3, "get", None, at(10.9))],
        [("a", "core", 7, "get", None, at(167.9)), ("a", "core", 8, "get", None, at(168)), ("b", "rating", 4, "get", None, at(11)), ("b", "rating", 5, "put", None, at(12)), ("b", "rating", 6, "get", None, at(12))],
    ]
    schema = "key string, kind string, seq long, action string, value string, at timestamp"
    got = events.drain(keyed.cache(stream(spark, tmp_path / "in", schema, log)), str(tmp_path), "cache")
    found = {(r.key, r.kind, r.seq): (r.hit, r.value) for r in got.collect()}
    assert found == {
        ("a", "volatile", 1): (False, None), ("a", "volatile", 4): (True, "x"), ("a", "volatile", 5): (False, None), ("a", "core", 6): (True, "y"), ("a", "core", 7): (True, "y"), ("a", "core", 8): (False, None),
        ("b", "rating", 3): (True, "w"), ("b", "rating", 4): (False, None), ("b", "rating", 6): (True, None),
    }


ROW = "id long, value string, at timestamp, n long"


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path / "t"), ROW)
    frame = lambda *rows: spark.createDataFrame(list(rows), ROW)
    shown = lambda: {r.id: r.value for r in table.read().collect()}
    assert shown() == {} and table.version() == (0, {})
    assert table.merge(frame((1, "a", at(1), 1), (2, "b", at(1), 2), (2, "c", at(1), 3), (3, None, None, 1)), "s", 0, ["id"], "at", "n")
    assert shown() == {1: "a", 2: "c", 3: None}
    late = frame((1, "late", at(0), 9), (2, "tie", at(1), 9), (3, "dated", at(0), 1), (4, "new", at(5), 1))
    assert table.merge(late, "s", 1, ["id"], "at", "n") and shown() == {1: "a", 2: "c", 3: "dated", 4: "new"}
    assert not table.merge(frame((1, "again", at(9), 1)), "s", 1, ["id"], "at", "n") and not table.merge(frame((1, "again", at(9), 1)), "s", 0, ["id"], "at", "n")
    assert shown()[1] == "a" and table.version() == (2, {"s": 1})
    assert table.merge(frame((1, "other", at(9), 1)), "other", 0, ["id"], "at", "n") and shown()[1] == "other"


def test_a_version_that_was_not_committed_is_not_seen(spark, tmp_path, monkeypatch):
    table = Snapshot(spark, str(tmp_path / "t"), ROW)
    frame = lambda *rows: spark.createDataFrame(list(rows), ROW)
    table.merge(frame((1, "a", at(1), 1)), "s", 0, ["id"], "at")
    with monkeypatch.context() as m:
        m.setattr(Snapshot, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.merge(frame((1, "b", at(2), 1), (2, "b", at(2), 1)), "s", 1, ["id"], "at")
    assert [(r.id, r.value) for r in table.read().collect()] == [(1, "a")]
    assert table.merge(frame((1, "b", at(2), 1)), "s", 1, ["id"], "at") and [(r.id, r.value) for r in table.read().collect()] == [(1, "b")]


def test_batches_of_a_stream_are_merged(spark, tmp_path):
    batches = [[(k % 7, f"b{b}", at(b if k % 2 else -b), k) for k in range(20)] for b in range(4)]
    table = Snapshot(spark, str(tmp_path / "t"), ROW)
    rows = stream(spark, tmp_path / "in", ROW, batches)
    table.drain(rows, "s", ["id"], "at", "n")
    found = {r.id: (r.value, r.n) for r in table.read().collect()}
    wanted = {}
    for b in batches:
        for k, value, when, n in b:
            if k not in wanted or (when, 0) > wanted[k][:2] or when == wanted[k][0] and wanted[k][1] == 0 and n > wanted[k][3]:
                wanted[k] = (when, 0, value, n)
        wanted = {k: (w, 1, v, n) for k, (w, _, v, n) in wanted.items()}
    assert {k: v[0] for k, v in found.items()} == {k: v[2] for k, v in wanted.items()} and len(found) == 7
    table.drain(rows, "s", ["id"], "at", "n")
    assert table.version()[0] == 4


def test_many_events_are_claimed(spark, tmp_path):
    """A call of Python for each event would take minutes; an event without an id is one event, and leaves the others' ids whole."""
    spark.range(300_000).selectExpr("if(id = 7, null, id + 9007199254740993) AS event_id", "explode(array(1L, 2L)) AS seq", "'deliver' AS action", "timestamp '2024-01-01 00:00:00' AS at").coalesce(1).write.parquet(f"{tmp_path}/in/b0")
    log = spark.readStream.schema("event_id long, seq long, action string, at timestamp").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    start = time.monotonic()
    got = events.drain(keyed.claims(log), str(tmp_path), "claims")
    assert time.monotonic() - start < 60
    assert {(r.seq, r.result): r["count"] for r in got.groupBy("seq", "result").count().collect()} == {(1, "claimed"): 300_000, (2, "in_flight"): 300_000}
    assert got.select("event_id").distinct().count() == 300_000 and got.where("event_id IS NULL").count() == 2
