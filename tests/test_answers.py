"""Answers of the read model on small frames: each outcome, ties, nulls, repeated rows and empty tables."""

from datetime import date, datetime

import pytest

from tessera.operators import answers


def test_status_by_ref(spark):
    states = [(1, "pending"), (2, "complete"), (3, "open"), (4, "conflict"), (35, "complete"), (2**53 - 1, "pending")]
    refs = ["pending:1", "pending:2", "pending:3", "pending:4", "pending:z", "pending:5", "pending:0", "pending:", "pending", "review:1", "pending:1!", "PENDING:1", "pending:Z", "pending:0001",
            "pending:2gosa7pa2gv", "pending:2gosa7pa2gw", "pending:zzzzzzzzzzzzzzzz", None]
    got = answers.status_by_ref(spark.createDataFrame([(r,) for r in refs], "ref string"), spark.createDataFrame(states, "coverage_id long, state string")).collect()
    found = {r.ref: (r.status, r.retry_after) for r in got}
    running, done, gone = ("running", 5), ("complete", None), ("not-found", None)
    wanted = dict.fromkeys(refs, gone) | {"pending:1": running, "pending:0001": running, "pending:2": done, "pending:3": done, "pending:4": ("conflict", None), "pending:z": done, "pending:2gosa7pa2gv": running}
    assert found == wanted and len(got) == len(refs)
    assert answers.status_by_ref(spark.createDataFrame([], "ref string"), spark.createDataFrame([], "coverage_id long, state string")).count() == 0


T = lambda day, hour=0: datetime(2024, 1, day, hour)


@pytest.fixture
def shelf(spark):
    def library(tracked, aliases=(), segments=(), watched=(), ratings=(), upcoming=(), metadata=()):
        frame = spark.createDataFrame
        return {
            (r.user_id, r.work_id): r
            for r in answers.library(
                frame(list(tracked), "row_id long, user_id long, work_key long, status string, rewatch_count int, updated_at timestamp"), frame(list(aliases), "retired long, survivor long"),
                frame(list(segments), "work_id long, locator string"), frame(list(watched), "user_id long, locator string, watched_at timestamp"), frame(list(ratings), "user_id long, work_key long, score int"),
                frame(list(upcoming), "user_id long, work_id long, locator string"), frame(list(metadata), "work_id long, media_kind string, title string, runtime_minutes int"),
            ).collect()
        }

    return library


def test_a_work_is_finished_once_all_is_watched_whatever_its_status(shelf):
    got = shelf(
        [(1, 1, 10, "watching", 0, T(1)), (2, 1, 20, "completed", 2, T(2)), (3, 1, 30, "completed", 0, None), (4, 2, 10, "dropped", 0, T(3))],
        segments=[(10, "a"), (10, "a"), (20, "b"), (20, "c")],
        watched=[(1, "a", T(5, 23)), (1, "a", T(4)), (1, "b", T(6))],
        metadata=[(10, "anime", "Ten", 24)],
    )
    one, two, none, other = got[1, 10], got[1, 20], got[1, 30], got[2, 10]
    assert (one.started_at, one.finished_at, one.total_instalments, one.watched_instalments) == (date(2024, 1, 4), date(2024, 1, 5), 1, 1)
    assert (two.started_at, two.finished_at, two.total_instalments, two.watched_instalments, two.rewatch_count) == (date(2024, 1, 6), None, 2, 1, 2)
    assert (none.started_at, none.finished_at, none.total_instalments, none.watched_instalments) == (None, None, 0, 0)
    assert (other.started_at, other.watched_instalments, other.media_kind, other.title, other.runtime_minutes) == (None, 0, "anime", "Ten", 24)
    assert (two.media_kind, two.title, two.runtime_minutes) == (None, None, None)
    assert [got[1, w].place for w in (20, 10, 30)] == [1, 2, 3]


def test_rows_under_old_keys_are_one_entry(shelf):
    aliases = [(11, 10), (12, 10), (13, 10)]
    got = shelf([(1, 1, 11, "dropped", 0, T(9)), (2, 1, 10, "watching", 1, T(1)), (3, 1, 50, "on_hold", 0, T(5)), (4, 2, 12, "dropped", 0, T(2)), (5, 2, 11, "watching", 3, T(2)), (6, 3, 13, "on_hold", 0, None)], aliases)
    assert set(got) == {(1, 10), (1, 50), (2, 10), (3, 10)}
    assert (got[1, 10].status, got[1, 10].place, got[1, 50].place) == ("watching", 1, 2)  # the canonical row speaks, the latest activity places
    assert (got[2, 10].status, got[2, 10].rewatch_count) == ("watching", 3)  # a tie goes to the later row


def test_ratings_follow_the_keys(shelf):
    aliases = [(11, 10), (12, 10), (13, 10)]
    rate = lambda *rows: shelf([(1, 1, 12, "watching", 0, T(1))], aliases, ratings=rows)[1, 10].personal_rating
    assert rate((1, 10, 9), (1, 12, 8), (1, 11, 7)) == 9
    assert rate((1, 12, 8), (1, 11, 7)) == 8  # the row's own key before the others
    assert rate((1, 13, 6), (1, 11, 7)) == 7
    assert rate((2, 10, 9), (1, 99, 3)) is None
    assert rate((1, 11, 7), (1, 11, 7)) == 7


def test_an_empty_library(shelf):
    assert shelf([]) == {}


def test_instalments_of_answers(spark):
    link = "struct<status string, confidence string, source string, counterparts array<struct<id string, confidence string>>, errors array<struct<reason string, confidence string>>>"
    one = lambda source, status="matched": (status, "high" if status == "matched" else None, source, [("x", "high")] if status == "matched" else [], [])
    frame = spark.createDataFrame
    titles = frame([(1, "release"), (2, "community"), (3, "release")], "title_id long, row_source string")
    links = frame([(1, "mal", one("t1-structure")), (1, "imdb", one(None, "pending")), (2, "mal", one("t3-episode"))], f"title_id long, service string, link {link.replace(' string', ':string').replace(' array', ':array')}")
    spokes = frame([(10, 1, "s1e1"), (11, 1, "s1e2"), (12, 1, None), (20, 2, "s1e1")], "spoke_id long, title_id long, input string")
    inner = frame([(10, "mal", one("t3-episode")), (10, "imdb", one("t2-pattern")), (12, "mal", one("manual"))], f"title_id long, service string, link {link.replace(' string', ':string').replace(' array', ':array')}")
    got = {r.title_id: r for r in answers.answers_with_instalments(titles, links, spokes, inner).collect()}
    assert {k: r.group_source for k, r in got.items()} == {1: "t3-episode", 2: "community", 3: "release"}
    assert [(x.input, x.source, [m.service for m in x.mappings]) for x in got[1].instalments] == [("s1e1", "t3-episode", ["imdb", "mal"]), ("s1e2", "t3-episode", [])]
    assert [(x.input, x.source) for x in got[2].instalments] == [("s1e1", "community")]
    assert got[3].instalments == [] and got[3].mappings == [] and [m.service for m in got[1].mappings] == ["imdb", "mal"]


def test_titles_are_sorted_as_people_read_them(spark):
    from tessera.operators import tracker

    names = ["Éclair", "eclair", "Zebra", "apple", None, "", "ÅNGSTRÖM", "zebra"]
    rows = [(1, k, n, 1, None if k % 2 else k) for k, n in enumerate(names)]
    got = {r.work_id: r for r in tracker.library_places(spark.createDataFrame(rows, "user_id long, work_id long, title string, updated_at int, rating int")).collect()}
    assert [names[k] for k in sorted(got, key=lambda k: got[k].by_title)] == ["ÅNGSTRÖM", "apple", "Éclair", "eclair", "Zebra", "zebra", None, ""]
    assert sorted(got, key=lambda k: got[k].by_rating) == [6, 4, 2, 0, 1, 3, 5, 7]
    days = [("2024-01-02", "zebra", 1, "b"), ("2024-01-02", "Éa", 2, None), ("2024-01-02", "ea", 1, "x"), ("soon", "a", 1, "a"), (None, "a", 1, "a")]
    from pyspark.sql import functions as F

    found = tracker.airing_days(spark.createDataFrame(days, "day string, title string, number int, episode_title string"), F.lit("2024-01-01").cast("date")).collect()
    assert [[x.title for x in r.episodes] for r in found] == [["ea", "Éa", "zebra"]]


def test_service_ratings(spark):
    from tessera.operators import tracker

    frame = spark.createDataFrame
    records = [(1, 80.0, 70.0), (2, None, 70.0), (3, 0.0, 70.0), (4, None, None), (5, 60.0, None), (6, 50.0, None)]
    buckets = [(1, 10, 3), (1, 20, 4), (2, 10, 1), (3, 10, 1), (4, 10, 1), (5, 10, 0)]
    got = tracker.bucketed_ratings(frame(records, "title_id long, average double, mean double"), frame(buckets, "title_id long, bucket int, amount long"))
    assert sorted(map(tuple, got.select("title_id", "score", "votes").collect())) == [(1, 80.0, 7), (2, 70.0, 1)]
    rows = [(1, "anidb", 1, 5.0, 1), (1, "imdb", 2, 8.0, 9), (1, "imdb", 5, 7.0, 8), (1, "tvdb", 3, 9.0, 1), (1, "tmdb", 4, 6.0, 2), (2, "mal", 1, None, None), (3, None, 1, 5.0, 1)]
    schema = "unit_id long, service string, seq long, score double, votes long"
    got = sorted(map(tuple, tracker.rating_list(frame(rows, schema)).collect()))
    assert got == [(1, 1, "tmdb", 6.0, 10, 2), (1, 2, "imdb", 7.0, 10, 8), (1, 3, "anidb", 5.0, 10, 1), (2, 1, "mal", None, 10, None)]
    assert tracker.rating_list(frame([], schema)).count() == 0
