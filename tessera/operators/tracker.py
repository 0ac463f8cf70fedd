"""Tracking: ratings, statistics, progress, history, calendar, imports and sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scores import STATUSES, rounded
from tessera.functions.text import alphabetical
from tessera.operators.graph import first_of, ranked


def community_scores(units: DataFrame, ratings: DataFrame) -> DataFrame:
    """Per unit the number of raters and their mean: one score a user, the canonical key's before the aliases', of aliases the
    later row. units: unit_key, member_key (itself and its aliases); ratings: rating_id, user_id, unit_key, score.

    Both reductions are aggregates that combine before the shuffle."""
    keyed = units.select(F.col("unit_key").alias("_unit"), F.col("member_key").alias("_key"))
    hits = keyed.join(ratings, F.col("_key") == F.col("unit_key")).select("_unit", "user_id", F.struct((F.col("_unit") == F.col("_key")).alias("own"), "rating_id", "score").alias("r"))
    one = hits.groupBy("_unit", "user_id").agg(F.max("r").alias("r"))
    scores = one.groupBy("_unit").agg(F.count("*").alias("n_raters"), F.avg("r.score").alias("mean"))
    return units.select(F.col("unit_key").alias("_unit")).distinct().join(scores, "_unit", "left").select(
        F.col("_unit").alias("unit_key"), F.coalesce("n_raters", F.lit(0)).alias("n_raters"), "mean"
    )


def library_stats(entries: DataFrame) -> DataFrame:
    """Per user: counts by status and kind (zero where none), ratings, rewatches, instalments, minutes; one aggregate.

    entries: user_id, status, media_kind, rating, rewatch_count, total, watched, runtime."""
    n = lambda c: F.count_if(c)
    return entries.groupBy("user_id").agg(
        F.count("*").alias("n_works"),
        *[n(F.col("status") == s).alias(f"n_{s}") for s in STATUSES],
        *[n(F.col("media_kind") == k).alias(f"n_{k}") for k in ("anime", "film", "tv")],
        F.count("rating").alias("n_rated"),
        (rounded(F.avg("rating") * 10) / 10).alias("mean_rating"),
        F.sum("rewatch_count").alias("rewatch_count"),
        F.sum("total").alias("total_instalments"),
        F.sum("watched").alias("watched_instalments"),
        F.coalesce(F.sum(F.col("watched") * F.col("runtime")), F.lit(0)).alias("watched_minutes"),
        F.bool_or(F.col("runtime").isNull() & (F.col("watched") > 0)).alias("omitted_runtime"),
    )


def watch_spans(works: DataFrame, progress: DataFrame) -> DataFrame:
    """Per user and work: first and last day of watching; the last only if every locator is watched, as is ``completed``.

    works: work_id, locator; progress: user_id, locator, watched_at."""
    need = works.groupBy("work_id").agg(F.countDistinct("locator").alias("_need"))
    seen = works.distinct().join(progress, "locator").groupBy("user_id", "work_id").agg(
        F.min("watched_at").alias("_first"), F.max("watched_at").alias("_last"), F.countDistinct("locator").alias("n_watched")
    )
    done = F.col("n_watched") == F.col("_need")
    return seen.join(need, "work_id").select(
        "user_id",
        "work_id",
        "n_watched",
        F.when(done, "completed").otherwise("watching").alias("status"),
        F.to_date("_first").alias("started_on"),
        F.when(done, F.to_date("_last")).alias("finished_on"),
    )


def next_up(segments: DataFrame, statuses: DataFrame, watched: DataFrame) -> DataFrame:
    """Per user and work the first locator, in presentation order, that is not watched; none for completed works.

    segments: work_id, segment_no, pos, locator, kind, label, number, title; statuses: user_id, work_id, status;
    watched: user_id, locator."""
    open_ = statuses.where("status <> 'completed'").select("user_id", "work_id").join(segments, "work_id")
    left = open_.join(watched.select("user_id", "locator").distinct(), ["user_id", "locator"], "left_anti")
    best = left.groupBy("user_id", "work_id").agg(F.min(F.struct("segment_no", "pos", "locator", "kind", "label", "number", "title")).alias("n"))
    film = F.col("n.kind") == "atomic"
    number = F.when(film, F.lit(1)).otherwise(F.coalesce("n.number", F.col("n.pos") + 1))
    return best.select(
        "user_id",
        "work_id",
        "n.locator",
        number.cast("long").alias("number"),
        F.when(film, "Film").otherwise(F.coalesce("n.label", F.concat(F.lit("Part "), (F.col("n.segment_no") + 1).cast("string")))).alias("part_label"),
        F.when(film, F.coalesce("n.label", F.lit("Film"))).otherwise(F.coalesce("n.title", F.concat(F.lit("Episode "), number.cast("string")))).alias("title"),
    )


def owners(works: DataFrame) -> DataFrame:
    """locator and its owner: the first tracked work that claims it. works: work_id, place, locator."""
    return first_of(works, ["locator"], ["place", "work_id"]).select("locator", "work_id")


def history_page(rows: DataFrame, owned: DataFrame, limit: int, cursor: tuple | None = None) -> DataFrame:
    """A page of history, newest first, after a cursor (watched_at, id); rows without an owner don't count.

    has_more tells on every row whether rows remain beyond the last that is shown, presentable or not."""
    after = rows if cursor is None else rows.where((F.col("watched_at") < F.lit(cursor[0])) | ((F.col("watched_at") == F.lit(cursor[0])) & (F.col("id") < cursor[1])))
    shown = after.join(owned, "locator").orderBy(F.desc("watched_at"), F.desc("id")).limit(limit)
    oldest = after.agg(F.min(F.struct("watched_at", "id")).alias("_oldest"))
    last = shown.agg(F.min(F.struct("watched_at", "id")).alias("_last"))
    more = last.join(F.broadcast(oldest)).select((F.col("_oldest") < F.col("_last")).alias("has_more"))  # one row each
    return shown.join(F.broadcast(more)).select("id", "locator", "work_id", "watched_at", "has_more")


def history_all(rows: DataFrame, owned: DataFrame, limit: int) -> DataFrame:
    """Every user's first page at once: the newest ``limit`` presentable rows."""
    return ranked(rows.join(owned, "locator"), ["user_id"], [F.desc("watched_at"), F.desc("id")], "place").where(F.col("place") <= limit)


def airing_days(episodes: DataFrame, today: Column, days: int = 14) -> DataFrame:
    """Unwatched episodes of the next days, grouped by day. episodes: day (ISO), title, number, episode_title."""
    day = F.col("day").try_cast("date")
    soon = episodes.withColumn("_day", day).where(F.col("_day").between(today, F.date_add(today, days - 1)))
    one = F.struct(alphabetical(F.col("title")).alias("title"), "number", alphabetical(F.col("episode_title")).alias("episode_title"))
    plain = F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["title"].cast("string").alias("title"), x["number"].alias("number"), x["episode_title"].cast("string").alias("episode_title")))
    return soon.groupBy(F.col("_day").alias("day")).agg(plain.alias("episodes"), F.count("*").alias("n_episodes"))


def library_places(entries: DataFrame) -> DataFrame:
    """user_id, work_id and the entry's place by activity, by title (the untitled last) and by rating (the unrated last)."""
    at = lambda *order: F.row_number().over(Window.partitionBy("user_id").orderBy(*order, "work_id"))
    title = F.coalesce("title", F.lit(""))
    return entries.select(
        "user_id", "work_id", at(F.desc("updated_at")).alias("by_activity"), at(title == "", alphabetical(title)).alias("by_title"), at(F.desc_nulls_last("rating")).alias("by_rating")
    )


def collapse_tracked(rows: DataFrame) -> DataFrame:
    """One row per user and survivor: the canonical key's, else the most active. rows: user_id, key, survivor, activity, id."""
    return first_of(rows, ["user_id", "survivor"], [F.desc(F.col("key") == F.col("survivor")), F.desc("activity"), "id"])


def library_filter(entries: DataFrame, status: Column, kind: Column, needle: Column) -> DataFrame:
    """Entries of a status and kind (null: any) whose title holds the needle, whatever the case; an empty needle holds everywhere."""
    wanted = F.lower(F.trim(needle))
    text = (wanted == "") | F.coalesce(F.contains(F.lower(F.col("title")), wanted), F.lit(False))
    return entries.where((status.isNull() | (F.col("status") == status)) & (kind.isNull() | (F.col("media_kind") == kind)) & text)


def match_imports(entries: DataFrame, titles: DataFrame, segments: DataFrame) -> DataFrame:
    """Import entries classed as matched, ambiguous, no_continuity or no_service_title.

    entries: entry_id, service, native; titles: title_id, service, native; segments: title_id, continuity_id."""
    found = entries.join(titles, ["service", "native"], "left").join(segments, "title_id", "left")
    out = found.groupBy("entry_id").agg(F.bool_or(F.col("title_id").isNotNull()).alias("_title"), F.countDistinct("continuity_id").alias("n_continuities"), F.min("continuity_id").alias("_one"))
    kind = F.when(~F.col("_title"), "no_service_title").when(F.col("n_continuities") == 0, "no_continuity").when(F.col("n_continuities") > 1, "ambiguous").otherwise("matched")
    return out.select("entry_id", kind.alias("outcome"), "n_continuities", F.when(kind == "matched", F.col("_one")).alias("continuity_id"))


def collapse_imports(rows: DataFrame) -> DataFrame:
    """One import row per continuity: the latest, then the furthest, the best rated, the smallest external id."""
    order = [F.desc(F.coalesce("updated_ms", F.lit(-1))), F.desc(F.coalesce("progress", F.lit(-1))), F.desc(F.coalesce("score", F.lit(-1))), "external_id"]
    return first_of(rows, ["user_id", "continuity_id"], order)


def apply_imports(local: DataFrame, remote: DataFrame, overwrite: bool = False) -> DataFrame:
    """What an import does to each work: a newer local row blocks status and progress, never the score.

    local: user_id, work_id, updated_at, score; remote: user_id, work_id, updated_at, status, progress, score."""
    mine = local.select("user_id", "work_id", F.col("updated_at").alias("_local"), F.col("score").alias("_score"))
    both = remote.join(mine, ["user_id", "work_id"], "left")
    newer = F.lit(False) if overwrite else F.coalesce(F.col("_local") > F.col("updated_at"), F.lit(False))
    return both.select(
        "user_id",
        "work_id",
        F.when(newer, "skipped_newer").otherwise("applied").alias("outcome"),
        F.when(~newer, F.col("status")).alias("new_status"),
        F.when(~newer, F.col("progress")).alias("new_progress"),
        F.when(F.col("score").isNotNull() & ~F.col("score").eqNullSafe(F.col("_score")), F.col("score")).alias("new_score"),
    )


def continue_watching(statuses: DataFrame, upcoming: DataFrame, most: int) -> DataFrame:
    """Per user the works being watched that have a next instalment, the latest first, up to ``most``.

    statuses: user_id, work_id, status, updated_at; upcoming: user_id, work_id, as of ``next_up``."""
    open_ = statuses.where(F.col("status").isin("watching", "rewatching")).join(upcoming.select("user_id", "work_id").distinct(), ["user_id", "work_id"], "left_semi")
    return ranked(open_, ["user_id"], [F.desc("updated_at"), "work_id"], "place").where(F.col("place") <= most)


def sync_writes(segments: DataFrame, statuses: DataFrame, progress: DataFrame, ratings: DataFrame, targets: DataFrame, providers: list[str]) -> DataFrame:
    """What each provider is sent for each user's works: kind, episode and value of each write, or a warning per segment.

    A segment without a title at a provider gives a warning for it, whatever the others have; else its status, every watched
    instalment, and the instalments' scores on the provider's scale. segments: work_id, segment_no, title_id, offset, locator; progress: user_id, locator; ratings:
    user_id, locator, score; targets: title_id, provider, native."""
    each = F.explode(F.array(*map(F.lit, providers))).alias("provider")
    parts = segments.select("work_id", "segment_no", "title_id").distinct().select("*", each).join(targets, ["title_id", "provider"], "left").drop("title_id")
    keys = ["user_id", "work_id", "segment_no", "provider", "native"]
    owned = parts.join(statuses, "work_id")
    mapped = owned.where("native IS NOT NULL")
    places = segments.select("work_id", "segment_no", "locator", (F.col("offset") + 1).cast("long").alias("episode"))
    write = lambda df, kind, episode, value: df.select(*keys, F.lit(kind).alias("kind"), episode.cast("long").alias("episode"), value.cast("string").alias("value"))
    inside = mapped.join(places, ["work_id", "segment_no"])
    seen = inside.join(progress.select("user_id", "locator").distinct(), ["user_id", "locator"], "left_semi")
    scored = inside.join(ratings, ["user_id", "locator"])
    none = F.lit(None)
    return (
        write(owned.where("native IS NULL"), "warning", none, F.lit("no_member_title"))
        .unionByName(write(mapped, "status", none, F.col("status")))
        .unionByName(write(seen, "progress", F.col("episode"), F.lit("watched")))
        .unionByName(write(scored, "rating", F.col("episode"), F.when(F.col("provider") == "anilist", F.col("score") * 10).otherwise(F.col("score"))))
    )


def interleave(first: DataFrame, second: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Two ranked lists (place from 1) taken in turn, the first list first, up to a limit per key."""
    both = first.withColumn("list", F.lit(0)).unionByName(second.withColumn("list", F.lit(1)))
    return ranked(both, keys, ["place", "list"], "rank").where(F.col("rank") <= limit)


def in_order(curated: DataFrame, release: DataFrame) -> DataFrame:
    """A curated order with the release order's rest behind it. Both: order_id, segment_id, pos."""
    tail = release.join(curated.select("order_id", "segment_id"), ["order_id", "segment_id"], "left_anti")
    both = curated.withColumn("tail", F.lit(0)).unionByName(tail.withColumn("tail", F.lit(1)))
    return ranked(both, ["order_id"], ["tail", "pos", "segment_id"], "place").select("order_id", "segment_id", "place")


def visible_changes(rows: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """Rows where a value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(at))
    return rows.withColumn("before", before).where(~F.col(value).eqNullSafe(F.col("before")))


#: Rated services in the order in which they are shown, and the tops of their scales.
RATED_SERVICES = {"tmdb": 10, "imdb": 10, "metacritic": 100, "mal": 10, "anilist": 100, "anidb": 10}


def bucketed_ratings(records: DataFrame, buckets: DataFrame) -> DataFrame:
    """title_id, score, votes of catalogue records that give a distribution of scores: the average, or where there is none the mean,
    and the sum of the buckets' amounts; none without a score or a vote. records: title_id, average, mean; buckets: title_id, bucket, amount."""
    votes = buckets.groupBy("title_id").agg(F.sum("amount").cast("long").alias("votes"))
    scored = records.select("title_id", F.coalesce("average", "mean").alias("score")).where("score > 0")
    return scored.join(votes, "title_id").where("votes > 0")


def rating_list(ratings: DataFrame) -> DataFrame:
    """unit_id, place, service, score, scale, votes: each service's rating of a unit, the last one written (largest ``seq``), in the services' order.

    ratings: unit_id, service (any but the rated ones is passed over), seq, score, votes."""
    place = F.array_position(F.array(*map(F.lit, RATED_SERVICES)), F.col("service"))
    known = ratings.withColumn("_at", place).where("_at > 0")
    last = known.groupBy("unit_id", "service", "_at").agg(F.max_by(F.struct("score", "votes"), "seq").alias("r"))
    scale = F.element_at(F.array(*map(F.lit, RATED_SERVICES.values())), F.col("_at").cast("int"))
    return ranked(last, ["unit_id"], ["_at"], "place").select("unit_id", "place", "service", "r.score", scale.alias("scale"), "r.votes")
