"""Scores: bonuses of the matcher, rating scales, status vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Orders that act as data, low to high.
SOURCES = ["bootstrap", "t1-structure", "t2-pattern", "t3-episode", "llm-research", "llm-verified", "community", "manual"]
STATUSES = ["watching", "plan_to_watch", "on_hold", "completed", "dropped", "rewatching"]
LINK_STATUSES = ["known-no-counterpart", "unmatched", "pending", "conflict", "matched"]


def rounded(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + 0.5)


def source_rank(source: Column) -> Column:
    """Place in the order of curation; release comes before all, anything else is null."""
    return F.when(source == "release", F.lit(-1)).otherwise(F.nullif(F.array_position(F.array(*map(F.lit, SOURCES)), source), F.lit(0)).cast("int") - 1)


def runtime_bonus(left: Column, right: Column) -> Column:
    """0 up to a ratio of 0.8, then linear to 0.15; 0 where a runtime is missing."""
    ratio = F.least(left, right) / F.greatest(left, right)
    return F.when(left.isNull() | right.isNull() | (ratio <= 0.8), F.lit(0.0)).otherwise((ratio - 0.8) / (1 - 0.8) * 0.15)


def position_bonus(left: Column, right: Column, special: Column) -> Column:
    return F.when(special, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(left - right)) * 0.05)


def imported_score(score: Column, form: Column) -> Column:
    """A score on the scale of 1 to 10, from the scale of the list it comes from; null for none."""
    tenth = F.greatest(F.lit(1.0), rounded(score / 10).cast("double"))
    return (
        F.when(score.isNull() | (score <= 0), F.lit(None).cast("double"))
        .when(form == "POINT_100", tenth)
        .when(form == "POINT_5", rounded(score * 2).cast("double"))
        .when(form == "POINT_3", F.when(score <= 1, 3.0).when(score >= 3, 9.0).otherwise(6.0))
        .when(form.isNull() & (score > 10), tenth)
        .otherwise(score.cast("double"))
    )


def exported_score(score: Column, target: Column) -> Column:
    return F.when(target == "anilist", score * 10).otherwise(score)


def link_rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LINK_STATUSES)), status).cast("int") - 1


def completion(usable: Column, pending: Column, conflict: Column) -> Column:
    """Status of a target without links, from its coverage; null if there is nothing to say."""
    return F.when(usable, "known-no-counterpart").when(pending.isNotNull(), "pending").when(conflict.isNotNull(), "conflict")


def newer_local(local: Column, remote: Column) -> Column:
    """Whether the local row is newer than the remote; a remote time that is missing or can't be read isn't older."""
    return F.coalesce(local > F.try_to_timestamp(remote), F.lit(False))


#: AniList's list statuses and what they become.
ANILIST_STATUSES = {"CURRENT": "watching", "COMPLETED": "completed", "PAUSED": "on_hold", "DROPPED": "dropped", "REPEATING": "rewatching", "PLANNING": "plan_to_watch"}


def mal_status(status: Column) -> Column:
    """MyAnimeList's status, which has the library's own names; null for any other."""
    return F.when(status.isin(STATUSES), status)


def anilist_status(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in ANILIST_STATUSES.items() for x in pair])[status]
