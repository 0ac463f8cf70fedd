"""Reads of the mapping graph: derivation through shared units, aliases, coverage, alignment of members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scores import source_rank


#: The anime catalogues.
ANIME = ["anidb", "anilist", "kitsu", "mal"]
#: The two titles of a route.
PAIR = ["a_title_id", "a_service", "b_title_id", "b_service"]


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "_rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return ranked(df, keys, order).where("_rank = 1").drop("_rank")


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """df dealt by its keys to so many tasks, or to as many as Spark finds fit."""
    return df.repartition(*([tasks] if tasks else []), *keys)


def routes(edges: DataFrame, *carried: str) -> DataFrame:
    """All routes between titles of different services that share a unit, each once: a is the title whose service comes first by name.

    edges: title_id, service (one a title), unit_id, confidence (0 low, 1 high), provenance, and carried: what both ends of a route keep. A path is as
    good as its weakest edge, and as curated as its most curated one, so both ways. Both sides select the same, so that edges are moved by
    their unit once, by the join itself, which may split units of very many titles."""
    side = lambda p: edges.select("unit_id", *[F.col(c).alias(f"{p}_{c}") for c in ("title_id", "service", "confidence", "provenance", *carried)])
    both = side("a").join(side("b"), "unit_id").where("a_service < b_service")
    ends = [f"{p}_{c}" for c in carried for p in "ab"]
    return both.select(*PAIR, "unit_id", F.least("a_confidence", "b_confidence").alias("confidence"), F.greatest("a_provenance", "b_provenance").alias("provenance"), *ends)


def shared_units(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """The routes of edges with their edge_id at both ends, dealt by the two titles: hardly any two share several units, so combining before the
    shuffle would sort all routes to drop a few."""
    return dealt(routes(edges, "edge_id"), tasks, "a_title_id", "b_title_id")


def both_ways(pairs: DataFrame, to_b: list, to_a: list) -> DataFrame:
    """Each pair as a row from a to b with the columns to_b, and one from b to a with to_a."""
    way = lambda p, q, columns: F.struct(F.col(f"{p}_title_id").alias("title_id"), F.col(f"{q}_title_id").alias("target_id"), F.col(f"{q}_service").alias("target_service"), *columns)
    return pairs.select(F.inline(F.array(way("a", "b", to_b), way("b", "a", to_a))))


def strongest_paths(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per source and target the best path: confidence, then provenance, then the smallest unit; the same both ways."""
    best = F.max(F.struct("confidence", "provenance", (-F.col("unit_id")).alias("unit"))).alias("p")
    columns = [F.col("p.confidence"), F.col("p.provenance"), (-F.col("p.unit")).alias("unit_id")]
    return both_ways(shared_units(edges, tasks).groupBy(*PAIR).agg(best), columns, columns)


def first_paths(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per source and target the path of the smallest edge id, as a read in storage order keeps it."""
    first = lambda q: F.min(F.struct(F.col(f"{q}_edge_id").alias("edge_id"), "unit_id", "confidence", "provenance")).alias(f"to_{q}")
    columns = lambda q: [F.col(f"to_{q}.{c}") for c in ("edge_id", "unit_id", "confidence", "provenance")]
    return both_ways(shared_units(edges, tasks).groupBy(*PAIR).agg(first("a"), first("b")), columns("b"), columns("a"))


def links(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per source and target service: counterparts, best confidence, most curated provenance."""
    return strongest_paths(edges, tasks).groupBy("title_id", "target_service").agg(
        F.count("*").alias("n_counterparts"), F.max("confidence").alias("confidence"), F.max("provenance").alias("provenance")
    )


def resolve_survivors(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """column replaced by its survivor where it is retired. aliases: retired, survivor (flattened: one hop)."""
    hit = aliases.select(F.col("retired").alias("_retired"), F.col("survivor").alias("_survivor"))
    return df.join(hit, F.col(column) == F.col("_retired"), "left").withColumn(column, F.coalesce("_survivor", column)).drop("_retired", "_survivor")


def flatten_aliases(aliases: DataFrame, merges: DataFrame) -> DataFrame:
    """Aliases after a merge: those of merged survivors point to the new survivor, and the merged are retired themselves."""
    return resolve_survivors(aliases, merges, "survivor").unionByName(merges.select("retired", "survivor"))


def retired_keys(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("survivor").agg(F.sort_array(F.collect_list("retired")).alias("retired"))


def group_continuities(segments: DataFrame, titles: DataFrame) -> DataFrame:
    """group_id and its continuity: the smallest that holds one of its titles."""
    return segments.join(titles.select("title_id", "group_id"), "title_id").groupBy("group_id").agg(F.min("continuity_id").alias("continuity_id"))


def title_evidence(pairs: DataFrame, assertions: DataFrame, groups: DataFrame) -> DataFrame:
    """Evidence of title pairs (a, b) in a group: the asserted, else low from the group's source; none for releases.

    assertions: a < b, confidence, source; groups: group_id, source."""
    direct = assertions.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("confidence").alias("_confidence"), F.col("source").alias("_source"))
    both = pairs.join(direct, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")), "left").join(groups.withColumnRenamed("source", "_group_source"), "group_id")
    release = F.col("_source").isNull() & (F.col("_group_source") == "release")
    return both.select(
        "a", "b", F.coalesce("_confidence", F.lit("low")).alias("confidence"), F.when(~release, F.coalesce("_source", "_group_source")).alias("source")
    )


def members_in_order(titles: DataFrame) -> DataFrame:
    """Each title with the titles of its group, in the group's order (ordinal, id)."""
    other = titles.select("group_id", F.col("title_id").alias("member_id"), F.col("service").alias("member_service"), F.col("ordinal").alias("_ordinal"))
    both = titles.select("group_id", "title_id").join(other, "group_id")
    return ranked(both, ["title_id"], ["_ordinal", "member_id"], "place").drop("_ordinal")


def reconcile(requested: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """How a counterpart's coverage is shown, from the unit sets of pairs (title_id, member_id).

    requested, members: title_id, unit_id. ``member``: the request lies inside a member that spans more, shown by its
    instalment on the smallest shared unit; ``supporting``: the member covers less, with the request's instalment; else
    ``bare``."""
    need = requested.groupBy("title_id").agg(F.count("*").alias("n_requested"))
    have = members.groupBy(F.col("title_id").alias("member_id")).agg(F.count("*").alias("n_member"))
    shared = (
        pairs.join(requested, "title_id")
        .join(members.select(F.col("title_id").alias("member_id"), "unit_id"), ["member_id", "unit_id"])
        .groupBy("title_id", "member_id")
        .agg(F.count("*").alias("n_shared"), F.min("unit_id").alias("shared_unit"))
    )
    all_ = pairs.join(need, "title_id", "left").join(have, "member_id", "left").join(shared, ["title_id", "member_id"], "left").fillna(0, ["n_requested", "n_member", "n_shared"])
    inside = (F.col("n_requested") > 0) & (F.col("n_shared") == F.col("n_requested"))
    shape = F.when(inside & (F.col("n_member") > F.col("n_shared")), "member").when(inside | (F.col("n_shared") == 0), "bare").otherwise("supporting")
    return all_.select("title_id", "member_id", "n_requested", "n_member", "n_shared", shape.alias("shape"), F.when(shape != "bare", F.col("shared_unit")).alias("shown_unit"))


def best_aligned(segments: DataFrame, members: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per segment and service the member that shares most units; ties to the smaller ordinal and id; none without any.

    segments: segment_id, unit_id; members: title_id, service, ordinal, unit_id. Shared units are dealt by the title and counted there:
    a title's units lie far apart, so counts before the shuffle would fill memory to drop a few rows."""
    shared = segments.join(members, "unit_id").select("segment_id", "service", "ordinal", "title_id")
    counts = dealt(shared, tasks, "title_id").groupBy("segment_id", "service", "ordinal", "title_id").agg(F.count("*").alias("n_shared"))
    return first_of(counts, ["segment_id", "service"], [F.desc("n_shared"), "ordinal", "title_id"])


def coverage_verdicts(coverage: DataFrame) -> DataFrame:
    """Per group and target service: whether usable, first pending and first conflicting row. coverage: id, group_id, service, state."""
    of = lambda s: F.min(F.when(F.col("state") == s, F.col("id")))
    return coverage.groupBy("group_id", "service").agg(
        F.bool_or(F.col("state").isin("complete", "open")).alias("usable"), of("pending").alias("pending_id"), of("conflict").alias("conflict_id")
    )


def media_kind(titles: DataFrame) -> DataFrame:
    """Kind of a group by its services: any anime catalogue, else a series of TMDB's, else a film. titles: group_id, service, native."""
    anime = F.bool_or(F.col("service").isin(ANIME))
    series = F.bool_or((F.col("service") == "tmdb") & F.col("native").startswith("tv:"))
    return titles.groupBy("group_id").agg(F.when(anime, "anime").when(series, "tv").otherwise("film").alias("media_kind"))


def spine(titles: DataFrame) -> DataFrame:
    """The titles that carry a group's order: AniDB's if any, else the other anime catalogues', else TMDB's."""
    rank = F.when(F.col("service") == "anidb", 0).when(F.col("service").isin(ANIME), 1).when(F.col("service") == "tmdb", 2)
    out = titles.withColumn("_r", rank).where("_r IS NOT NULL").withColumn("_best", F.min("_r").over(Window.partitionBy("group_id"))).where("_r = _best")
    return ranked(out, ["group_id"], ["ordinal", "title_id"], "place").select("group_id", "title_id", "place")


def most_curated(df: DataFrame, keys: list[str], source: str = "source") -> DataFrame:
    """Per key the most curated source."""
    return df.groupBy(*keys).agg(F.max_by(source, source_rank(F.col(source))).alias(source))


def competing(assertions: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposals whose instalment is asserted to another unit. Both: instalment_id, unit_id."""
    other = assertions.select("instalment_id", F.col("unit_id").alias("held_unit_id"))
    return proposals.join(other, "instalment_id").where("unit_id <> held_unit_id")


def endpoint_conflicts(proposals: DataFrame, published: DataFrame) -> DataFrame:
    """Published relations that share their start or their end with a proposal but are not the same: two equi-joins, no OR.

    Both: from_id, to_id."""
    held = published.select(F.col("from_id").alias("held_from"), F.col("to_id").alias("held_to"))
    by_from = proposals.join(held, F.col("from_id") == F.col("held_from")).where("to_id <> held_to")
    by_to = proposals.join(held, F.col("to_id") == F.col("held_to")).where("from_id <> held_from")
    return by_from.unionByName(by_to).distinct()


def same_members(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per set_id whether two relations (set_id, member) hold the same members: a full outer join counts the differences."""
    both = expected.distinct().withColumn("_e", F.lit(1)).join(actual.distinct().withColumn("_a", F.lit(1)), ["set_id", "member"], "full")
    return both.groupBy("set_id").agg((F.count_if(F.col("_e").isNull() | F.col("_a").isNull()) == 0).alias("same"))
